"""Dictionaries of actors: laws' and policies'."""

from __future__ import annotations

# Fixed values: (label, kind, families, patterns) of the actors of laws, special before general. A family's patterns count in laws of
# that family only; labels without patterns are known, but never found.
LAWS = (
    ("Crown", "government", (), ("Crown", "(?:Her|His) Majesty")),
    ("Gvt: Minister: Secretary of State for Defence", "government", (), ("Secretary of State for Defence",)),
    ("Gvt: Minister: Secretary of State for Transport", "government", (), ("Secretary of State for Transport",)),
    ("Gvt: Minister: Attorney General", "government", (), ("Attorney General",)),
    ("Gvt: Minister", "government", (), ("(?:Secretary of State|[Mm]inisters?)",)),
    ("Gvt: Agency: Health and Safety Executive for Northern Ireland", "government", (), ("(?:Health and Safety Executive for Northern Ireland|HSENI)",)),
    ("Gvt: Agency: Health and Safety Executive", "government", (), ("(?:Health and Safety Executive|[Tt]he Executive)",)),
    ("Gvt: Agency: Environment Agency", "government", (), ("Environment Agency",)),
    ("Gvt: Agency: Scottish Environment Protection Agency", "government", (), ("(?:Scottish Environment Protection Agency|SEPA)",)),
    ("Gvt: Agency: Office for Nuclear Regulation", "government", (), ("(?:Office for Nuclear Regulations?|ONR)",)),
    ("Gvt: Agency: Office for Environmental Protection", "government", (), ("(?:Office for Environmental Protection|OEP)",)),
    ("Gvt: Agency: Office of Rail and Road", "government", (), ("Office of Rail and Road?",)),
    ("Gvt: Agency: OFCOM", "government", (), ("(?:Office of Communications?|OFCOM)",)),
    ("Gvt: Agency: Natural Resources Body for Wales", "government", (), ("Natural Resources Body for Wales",)),
    ("Gvt: Agency: Maritime and Coastguard Agency", "government", (), ("(?:Maritime and Coastguard Agency|MCA)",)),
    ("Gvt: Agency: Oil and Gas Authority", "government", (), ("(?:Oil and Gas Authority|North Sea Transition Authority|OGA|NSTA)",)),
    ("EU: Agency: ECHA", "government", (), ("(?:European Chemicals Agency|ECHA)",)),
    ("EU: Agency: EFSA", "government", (), ("(?:European Food Safety Authority|EFSA)",)),
    ("EU: Agency: EEA", "government", (), ("(?:European Environment Agency|EEA)",)),
    ("Gvt: Agency: NDA", "government", (), ("(?:Nuclear Decommissioning Authority|NDA|[Tt]he NDA)",)),
    ("Gvt: Agency: GEMA", "government", (), ("(?:Gas and Electricity Markets Authority|GEMA)",)),
    ("Gvt: Agency", "government", (), ("[Aa]gency",)),
    ("Gvt: Authority: Enforcement", "government", (), ("(?:[Rr]egulati?on?r?y?|[Ee]nforce?(?:ment|ing)) [Aa]uthority?i?e?s?",)),
    ("Gvt: Authority: Local", "government", (), ("(?:[Ll]ocal [Aa]uthority?i?e?s?|council of a county|(?:county|district)(?: borough | )council|London Borough Council|council constituted)",)),
    ("Gvt: Authority: Planning", "government", (), ("[Pp]lanning [Aa]uthority?i?e?s?",)),
    ("Gvt: Authority: Fire and Rescue", "government", (), ("(?:[Ff]ire and [Rr]escue [Aa]uthority?i?e?s?|[Ff]ire [Aa]uthority?i?e?s?)",)),
    ("Gvt: Authority: Harbour", "government", (), ("(?:[Hh]arbour [Aa]uthority?i?e?s?|harbour master)",)),
    ("Gvt: Authority: Licensing", "government", (), ("[Ll]icen[cs]ing [Aa]uthority?i?e?s?", "(?:[Tt]he )?(?:[Rr]elevant )?[Ll]icen[cs]ing [Bb]od(?:y|ies)")),
    ("Gvt: Authority: Waste", "government", (), ("(?:[Ww]aste collection|[Ww]aste disposal|[Dd]isposal) [Aa]uthority?i?e?s?",)),
    ("Gvt: Authority: Public", "government", (), ("[Pp]ublic [Aa]uthority?i?e?s?",)),
    ("Gvt: Authority: Traffic", "government", (), ("[Tt]raffic [Aa]uthority?i?e?s?",)),
    ("Gvt: Authority: Market", "government", (), ("(?:market surveillance|weights and measures) authority?i?e?s?",)),
    ("Gvt: Authority", "government", (), ("(?:(?:[Tt]he|[Aa]n|appropriate|allocating|[Cc]ompetent|[Dd]esignated|[Rr]elevant|hazardous substances) authorit(?:y|ies)|[Rr]egulators?|[Mm]onitoring [Aa]uthorit(?:y|ies)|that authority)",)),
    ("Gvt: Commissioners", "government", (), ("[Cc]ommissioners",)),
    ("EU: Commission", "government", (), ("[Cc]ommission",)),
    ("EU: Member State", "government", (), ("[Mm]ember [Ss]tates?",)),
    ("Gvt: Officer", "government", (), ("(?:[Aa]uthorised [Oo]fficer|[Oo]fficer of a local authority|[Oo]fficer)",)),
    ("Gvt: Judiciary", "government", (), ("(?:court|[Jj]ustice of the [Pp]eace|[Tt]ribunal|[Ss]heriff|[Mm]agistrate|prosecutor|Lord Advocate)",)),
    ("Gvt: Emergency Services: Police", "government", (), ("(?:[Cc]onstable|[Cc]hief(?: officer | )of [Pp]olice|police force)",)),
    ("Gvt: Emergency Services", "government", (), ("[Ee]mergency [Ss]ervices?",)),
    ("Gvt: Appropriate Person", "government", (), ("[Aa]ppropriate [Pp]ersons?",)),
    ("Gvt: Ministry: Treasury", "government", (), ("[Tt]reasury",)),
    ("Gvt: Ministry: HMRC", "government", (), (r"(?:customs officer|Her Majesty['’]s Commissioners for Revenue and Customs|Her Majesty’s Revenue and Customs)",)),
    ("Gvt: Ministry: Ministry of Defence", "government", (), ("Ministry of Defence",)),
    ("Gvt: Ministry: Department of Enterprise, Trade and Investment", "government", (), ("Department of Enterprise,? Trade and Investment",)),
    ("Gvt: Ministry", "government", (), ("(?:[Mm]inistry|[Tt]he Department)",)),
    ("Gvt: Devolved Admin: National Assembly for Wales", "government", (), ("(?:National Assembly for Wales|Senedd|Welsh Parliament)",)),
    ("Gvt: Devolved Admin: Scottish Parliament", "government", (), ("Scottish Parliament",)),
    ("Gvt: Devolved Admin: Northern Ireland Assembly", "government", (), ("Northern Ireland Assembly",)),
    ("Gvt: Devolved Admin", "government", (), ("Assembly",)),
    ("HM Forces", "governed", (), (r"(?:(?:His|Her) Majesty['’]s forces|armed forces)",)),
    ("Org: Employer", "governed", (), ("[Ee]mployers?",)),
    ("Org: Owner", "governed", (), ("(?:[Oo]wners?|mine owner|owner of a non-production installation|installation owner)",)),
    ("Org: Occupier", "governed", (), ("(?:[Oo]ccupiers?|[Pp]erson who is in occupation)",)),
    ("Org: Company", "governed", (), ("(?:[Cc]ompany?i?e?s?|[Bb]usinesse?s?|[Ee]nterprises?|[Bb]ody?i?e?s? corporate)",)),
    ("Operator", "governed", (), (r"(?:[Oo]perators?|(?:berth|mine|well|economic|meter)[\s-]operator|operator of a production installation)",)),
    ("Ind: Employee", "governed", (), ("[Ee]mployees?",)),
    ("Ind: Worker", "governed", (), ("(?:[Ww]orkers?|[Ww]orkmen|(?:members of the )?[Ww]orkforce)",)),
    ("Ind: Self-employed Worker", "governed", (), ("[Ss]elf-employed (?:[Pp]ersons?|diver)",)),
    ("Ind: Responsible Person", "governed", (), ("[Rr]esponsible [Pp]ersons?",)),
    ("Ind: Competent Person", "governed", (), ("(?:[Cc]ompetent [Pp]ersons?|person who is competent)",)),
    ("Ind: Duty Holder", "governed", (), ("(?:[Dd]uty [Hh]olders?|[Dd]utyholder)",)),
    ("Ind: Manager", "governed", (), ("(?:managers?|mine manager|manager of a mine|installation manager)",)),
    ("Ind: Supervisor", "governed", (), ("(?:[Ss]upervisor|[Pp]erson in control|individual in charge)",)),
    ("Spc: Authorised Person", "governed", (), ("[Aa]uthoris?ed [Pp]ersons?",)),
    ("Spc: Administrator", "governed", (), ("(?:[Tt]he [Aa]dministrator|[Ss]cheme [Aa]dministrators?)",)),
    ("Spc: Compliance Body", "governed", (), ("[Cc]ompliance [Bb]od(?:y|ies)",)),
    ("Spc: Certification Body", "governed", (), ("[Cc]ertification [Bb]od(?:y|ies)",)),
    ("Spc: Approval Body", "governed", (), ("[Aa]pproval [Bb]od(?:y|ies)",)),
    ("Spc: Appeal Body", "governed", (), ("[Aa]ppeal [Bb]od(?:y|ies)",)),
    ("Spc: Conformity Assessment Body", "governed", (), ("[Cc]onformity [Aa]ssessment [Bb]od(?:y|ies)",)),
    ("Spc: Approved Body", "governed", (), ("[Aa]pproved [Bb]od(?:y|ies)",)),
    ("Spc: Notifying Authority", "government", (), ("[Nn]otifying [Aa]uthority?i?e?s?",)),
    ("Org: Responsible Undertaking", "governed", (), ("(?:[Rr]esponsible |[Tt]he |[Aa]n |[Ee]ach )[Uu]ndertakings?",)),
    ("Spc: Responsible Officer", "governed", (), ("[Rr]esponsible [Oo]fficers?",)),
    ("Spc: Participant", "governed", ("ENERGY",), ("[Pp]articipants?",)),
    ("Ind: Licensee", "governed", (), ("[Ll]icen[cs]ees?",)),
    ("Ind: Appellant", "governed", (), ("[Aa]ppellants?",)),
    ("Ind: Hirer", "governed", (), ("[Hh]irers?",)),
    ("Ind: Person", "governed", (), ("(?:[Pp]ersons?|[Ii]ndividual)",)),
    ("SC: Downstream User", "governed", (), ("[Dd]ownstream [Uu]sers?",)),
    ("Ind: User", "governed", (), ("[Uu]sers?",)),
    ("Spc: Inspector", "governed", (), ("(?:[Uu]ser inspectorate|[Ii]nspectors?|[Vv]erifier|[Ww]ell examiner)",)),
    ("Spc: Employees' Representative", "governed", (), ("(?:[Ee]mployees' representative|[Ss]afety representatives?|[Tt]rade [Uu]nions? representatives?)",)),
    ("Spc: Trade Union", "governed", (), ("[Tt]rade [Uu]nions?",)),
    ("Spc: Assessor", "governed", (), ("[Aa]ssessors?",)),
    ("Spc: Engineer", "governed", (), ("[Ee]ngineer",)),
    ("SC: Manufacturer", "governed", (), ("[Mm]anufacturers?",)),
    ("SC: C: Principal Designer", "governed", (), ("[Pp]rincipal [Dd]esigner",)),
    ("SC: C: Designer", "governed", (), ("(?:[Dd]esigner|designs for another)",)),
    ("SC: C: Principal Contractor", "governed", (), ("[Pp]rincipal [Cc]ontractor",)),
    ("SC: C: Contractor", "governed", (), ("(?:[Cc]ontractors?|[Dd]iving contractor|[Cc]ompressed air contractor)",)),
    ("SC: Supplier", "governed", (), ("(?:[Ss]upplier|[Pp]erson who supplies)",)),
    ("SC: Importer", "governed", (), ("(?:[Ii]mporter|person who.*?imports*?)",)),
    ("SC: Distributor", "governed", (), ("[Dd]istributors?",)),
    ("SC: Registrant", "governed", (), ("[Rr]egistrants?",)),
    ("SC: Applicant", "governed", (), ("[Aa]pplicants?",)),
    ("SC: Authorised Representative", "governed", (), ("[Aa]uthoris?ed [Rr]epresentatives?",)),
    ("SC: Notified Body", "governed", (), ("[Nn]otified [Bb]od(?:y|ies)",)),
    ("SC: Client", "governed", (), ("[Cc]lients?",)),
    ("SC: T&L: Carrier", "governed", (), ("(?:[Tt]ransporter|[Cc]arriers?)",)),
    ("SC: T&L: Driver", "governed", (), ("[Dd]river",)),
    ("Svc: Installer", "governed", (), ("[Ii]nstaller",)),
    ("Org: Landlord", "governed", (), ("[Ll]andlord",)),
    ("Public", "governed", (), ("(?:[Pp]ublic|[Ee]veryone|[Cc]itizens?)",)),
    ("Offshore: Licensee", "governed", ("OH&S: Offshore",), ("[Ll]icen[cs]ees?",)),
    ("Public: Provider", "governed", ("PUBLIC",), ("[Pp]roviders?",)),
    ("Public: Keeper", "governed", ("PUBLIC",), ("[Kk]eepers?",)),
    ("Public: Dealer", "governed", ("PUBLIC",), ("(?:[Dd]ealers?|registered (?:firearms )?dealer)",)),
    ("Gvt: Authority", "government", ("WILDLIFE & COUNTRYSIDE",), (r"[Ss]ection \d+\w* authorit(?:y|ies)",)),
    ("Spc: Liquidator", "governed", (), ()),
    ("Spc: Administrator", "governed", (), ()),
    ("Spc: Receiver", "governed", (), ()),
    ("Spc: Trustee in Bankruptcy", "governed", (), ()),
    ("EU: Certification Body", "government", (), ()),
    ("EU: Central Management", "government", (), ()),
    ("EU: Special Negotiating Body", "government", (), ()),
    ("Ind: Young Person", "governed", (), ()),
    ("Org: Trade Association", "governed", (), ()),
    ("Svc: Water Undertaker", "governed", (), ()),
    ("Spc: Appellant", "governed", (), ()),
    ("Spc: Licence Holder", "governed", (), ()),
    ("Gvt: Consultation Body", "government", (), ()),
)

# Words by which a governmental actor is told in lower case.
GOVERNMENT_WORDS = (
    "crown",
    "majesty",
    "secretary of state",
    "minister",
    "regulations made",
    "health and safety executive",
    "hse",
    "executive",
    "office of rail",
    "ofcom",
    "commission",
    "nda",
    "gema",
    "enforcing authority",
    "authority",
    "local authority",
    "council",
    "appropriate authority",
    "national authority",
    "commissioner",
    "member state",
    "inspector",
    "tribunal",
    "court",
    "sheriff",
    "procurator fiscal",
    "chief officer",
    "constable",
    "police",
    "department",
    "parliament",
    "notifying authorit",
)

# Fixed values: (label, kind, families, patterns) of the roles of policy documents, special before general.
POLICIES = (
    ("MoD: Secretary of State for Defence", "government", (), (r"Secretary of State(?:\s+for Defence)?",)),
    ("MoD: Permanent Under-Secretary", "government", (), ("Permanent Under[- ]Secretary", r"\bPUS\b")),
    ("MoD: Chief of Defence Staff", "government", (), ("Chief of Defence Staff", r"\bCDS\b")),
    ("MoD: Defence Safety Authority", "government", (), ("Defence Safety Authority", r"\bDSA\b")),
    ("MoD: Senior Duty Holder", "governed", (), ("[Ss]enior [Dd]uty [Hh]older", r"\bSDH\b")),
    ("MoD: Operating Duty Holder", "governed", (), ("[Oo]perating [Dd]uty [Hh]older", r"\bODH\b")),
    ("MoD: Duty Holder", "governed", (), ("[Dd]uty [Hh]older",)),
    ("MoD: Unit Safety Officer", "governed", (), ("[Uu]nit [Ss]afety [Oo]fficer", r"\bUSO\b")),
    ("MoD: Safety Case Author", "governed", (), ("[Ss]afety [Cc]ase [Aa]uthor",)),
    ("MoD: Independent Safety Adviser", "governed", (), ("[Ii]ndependent [Ss]afety [Aa]dviser", r"\bISA\b")),
    ("MoD: Safety Committee", "governed", (), ("[Ss]afety [Cc]ommittee", "[Hh]ealth and [Ss]afety [Cc]ommittee")),
    ("MoD: Single Service Safety Adviser", "governed", (), ("[Ss]ingle [Ss]ervice [Ss]afety [Aa]dviser", r"\bSSSA\b")),
    ("MoD: Senior Responsible Owner", "governed", (), ("[Ss]enior [Rr]esponsible [Oo]wner", r"\bSRO\b")),
    ("MoD: Accountable Person", "governed", (), ("[Aa]ccountable [Pp]erson", r"\bAP\b")),
    ("MoD: Commanding Officer", "governed", (), ("[Cc]ommanding [Oo]fficer", r"\bCO\b")),
    ("MoD: Head of Establishment", "governed", (), ("[Hh]ead of [Ee]stablishment", r"\bHoE\b")),
    ("MoD: Commander/Manager", "governed", (), ("(?:commander|manager|line manager)",)),
    ("MoD: User", "governed", (), (r"\b[Uu]ser\b",)),
    ("MoD: Operator", "governed", (), (r"\b[Oo]perator\b",)),
    ("MoD: Project Technical Authority", "governed", (), ("[Pp]roject [Tt]echnical [Aa]uthority", r"\bPTA\b")),
    ("MoD: Design Authority", "governed", (), ("[Dd]esign [Aa]uthority",)),
    ("MoD: Design Organisation", "governed", (), ("[Dd]esign [Oo]rganisation",)),
    ("MoD: Equipment Manager", "governed", (), ("[Ee]quipment [Mm]anager",)),
    ("MoD: Equipment Sponsor", "governed", (), ("[Ee]quipment [Ss]ponsor",)),
    ("MoD: Radiation Protection Supervisor", "governed", (), ("[Rr]adiation [Pp]rotection [Ss]upervisor", r"\bRPS\b")),
    ("MoD: Radiation Protection Adviser", "governed", (), ("[Rr]adiation [Pp]rotection [Aa]dviser", r"\bRPA\b")),
    ("MoD: Radiation Safety Officer", "governed", (), ("[Rr]adiation [Ss]afety [Oo]fficer", r"\bRSO\b")),
    ("MoD: Radioactive Waste Adviser", "governed", (), ("[Rr]adioactive [Ww]aste [Aa]dviser", r"\bRWA\b")),
    ("MoD: Superintendent of Radiology", "governed", (), ("[Ss]uperintendent of [Rr]adiology",)),
    ("MoD: Range Authorising Officer", "governed", (), ("[Rr]ange [Aa]uthoris(?:ing|ed) [Oo]fficer", r"\bRAO\b")),
    ("MoD: Range Conducting Officer", "governed", (), ("[Rr]ange [Cc]onducting [Oo]fficer", r"\bRCO\b")),
    ("MoD: Range Safety Officer", "governed", (), ("[Rr]ange [Ss]afety [Oo]fficer",)),
    ("MoD: Range Commander", "governed", (), ("[Rr]ange [Cc]ommander",)),
    ("MoD: Range Warden", "governed", (), ("[Rr]ange [Ww]arden",)),
    ("MoD: Range Administering Unit", "governed", (), ("[Rr]ange [Aa]dministering [Uu]nit", r"\bRAU\b")),
    ("MoD: Target Area Safety Officer", "governed", (), ("[Tt]arget [Aa]rea [Ss]afety [Oo]fficer", r"\bTASO\b")),
    ("MoD: Chief Environment and Safety Officer", "governed", (), ("[Cc]hief [Ee]nviron(?:ment|mental) and [Ss]afety [Oo]fficer", r"\bCESO\b")),
    ("MoD: Senior Environmental Adviser", "governed", (), ("[Ss]enior [Ee]nvironmental [Aa]dviser",)),
    ("MoD: Responsible Person", "governed", (), ("[Rr]esponsible [Pp]erson",)),
    ("MoD: Competent Person", "governed", (), ("[Cc]ompetent [Pp]erson",)),
    ("MoD: Authorised Person", "governed", (), ("[Aa]uthoris(?:ed|ing) [Pp]erson",)),
    ("MoD: Appointed Person", "governed", (), ("[Aa]ppointed [Pp]erson",)),
    ("MoD: Independent Reviewer", "governed", (), ("[Ii]ndependent [Rr]eviewer",)),
    ("MoD: Permit Issuer", "governed", (), ("[Pp]ermit [Ii]ssuer",)),
    ("MoD: Diving Supervisor", "governed", (), ("[Dd]iving [Ss]upervisor",)),
    ("MoD: Operational Commander", "governed", (), ("[Oo]perational [Cc]ommander",)),
    ("MoD: Person in Charge", "governed", (), ("[Pp]erson in [Cc]harge",)),
    ("MoD: Infrastructure Owner", "governed", (), ("[Ii]nfrastructure [Oo]wner",)),
    ("MoD: Environmental Protection Adviser", "governed", (), ("[Ee]nvironmental [Pp]rotection [Aa]dviser", r"\bEPA\b")),
    ("MoD: Prime Contractor", "governed", (), ("[Pp]rime [Cc]ontractor",)),
    ("MoD: Contractor", "governed", (), (r"\b[Cc]ontractor\b",)),
    ("MoD: Infrastructure Provider", "governed", (), ("[Ii]nfrastructure [Pp]rovider",)),
    ("MoD: Supplier", "governed", (), (r"\b[Ss]upplier\b",)),
    ("MoD: Client", "governed", (), (r"\b[Cc]lient\b",)),
    ("MoD: Defence Infrastructure Organisation", "government", (), ("Defence Infrastructure Organisation", r"\bDIO\b")),
    ("MoD: Defence Nuclear Safety Regulator", "government", (), ("Defence Nuclear Safety Regulator", r"\bDNSR\b")),
    ("MoD: Defence Ordnance Safety Group", "government", (), ("Defence Ordnance Safety Group", r"\bDOSG\b")),
    ("MoD: Defence Fire Safety Regulator", "government", (), ("Defence Fire (?:Safety )?Regulator",)),
    ("MoD: Defence Organisation", "governed", (), ("[Dd]efence [Oo]rganisation",)),
    ("MoD: Top Level Budget Holder", "governed", (), ("[Tt]op [Ll]evel [Bb]udget [Hh]older", r"\bTLB\b")),
)

# Labels that are no roles, and labels that stand for a role of the dictionary.
NO_ROLES = (
    "MoD: Risk Assessment",
    "MoD: Legislation",
    "MoD: Workplace",
    "MoD: Defence Standard",
    "MoD: Defence Standard 05-10",
    "MoD: Defence Training Regulations",
    "MoD: Planning Policy Guidance",
    "MoD: Explosive Component",
    "MoD: Host Platform",
    "MoD: Platform",
    "MoD: Defence First Aid Workman's Reel",
    "MoD: Risk Presentation Authority",
    "MoD: Whole Life Asset Management",
    "MoD: Infrastructure Enterprise",
)
ROLE_NAMES = {
    "MoD: Employee": "MoD: User",
    "MoD: Worker": "MoD: User",
    "MoD: Outside Worker": "MoD: Contractor",
    "MoD: Personnel": "MoD: User",
    "MoD: Staff": "MoD: User",
    "MoD: Civilian": "MoD: User",
    "MoD: Civilian Staff": "MoD: User",
    "MoD: Soldier": "MoD: User",
    "MoD: Crew Member": "MoD: User",
    "MoD: Air Crew": "MoD: User",
    "MoD: Visitor": "MoD: User",
    "MoD: Wearer of PPE": "MoD: User",
    "MoD: Patient": "MoD: User",
    "MoD: Organisation": "MoD: Defence Organisation",
    "MoD: Employer": "MoD: Defence Organisation",
    "MoD: Customer": "MoD: Defence Organisation",
    "MoD: Force Element": "MoD: Defence Organisation",
    "MoD: Force Generating Command": "MoD: Defence Organisation",
    "MoD: Defence Board": "MoD: Defence Organisation",
    "MoD: Defence Training Committee": "MoD: Defence Organisation",
    "MoD: Defence Training Estate": "MoD: Defence Organisation",
    "MoD: Defence Training Requirements Organisation": "MoD: Defence Organisation",
    "MoD: Defence Equipment & Support": "MoD: Defence Organisation",
    "MoD: Defence Equipment Sales Authority": "MoD: Defence Organisation",
    "MoD: Environmental Group": "MoD: Defence Organisation",
    "MoD: Trade Union": "MoD: Defence Organisation",
    "MoD: Local Authority": "MoD: Defence Organisation",
    "MoD: Civilian Emergency Services": "MoD: Defence Organisation",
    "MoD: Independent Organisation": "MoD: Defence Organisation",
    "MoD: Host Nation": "MoD: Defence Organisation",
    "MoD: Procurement Authority": "MoD: Defence Organisation",
    "MoD: Defence Logistics and Range Safety Committee": "MoD: Defence Organisation",
    "MoD: Defence Logistic Undersea Command Ship Systems": "MoD: Defence Organisation",
    "MoD: Defence Environmental and Energy Infrastructure Team": "MoD: Defence Organisation",
    "MoD: Defence Clinical Authority": "MoD: Defence Organisation",
    "MoD: Accountable Officer": "MoD: Accountable Person",
    "MoD: Defence Accountable Person": "MoD: Accountable Person",
    "MoD: Defence Duty Holder": "MoD: Duty Holder",
    "MoD: Targetry Duty Holder": "MoD: Duty Holder",
    "MoD: Defence Top Level Budget Holder": "MoD: Top Level Budget Holder",
    "MoD: Senior Leader": "MoD: Commander/Manager",
    "MoD: Senior Manager": "MoD: Commander/Manager",
    "MoD: Senior Officer": "MoD: Commander/Manager",
    "MoD: Senior Person": "MoD: Commander/Manager",
    "MoD: Senior Management": "MoD: Commander/Manager",
    "MoD: Instructor": "MoD: Commander/Manager",
    "MoD: Activity Lead": "MoD: Commander/Manager",
    "MoD: Chief Executive Officer": "MoD: Commander/Manager",
    "MoD: Sponsor": "MoD: Senior Responsible Owner",
    "MoD: Project / Delivery Team Leader": "MoD: Senior Responsible Owner",
    "MoD: Project Team": "MoD: Senior Responsible Owner",
    "MoD: Project Team Member": "MoD: Senior Responsible Owner",
    "MoD: Change Owner": "MoD: Senior Responsible Owner",
    "MoD: Owner": "MoD: Senior Responsible Owner",
    "MoD: Capability Holder": "MoD: Senior Responsible Owner",
    "MoD: Senior Equipment Holder": "MoD: Senior Responsible Owner",
    "MoD: Permanent Secretary": "MoD: Permanent Under-Secretary",
    "MoD: Second Permanent Secretary": "MoD: Permanent Under-Secretary",
    "MoD: Chief of Materiel": "MoD: Chief of Defence Staff",
    "MoD: Deputy Chief of Defence Staff": "MoD: Chief of Defence Staff",
    "MoD: Authority": "MoD: Defence Safety Authority",
    "MoD: Regulator": "MoD: Defence Safety Authority",
    "MoD: Statutory Regulator": "MoD: Defence Safety Authority",
    "MoD: Defence Regulator": "MoD: Defence Safety Authority",
    "MoD: Safety Authority": "MoD: Defence Safety Authority",
    "MoD: Regulatory Authorities": "MoD: Defence Safety Authority",
    "MoD: Defence Safety and Environmental Authorities": "MoD: Defence Safety Authority",
    "MoD: Defence Safety Committee": "MoD: Safety Committee",
    "MoD: Committee": "MoD: Safety Committee",
    "MoD: Safety Centre": "MoD: Defence Safety Authority",
    "MoD: Operating Authority": "MoD: Operating Duty Holder",
    "MoD: Responsible Operating Authority": "MoD: Operating Duty Holder",
    "MoD: Range Authority": "MoD: Range Authorising Officer",
    "MoD: Establishment": "MoD: Head of Establishment",
    "MoD: Establishment Official": "MoD: Head of Establishment",
    "MoD: Data Controller": "MoD: Head of Establishment",
    "MoD: Manufacturer": "MoD: Contractor",
    "MoD: Consignor": "MoD: Contractor",
    "MoD: System Integrator": "MoD: Contractor",
    "MoD: Defence Fire Risk Management Organisation": "MoD: Defence Fire Safety Regulator",
    "MoD: Defence Ordnance Safety Regulator": "MoD: Defence Ordnance Safety Group",
}
