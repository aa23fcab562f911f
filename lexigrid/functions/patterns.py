"""Patterns of legal and management language."""

# What marks each purpose of a provision, in order of priority. Matching ignores case.
PURPOSES = (
    ("Enactment+Citation+Commencement", r"(?:(?:Act|Regulations?|Order) may be cited as|(?:Act|Regulations?|Order).*?shall have effect|(?:Act|Regulations?|Order) shall come into (?:force|operation)|comes? into force|has effect.*?on or after|[Cc]itation and commencement|commencement (?:date|order|provision|of this)|[Cc]ommencement\s*$|^(?:\s*)Statutory Instruments|hereby makes the following|Signed by (?:authority|order) of the Secretary)"),
    ("Interpretation+Definition", r'(?:[A-Za-z\d ][""“].*?(?:means|includes|does not include|is (?:information|the)|are|to be read as|are references to|consists)|[""“].*?[""”] is|In thi?e?se? [Rr]egulations?.*?[———]|has?v?e? the (?:same )?(?:respective )?meanings?|[Ff]or the purposes? of (?:this Act|determining|these Regulations)|(?:any reference|references?).*?to|[Ii]nterpretation|for the meaning of)'),
    ("Application+Scope", r"(?:^Application\b|(?:^|[.;,]\s+|\d\s+)(?:these|this) (?:Regulations?|Act|Order|Part|Rules?|section|provisions?|Directive).{0,60}(?:shall |do(?:es)? )?(?:not )?appl(?:y|ies) (?:to|in |where|until|unless)|(?:regulations?|sections?|paragraphs?|articles?) [\d(].{0,60}shall not apply|shall apply to .{0,60} as they apply to|be under a like duty|(?:any )?(?:requirement|prohibition|duty).{0,150}(?:shall (?:also )?extend|shall extend only)|shall extend only to|does not apply (?:to|where|until|in|unless)|shall have (?:no )?effect|ceases? to have effect|provisions of .{0,40}(?:shall )?apply (?:to|in)|shall bind the Crown)"),
    ("Extent", r"(?:(?:Act|Regulation|section)(?: does not | do not | )extends? to|(?:Act|Regulations?|Section).*?extends? (?:only )?to|[Oo]nly.*?extend to|do not extend to|shall not (?:extend|apply) to (?:Scotland|Wales|Northern Ireland))"),
    ("Exemption", r"(?:shall not apply in any case where|by a certificate in writing exempt|\bexemption\b)"),
    ("Process+Rule+Constraint+Condition", r"(?:\bshall\b|\bmust\b|\brequired\b|\brequirements?\b|\bobligations?\b|\bprocedures?\b|\brules?\b|\bconditions?\b|\bduty\b|\bduties\b|\bcomply\b|\bprohibited\b|\bpermitted\b|\bmay not\b|\bstandards?\b|\bensure\b|\bmaintain\b|\bresponsible\b)"),
    ("Power Conferred", r"(?:functions.*(?:exercis(?:ed|able)|conferred)|exercising.*functions|power to make regulations|[Tt]he power under (?:subsection))"),
    ("Charge+Fee", r"(?:fees and charges|(?:fees?|charges?).*?(?:paid|payable)|by the (?:fee|charge)|failed to pay a (?:fee|charge)|fee.*?may not exceed|may charge.*?a fee|[Aa] fee charged)"),
    ("Offence", r"(?:[Oo]ffences?[\s.,—:]|(?:[Ff]ixed|liable to a) penalty)"),
    ("Enforcement+Prosecution", r"(?:(?:criminal|summary|enforcement|prosecut\w+) proceedings|proceedings for (?:an )?offence|on (?:summary )?conviction|[Ee]nforcement)"),
    ("Defence+Appeal", r"(?:\b[Aa]ppeal\b|[Ii]t is a defence for a|may not rely on a defence|shall not be (?:guilty|liable)|[Ii]t shall (?:also )?.*?be a defence|rebuttable)"),
    ("Liability", r"(?:\bliability\b|\bliable\b)"),
    ("Repeal+Revocation", r"(?:\.\s+\.\s+\.\s+\.\s+\.\s+\.\s+\.|(?:revoked|repealed)|(?:[Rr]epeals|revocations)|following Acts shall cease to have effect)"),
    ("Amendment", r"(?:shall be inserted|there is inserted|insert the following after|shall be (?:inserted|substituted) the words|for.*?substitute|omit the (?:words?|entr(?:y|ies))|shall be amended|[Aa]mendments?|[Aa]mended as follows)"),
    ("Transitional Arrangement", r"(?:transitional provision|transitional arrangements?)"),
)

# What marks each category of management systems, in order of priority. Matching ignores case.
CATEGORIES = (
    ("Policy", r"(?:[Pp]olicy?i?e?s?|[Oo]bjectives?|[Ss]trateg)"),
    ("Organisation", r"(?:[Oo]rg.? chart|[Oo]rganisation chart|making of appointments?|(?:must|may|shall)\s?(?:jointly)?\s?appoint|person.*?appointed|appoint a person)"),
    ("Organisation - Control", r"(?:[Pp]rocess|[Pp]rocedure|[Ww]ork instruction|[Mm]ethod statement|[Ii]nstruction|comply?i?e?s? with.*?(?:duties|requirements)|is responsible for|has control over|(?:supervised?|supervising))"),
    ("Organisation - Communication & Consultation", r"(?:[Cc]ommunicat|[Cc]onsult|(?:send a copy of it|be sent) to|must identify to|publish a report|must (?:immediately )?inform|report to|(?:by|to) provide?i?n?g?.*?information|made available to (?:the public)|supplied (?:in writing|with a copy)|aware of the contents of)"),
    ("Organisation - Collaboration, Coordination, Cooperation", r"(?:[Cc]ollaborat|[Cc]oordinat|[Cc]ooperat)"),
    ("Organisation - Competence", r"(?:[Cc]ompeten(?:t|ce|cy)\s|[Tt]raining|[Ii]nformation, instruction and training|[Ii]nformation.*?provided to every person|provide.*?information|person satisfies the criteria|skills, knowledge and experience|organisational capability|instructe?d?)"),
    ("Organisation - Costs", r"(?:[Cc]ost[- ]benefit|[Nn]ett? cost|[Ff]ee[\s\p{Punct}]|[Cc]harge|[Ff]inancial loss)"),
    ("Records", r"(?:(?:[Rr]ecord|[Rr]eport [^t]|[Rr]egister)|[Ll]ogbook|[Ii]nventory|[Dd]atabase|(?:[Ee]nforcement|[Pp]rohibition|[Ii]mprovement) notice|[Dd]ocuments?|(?:marke?d?i?n?g?|labelled)|must be kept|certificate|health and safety file)"),
    ("Permit, Authorisation, License", r"(?:[Pp]ermit[\s\p{Punct}]|[Aa]uthorisation|[Aa]uthorised [^r]|[Ll]i[sc]en[sc]ed?|[Ll]i[sc]en[sc]ing)"),
    ("Aspects and Hazards", r"(?:[Aa]spects and impacts|[Hh]azard)"),
    ("Planning & Risk / Impact Assessment", r"(?:[Aa]nnual plan|[Ss]trategic plan|[Bb]usiness plan|[Pp]lan of work|construction phase plan|written plan|measures? to be specified in the plan|(?:project|action) plan|project is planned|[Ii]mpact [Aa]ssessment|[Rr]isk [Aa]ssessment|assessment of any risks|suitable and sufficient assessment|[Ii]n making the assessment|(?:reassess|reassessed|reassessment)|general principles of prevention|identify and eliminate)"),
    ("Risk Control", r"(?:avoid the need|suitable and sufficient steps|steps as are reasonable in the circumstances must be taken|taken? all reasonable steps|takes immediate steps|[Rr]isk [Cc]ontrol|control.*?risk|[Rr]isk mitigation|use the best available techniques not entailing excessive cost|eliminates.*?the risk|reduces? the risk|provided to.*?employees|provision and use of|safety management system|corrective measures?|meets the requirements?|standards for the construction|shall make full and proper use|measures?.*?specified.*?plan|take such measures)"),
    ("Notification", r"(?:given?.*?notice|accident report|[Nn]otify|[Nn]otification|[Aa]pplication for|publish.*?a notice)"),
    ("Maintenance, Examination and Testing", r"(?:[Mm]aintenance|[Mm]aintaine?d?|[Ee]xamination|[Tt]esting|[Ii]nspecti?o?n?e?d?)"),
    ("Checking, Monitoring", r"(?:[Cc]heck|[Mm]onitor|medical exam|at least once every.*?years|kept available for inspection)"),
    ("Review", r"(?:[Mm]anagement review|(?:[Rr]eviewed|is [Rr]evised)|(?:conduct|carry out|carrying out) (?:a|the) review|review the (?:assessment))"),
)
