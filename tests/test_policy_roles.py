from lexigrid.functions.actors import DICTIONARY, compiled
from lexigrid.functions.obligations import of_text
from lexigrid.plans import catalog
from lexigrid.plans.bindings import VERBS, bound

FOLDER = "/root/testdata/sf0.001"


def test_every_document_has_its_obligations(spark):
    words = compiled(DICTIONARY)
    got = {r.doc_id: r for r in catalog.QUERIES["policy_roles"](spark, FOLDER).collect()}
    rows = bound(spark, FOLDER, "texts").collect()
    assert set(got) == {r.doc_id for r in rows} and len(rows) > 100
    for r in rows:
        every = of_text(r.sentence, words)
        assert got[r.doc_id].modals == "|".join(o["modal"] for o in every if o["modal"])
        assert got[r.doc_id].roles == "|".join(f"{x['label']}={x['role']}" for o in every for x in o["roles"])
        # The clause that each document has speaks in one of these, so no text is without a modal.
        assert VERBS[r.doc_id % len(VERBS)] in r.sentence and got[r.doc_id].modals
