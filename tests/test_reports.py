from lexigrid.plans import reports
from lexigrid.plans.session import Session
from lexigrid.streaming import events


def test_labels_are_matched_once(spark):
    df = spark.createDataFrame([(1, ["Org: Employer", "Ind: Worker"], ["Ind: Employer", "Spc: Worker class"]), (2, ["A"], None), (3, None, ["B"])], "id int, g array<string>, f array<string>")
    got = [tuple(r) for r in reports.match_labels(df, "id", "g", "f").collect()]
    assert got == [(1, "Org: Employer", "Ind: Employer"), (1, "Ind: Worker", "Spc: Worker class"), (2, "A", None)]


def test_classes_and_confidence(spark):
    df = spark.createDataFrame([(["Duty", "Right", "Rule"], "he shall act"), ([], "a"), (["Duty"], "he is punishable"), (["Duty"], "he must not; it is an offence")], "x array<string>, t string")
    assert [r[0] for r in df.select(reports.three_classes("x", "t")).collect()] == [["Obligation", "Liberty", "Rule"], [], [], ["Obligation"]]
    rows = spark.createDataFrame([(True, True), (True, False), (False, True)], "d boolean, a boolean")
    assert [r[0] for r in rows.select(reports.provision_confidence("d", "a")).collect()] == [0.9, 0.8, 0.3]


def test_anomalies(spark):
    rows = [("L1", ["Enactment+Citation+Commencement"], False)] * 2 + [("L1", ["Offence"], False)] * 9 + [("L2", ["Offence"], True)] * 11
    got = reports.purpose_anomalies(spark.createDataFrame(rows, "law string, p array<string>, d boolean"), "law", "p", "d").collect()
    assert sorted(tuple(r) for r in got) == [("L1", "no duties"), ("L1", "share: Enactment+Citation+Commencement")]


def test_sessions_are_audited(spark):
    s = Session(spark, "/root/testdata/sf0.001", ("region",))
    assert s.query("SELECT count(*) AS n FROM region WHERE r_regionkey > :least", least=2).first().n == 2
    spark.range(2).write.mode("overwrite").saveAsTable("session_rows")
    assert s.insert("session_rows", spark.range(3)) == 3 and spark.table("session_rows").count() == 5
    log = s.audit()
    assert [r.action for r in log.orderBy("entry_id").collect()] == ["query", "insert"]
    assert events.broken(log, "entry_id", ["entry_id", "at", "action", "detail", "n_rows"]).count() == 0
    spark.sql("DROP TABLE session_rows")
