from feedloom.operators import merging

COLS = "id long, fingerprint string, company string, title string, location string, salary_min long, salary_max long"


def test_dispositions(spark):
    stored = spark.createDataFrame([(1, "f1", "Acme", "Dev", "Rome", 100, 150), (2, "f2", "Acme", "Ops", "Rome", None, None), (3, "f3", None, None, None, None, None)], COLS)
    incoming = spark.createDataFrame([(10, "f1", "ACME", "dev", "rome", 100, 150), (11, "zz", "acme", "QA", "Rome", None, None), (12, "zz", "Other", "None", "Oslo", None, None), (13, None, None, None, None, None, None), (14, "f1", "Acme", "Dev", "Rome", 900, 950)], COLS)
    got = {r.in_id: (r.disposition, r.cand_id) for r in merging.fingerprint_merges(incoming, stored).collect()}
    assert got == {10: ("merged", 1), 11: ("similar", 1), 12: ("new", None), 13: ("new", None), 14: ("similar", 1)}


def test_common_values_stay_linear(spark):
    from pyspark.sql import functions as F

    a = spark.range(200).select(F.col("id").alias("in_id"), F.lit("unknown").alias("c"))
    b = spark.range(200).select(F.col("id").alias("cand_id"), F.lit("unknown").alias("d"))
    assert merging.or_candidates(a, b, [(F.col("c"), F.col("d"))], "in_id", "cand_id", 50).count() == 200 * 50


def test_absent_and_closed(spark):
    stored = spark.createDataFrame([("s", "1", None), ("s", "2", "2024"), ("t", "1", None), ("u", "1", None)], "source_name string, external_id string, closed_at string")
    fresh = spark.createDataFrame([("s", "2", None), ("s", "3", None), ("t", "1", None)], stored.schema)
    known = merging.unknown_listings(stored)(fresh).collect()
    assert sorted((r.source_name, r.external_id) for r in known) == [("s", "2"), ("s", "3")]
    complete = spark.createDataFrame([("s",), ("u",)], "source_name string")
    assert [(r.source_name, r.external_id) for r in merging.to_close(fresh, complete)(stored).collect()] == [("s", "1")]


def test_vectors_choose_candidates(spark):
    cols = COLS + ", embedding array<float>"
    stored = spark.createDataFrame([(1, "f1", "Acme", "Dev", "Rome", None, None, [1.0, 0.0]), (2, "f2", "Acme", "Dev", "Rome", None, None, [0.0, 1.0]), (3, "f3", "Acme", "Dev", None, None, None, None), (4, "f4", "x", "y", None, None, None, [1.0, 0.0, 0.0])], cols)
    incoming = spark.createDataFrame([(10, "f2", "acme", "dev", "rome", None, None, [0.1, 1.0]), (11, "f3", "acme", "dev", None, None, None, [-1.0, 0.0]), (12, "f3", "acme", "z", None, None, None, None), (13, "f9", "q", "q", None, None, None, [0.0, 0.0])], cols)
    got = {r.in_id: (r.disposition, r.cand_id) for r in merging.fingerprint_merges(incoming, stored).collect()}
    assert got == {10: ("merged", 2), 11: ("new", None), 12: ("merged", 3), 13: ("new", None)}
    assert merging.fingerprint_merges(incoming.limit(0), stored).count() == 0
    assert {r.disposition for r in merging.fingerprint_merges(incoming, stored.limit(0)).collect()} == {"new"}


def test_refreshed_appends_own_attribution(spark):
    kind = "source_name string, external_id string, salary_min long, closed_at string, match_score long, sources array<struct<name:string,external_id:string,url:string>>"
    stored = spark.createDataFrame([("s", "1", None, "2024", 1, None), ("s", "2", 5, None, None, [("s", "2", "u")]), ("s", "3", 5, None, 1, None)], kind)
    incoming = spark.createDataFrame([("s", "1", 7, 1), ("s", "1", 8, 2), ("s", "2", 9, 3)], "source_name string, external_id string, salary_min long, position long")
    got = {r.external_id: r for r in merging.refreshed(stored, incoming, "position", columns=["salary_min"]).collect()}
    assert (got["1"].salary_min, got["1"].closed_at, [tuple(x) for x in got["1"].sources]) == (7, None, [("s", "1", None)])
    assert (got["2"].salary_min, got["2"]._needs_score, [tuple(x) for x in got["2"].sources]) == (5, True, [("s", "2", "u")])
    assert got["3"].sources is None and not got["3"]._needs_score
