"""Skills as a column: the automaton finds what the pattern rule finds."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators import skills

SKILL = st.one_of(st.none(), st.sampled_from(["Go", "go", "R", "C++", "c#", " SQL ", "Java", "JavaScript", "node.js", "", " ", "machine learning", "É", "_x", "ab"]), st.text("abAB+ ", max_size=4))
TEXT = st.one_of(st.none(), st.lists(st.sampled_from(["Go", "go", "r", "R,", "C++", "c#", "sql", "java", "javascript.", "Node.JS", "Machine  Learning", "machine learning", "é", "_x", "ab1", "AB", " ", "\n"]), max_size=12).map(" ".join))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TEXT, st.one_of(st.none(), st.lists(SKILL, max_size=8))), min_size=40, max_size=80))
def test_same_as_the_rule(spark, rows):
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, (t, s) in enumerate(rows)], "id int, text string, own array<string>, `_text` string, `a b` int")
    want = df.select("id", X.skill_matches(F.col("text"), F.col("own")).alias("m")).collect()
    got = skills.with_named(df, "text", "own", "m")
    assert got.columns == [*df.columns, "m"]
    assert {r["id"]: r["m"] for r in got.collect()} == {r["id"]: r["m"] for r in want}


def test_empty(spark):
    assert skills.with_named(spark.createDataFrame([], "text string, own array<string>"), "text", "own", "m").count() == 0
