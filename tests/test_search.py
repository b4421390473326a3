"""The trigram index finds what the rule finds, grows by what is new, and reads few postings."""

import os

import pytest
from pyspark.sql import functions as F

from feedloom.operators import filters, search

SCHEMA = "id long, title string, company string, description_text string, _id string, n int"
COLUMNS = ["title", "company", "description_text"]
ROWS = [(1, "Senior Engineer", "Acme", "Builds 100% reliable pipes"), (2, "Cook", None, "Straße, naïve ÉCLAIR"), (3, None, None, None), (4, "", "", ""), (5, "ab", "c", "abc"), (6, "x" * 5000 + "needle", "Kelvin", "a_b a%b a\\b"), (1, "Senior Engineer", "Acme", "Builds 100% reliable pipes"), (None, "Senior", None, None)]
QUERIES = ["engineer", "ENG", "eng%eer", "s_nior", "100%", "% reliable", "needle", "naïve", "éclair", "stra", "kel", "ab", "abc", "a", "", None, "  cook ", "nothing at all", "_____", "a\\_b", "x" * 201, "x" * 200, "acme%pipes"]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA)


def found(df):
    return sorted((r["id"] is not None, r["id"] or 0) for r in df.collect())


def test_same_as_the_rule(spark, frame, tmp_path):
    index = search.TrigramIndex(spark, f"{tmp_path}/i", COLUMNS)
    index.sync(frame.filter("id < 3"))
    index.sync(frame)
    for q in QUERIES:
        keyed = frame.filter("id is not null")
        assert found(index.search(keyed, q)) == found(keyed.transform(filters.contains_text(q, COLUMNS))), q


def test_only_new_rows_are_added(spark, frame, tmp_path):
    index = search.TrigramIndex(spark, f"{tmp_path}/i", COLUMNS)
    index.sync(frame)
    size = lambda: spark.read.parquet(f"{tmp_path}/i/postings").agg(F.sum("n")).collect()[0][0]
    before = size()
    index.sync(frame)
    assert size() == before
    changed = frame.withColumn("title", F.when(F.col("id") == 2, "Baker").otherwise(F.col("title")))
    index.sync(changed)
    assert before < size() < before + 40
    assert found(index.search(changed, "baker")) == [(True, 2)] and found(index.search(changed, "cook")) == []


def test_empty(spark, frame, tmp_path):
    index = search.TrigramIndex(spark, f"{tmp_path}/i", COLUMNS)
    assert index.search(frame.limit(0), "needle").count() == 0
    index.sync(frame.limit(0))
    assert index.search(frame.limit(0), "needle").count() == 0 and os.path.isdir(f"{tmp_path}/i/ledger")


def test_packed_ids():
    for ids in ([5], [-3, 9, 9], [1, 2, 300], [0, 1 << 40], [-(1 << 62), 1 << 62], list(range(1000))):
        assert search.unpacked(search.packed(ids[::-1])).tolist() == ids


def test_trigrams_of_patterns():
    assert search.trigrams_of("abcd%ef_ghi") == {"abc", "bcd", "ghi"}
    assert search.trigrams_of("a\\%b") == {"a%b"} and search.trigrams_of("aé b") == set() and search.trigrams_of("ab") == set()
