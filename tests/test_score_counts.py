"""Counts kept by deltas give the thresholds, totals and counts of the rows themselves."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from feedloom.operators import filters, ranking
from feedloom.operators.score_counts import ScoreCounts, changed, inserted

SCHEMA = "id long, country string, score int, is_dismissed boolean"


def test_deltas(spark, tmp_path):
    rng = random.Random(2)
    rows = {i: (i, rng.choice(["US", "DE", None]), rng.choice([None, *range(0, 101, 7)]), rng.random() < 0.2) for i in range(300)}
    frame = lambda x: spark.createDataFrame(list(x), SCHEMA)
    kept = ScoreCounts(spark, f"{tmp_path}/counts")
    assert kept.newest() == 0 and kept.threshold().count() == 0
    kept.apply(inserted(frame(rows.values())))
    for _ in range(2):
        new = {i: (i, rng.choice(["US", "DE"]), rng.randrange(101), rng.random() < 0.5) for i in rng.sample(range(330), 60)}
        kept.apply(changed(frame(rows.values()), frame(new.values()), "id"))
        rows |= new
    shown = frame(rows.values()).transform(filters.not_dismissed)
    for wanted in ("all", "DE", None):
        some = shown.transform(filters.in_countries(wanted))
        want = some.transform(ranking.threshold_of("score")).first()
        got = kept.threshold(wanted).first()
        assert (got["p75"], got["above"], got["threshold"]) == tuple(want)
        assert got["total"] == some.filter(F.lit(want["threshold"] is None) | (F.col("score") >= F.lit(want["threshold"]))).count()
    assert [tuple(r) for r in kept.countries().collect()] == [tuple(r) for r in shown.transform(ranking.group_counts("country")).collect()]
    assert kept.newest() == 3
    with pytest.raises(AnalysisException):  # another writer from an older version
        kept.apply(inserted(frame([(1, "US", 1, False)])), version=1)
