"""Counts of listings by country and score, kept up to date by deltas, from which thresholds and totals are read."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.filters import in_countries
from feedloom.operators.ranking import LEAST_ABOVE

STATE = ["country", "score", "is_dismissed"]


def inserted(rows: DataFrame) -> DataFrame:
    """New rows (country, score, is_dismissed) as changes from nothing."""
    return rows.select(F.lit(None).cast(f"struct<country:string,score:{rows.schema['score'].dataType.simpleString()},is_dismissed:boolean>").alias("before"), F.struct(*STATE).alias("after"))


def changed(stored: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of delta, the new state of a key, as changes of the stored row of that key or, without one, of nothing. Both have
    the key once."""
    old = stored.select(key, F.struct(*STATE).alias("before"))
    return delta.select(key, F.struct(*STATE).alias("after")).join(old, key, "left").select("before", "after")


class ScoreCounts:
    """Versions of (country, score, n) of rows that are not dismissed, one folder each. Reading takes the newest one, which
    has a row for each country and score there is; scores are whole numbers of a small range, so it stays small however
    many listings there are."""

    def __init__(self, spark: SparkSession, path: str, score_type: str = "int") -> None:
        self.spark, self.path, self.score_type = spark, path, score_type

    def counts(self, version: int) -> DataFrame:
        schema = f"country string, score {self.score_type}, n long"
        if version == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/version={version}")

    def newest(self) -> int:
        """The last version; 0 before the first. A version is one file, which appears when it is whole."""
        try:
            files = self.spark.read.schema("n long").parquet(self.path).inputFiles()
        except AnalysisException:
            return 0
        return max((int(v) for f in files for v in re.findall(r"/version=(\d+)/", f)[-1:]), default=0)

    def apply(self, changes: DataFrame, version: int | None = None) -> int:
        """Writes the next version: the given one (the newest unless named), less what rows counted before and plus what they
        count after. Work follows the changes, which are summed within each task first. A version is never written twice:
        of two writers from the same one the second fails and applies its changes to the newer one."""
        version = self.newest() if version is None else version
        of = lambda state, n: F.when(state.isNotNull() & ~F.coalesce(state["is_dismissed"], F.lit(False)), F.struct(state["country"].alias("country"), state["score"].cast(self.score_type).alias("score"), F.lit(n).cast("long").alias("n")))
        signed = changes.select(F.explode(F.array(of(F.col("before"), -1), of(F.col("after"), 1))).alias("c")).filter("c is not null").select("c.*")
        summed = self.counts(version).unionByName(signed).groupBy("country", "score").agg(F.sum("n").alias("n")).filter("n <> 0")
        summed.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version + 1}")
        return version + 1

    def threshold(self, wanted: str | None = "all", least_above: int = LEAST_ABOVE, version: int | None = None) -> DataFrame:
        """One row: p75 (of scores of 1 or more, rounded half to even, 0 without any), above, threshold and total, as
        ranking.threshold_of() and ranking.feed() have them for the listings of the wanted countries."""
        counts = self.counts(self.newest() if version is None else version).transform(in_countries(wanted))
        scored = F.when(F.col("score") >= 1, F.col("score"))
        one = counts.agg(F.coalesce(F.bround(F.percentile(scored, F.lit(0.75), F.col("n"))), F.lit(0)).cast("int").alias("p75"))
        kept = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
        told = counts.crossJoin(F.broadcast(one)).groupBy("p75").agg(kept(F.col("score") >= F.col("p75")).alias("above"), kept(F.lit(True)).alias("_all"))
        enough: Column = (F.col("p75") > 0) & (F.col("above") >= least_above)
        return told.select("p75", "above", F.when(enough, F.col("p75")).alias("threshold"), F.when(enough, F.col("above")).otherwise(F.col("_all")).alias("total"))

    def countries(self, version: int | None = None) -> DataFrame:
        """(country, n), largest first, then by country; null is dropped."""
        counts = self.counts(self.newest() if version is None else version)
        return counts.filter("country is not null").groupBy("country").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "country")
