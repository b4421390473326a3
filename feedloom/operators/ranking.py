"""Ordering, thresholds and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]
LEAST_ABOVE, MOST_ROWS, DEFAULT_ROWS = 20, 200, 100


def p75(score: str) -> Column:
    """The 75th percentile of scores of 1 or more, rounded half to even; 0 without any."""
    return F.coalesce(F.bround(F.percentile(F.when(F.col(score) >= 1, F.col(score)), F.lit(0.75))), F.lit(0)).cast("int")


def _cut(score: str, least_above: int) -> Transform:
    """One row from one scan: p75, above (rows at or over it), threshold (p75 if positive and enough rows reach it, else
    null) and total (rows at or over the threshold, all without one); no row without rows.

    Rows are counted by score first, so what meets in one task is a row for each score there is, and a score has few
    values; all four numbers come from these counts."""

    def run(df: DataFrame) -> DataFrame:
        counts = df.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n"))
        p75 = F.coalesce(F.bround(F.percentile(F.when(F.col("_s") >= 1, F.col("_s")), F.lit(0.75), F.col("_n"))), F.lit(0)).cast("int")
        one = counts.agg(p75.alias("p75"), F.collect_list(F.struct("_s", "_n")).alias("_c")).filter(F.size("_c") > 0)
        rows = lambda least: F.aggregate(F.filter("_c", lambda x: x["_s"] >= least), F.lit(0).cast("long"), lambda n, x: n + x["_n"])
        every = F.aggregate("_c", F.lit(0).cast("long"), lambda n, x: n + x["_n"])
        told = one.withColumn("above", rows(F.col("p75"))).withColumn("threshold", F.when((F.col("p75") > 0) & (F.col("above") >= least_above), F.col("p75")))
        return told.select("p75", "above", "threshold", F.when(F.col("threshold").isNull(), every).otherwise(rows(F.col("threshold"))).alias("total"))

    return run


def threshold_of(score: str, least_above: int = LEAST_ABOVE) -> Transform:
    """One row: p75, above (rows at or over it), threshold (p75 if positive and enough rows reach it, else null)."""
    return lambda df: df.transform(_cut(score, least_above)).select("p75", "above", "threshold")


#: Columns of a feed's rows; descriptions, vectors and raw data stay behind.
FEED_COLUMNS = ["id", "title", "company", "salary_min", "salary_max", "location", "is_remote", "source_url", "source_name", "sources", "dedup_confidence", "match_score", "match_breakdown", "pipeline_stage", "country", "partial", "discovered_at", "benefits"]


def feed_columns(df: DataFrame) -> DataFrame:
    """The feed's columns of stored rows; those that are missing are an error."""
    return df.select(*FEED_COLUMNS)


def feed(limit: int | None = None, offset: int | None = None, score: str = "match_score", tie: str = "id") -> Transform:
    """The page of rows at or over the threshold by score, nulls first, then by the tie column, with threshold and
    total (of all pages) as columns. Two scans: one for the counts by score, whose one row is broadcast, and one for the
    page, a bounded top-k; select few columns before, since each partition sends a page of rows."""
    rows = min(max(limit or DEFAULT_ROWS, 1), MOST_ROWS)
    skip = max(offset or 0, 0)

    def run(df: DataFrame) -> DataFrame:
        cut = df.transform(_cut(score, LEAST_ABOVE)).select("threshold", "total")
        kept = df.crossJoin(F.broadcast(cut)).filter(F.col("threshold").isNull() | (F.col(score) >= F.col("threshold")))
        return kept.orderBy(F.desc_nulls_first(score), tie).offset(skip).limit(rows)

    return run


def group_counts(column: str, name: str = "n") -> Transform:
    """Rows of each value by count, largest first, then by value; the null group is dropped after counting."""
    return lambda df: df.groupBy(column).agg(F.count("*").alias(name)).filter(F.col(column).isNotNull()).orderBy(F.desc(name), column)


def latest_incomplete(as_of: Column, stale_seconds: int = 300) -> Transform:
    """The latest run without an end, unless it began more than stale_seconds ago."""

    def run(df: DataFrame) -> DataFrame:
        last = df.filter(F.col("completed_at").isNull()).orderBy(F.desc("started_at")).limit(1)
        return last.filter(as_of.cast("double") - F.col("started_at").cast("timestamp").cast("double") <= stale_seconds)

    return run
