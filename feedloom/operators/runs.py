"""Run status, counters, errors and source health, folded from event rows instead of read and written in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def counters(key: str, kind: str, kinds: list[str]) -> Transform:
    """One row for each key with the number of events of each kind; absent kinds are 0."""
    return lambda df: df.groupBy(key).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds))


STALE_SECONDS = 900


def status(as_of: Column, started: str = "started_at", completed: str = "completed_at", attempted: str = "sources_attempted", succeeded: str = "sources_succeeded", failed: str = "sources_failed", stale_seconds: int = STALE_SECONDS) -> Transform:
    """fetching, scoring (all sources done), completed or failed; an unfinished run past stale_seconds counts as ended,
    completed if any source succeeded; an ended one failed if none did and some failed. Null counts are 0."""

    def run(df: DataFrame) -> DataFrame:
        n = {c: F.coalesce(F.col(c), F.lit(0)) for c in (attempted, succeeded, failed)}
        done = n[succeeded] + n[failed]
        stale = as_of.cast("double") - F.col(started).cast("timestamp").cast("double") > stale_seconds
        running = F.when(stale, F.when(n[succeeded] > 0, "completed").otherwise("failed")).when((n[attempted] > 0) & (done >= n[attempted]), "scoring").otherwise("fetching")
        ended = F.when((n[succeeded] == 0) & (n[failed] > 0), "failed").otherwise("completed")
        return df.withColumns({"status": F.when(F.col(completed).isNull(), running).otherwise(ended), "sources_completed": done, "sources_total": n[attempted]})

    return run


def health(source: str, order: list[str], failed: str) -> Transform:
    """For each source: error_count, consecutive_errors (failures since the last success), health_status. A failure's
    order is compared with the last success by a map-side combined maximum, so no source's rows are sorted in a task."""

    def run(df: DataFrame) -> DataFrame:
        at = F.struct(*order)
        last = df.groupBy(source).agg(F.max(F.when(~F.col(failed), at)).alias("_ok"), F.count_if(failed).alias("error_count"))
        since = df.filter(F.col(failed)).join(last.select(source, "_ok"), source).filter(F.col("_ok").isNull() | (at > F.col("_ok")))
        run_length = since.groupBy(source).agg(F.count("*").alias("consecutive_errors"))
        n = F.coalesce("consecutive_errors", F.lit(0))
        return last.join(run_length, source, "left").select(source, "error_count", n.alias("consecutive_errors"), F.when(n > 0, "error").otherwise("healthy").alias("health_status"))

    return run


def appended(key: str, order: list[str], item: str, name: str) -> Transform:
    """The items of each key as an array in order; nulls are left out."""

    def run(df: DataFrame) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.when(F.col(item).isNotNull(), F.struct(*order, item))))
        return df.groupBy(key).agg(F.transform(rows, lambda x: x[item]).alias(name))

    return run


def last_errors(source: str, order: list[str], failed: str, message: str) -> Transform:
    """For each source: last_error and last_error_at, which later successes keep, and last_fetch_at, the last success."""
    bad = lambda c: F.when(F.col(failed), c)
    at = F.col(order[0])
    return lambda df: df.groupBy(source).agg(F.max_by(message, bad(F.struct(*order))).alias("last_error"), F.max(bad(at)).alias("last_error_at"), F.max(F.when(~F.col(failed), at)).alias("last_fetch_at"))
