"""Counters and health of sources as a stream: state for each source, by event time, equal to the fold over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _columns(kinds: list[str]) -> list[str]:
    return ["error_count", "consecutive_errors", *kinds]


class Health(StatefulProcessor):
    """A source's counts, its last success, and its failures since then.

    Order is that of events, (at, id), not of arrival. Failures that the watermark has passed are a number, since no success
    can come before them any more; only later ones are kept one by one, so state is bounded by what the allowed delay
    holds. A success takes away the failures before it."""

    def __init__(self, kinds: list[str]) -> None:
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        counts = ", ".join(f"k{i} long" for i in range(len(self.kinds)))
        self.totals = handle.getValueState("totals", f"errors long, passed long, ok_at long, ok_id long, {counts}")
        self.recent = handle.getListState("recent", "at long, id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.totals.get() if self.totals.exists() else (0, 0, None, None, *[0] * len(self.kinds))
        errors, passed, ok, counts = known[0], known[1], (known[2], known[3]) if known[2] is not None else None, np.array(known[4:], dtype=np.int64)
        recent = [(r[0], r[1]) for r in self.recent.get()] if self.recent.exists() else []
        for part in rows:
            counts = counts + np.array([int((part["kind"] == k).sum()) for k in self.kinds], dtype=np.int64)
            failed = part["failed"].to_numpy(dtype=bool)
            errors += int(failed.sum())
            order = list(zip(part["at"].tolist(), part["id"].tolist(), strict=True))
            newest = max((o for o, f in zip(order, failed, strict=True) if not f), default=None)
            if newest is not None and (ok is None or newest > ok):
                ok, passed = newest, 0
            recent = [o for o in [*recent, *(o for o, f in zip(order, failed, strict=True) if f)] if ok is None or o > ok]
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        consecutive = passed + len(recent)
        passed += sum(at < watermark for at, _ in recent)
        self.recent.put([o for o in recent if o[0] >= watermark]) if any(o[0] >= watermark for o in recent) else self.recent.clear()
        self.totals.update((errors, passed, *(ok or (None, None)), *counts.tolist()))
        yield pd.DataFrame([(key[0], errors, consecutive, *counts.tolist())], columns=["source", *_columns(self.kinds)])


def health_stream(events: DataFrame, store: str, checkpoint: str, kinds: list[str], delay: str = "1 hour") -> StreamingQuery:
    """Starts a stream over events (source, ts, id, kind, failed) that writes each batch's changed sources to a folder of
    its number, over what a failed try of it left; a restart goes on from the checkpoint.

    Rows later than the delay are dropped, as Spark counts in its progress; with none of these current() equals the fold of
    runs.counters() and runs.health(). A source's rows of one batch go through one task, in parts; what differs is state of
    a few numbers. Null sources are one source; a null kind counts nowhere; a null failed is a success."""
    spark = events.sparkSession
    rows = events.withWatermark("ts", delay).select("source", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("long"), "kind", F.coalesce("failed", F.lit(False)).alias("failed"))
    out = f"source {events.schema['source'].dataType.simpleString()}, " + ", ".join(f"`{c}` long" for c in _columns(kinds))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        folded = rows.groupBy("source").transformWithStateInPandas(Health(kinds), out, "Update", "EventTime")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

        return folded.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def current(spark: object, store: str, source_type: str, kinds: list[str]) -> DataFrame:
    """The newest state of each source, with health_status."""
    schema = f"source {source_type}, " + ", ".join(f"`{c}` long" for c in _columns(kinds)) + ", batch long"
    try:
        rows = spark.read.schema(schema).parquet(store)
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    newest = rows.groupBy("source").agg(F.max_by(F.struct(*_columns(kinds)), "batch").alias("_x")).select("source", "_x.*")
    return newest.withColumn("health_status", F.when(F.col("consecutive_errors") > 0, "error").otherwise("healthy"))
