"""Substring search over stored text by an inverted index of trigrams, with the exact rule checked on what it finds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators import filters

#: Folders of the index by a hash of the trigram; a search reads those of its own trigrams alone.
BUCKETS = 256
#: Characters of text of which a task gathers the ids of each trigram before it gives them out.
BATCH_CHARS = 8 << 20
#: Trigrams of a pattern that are looked up, the rarest ones.
LOOKED_UP = 4

_POSTINGS = "bucket int, trigram string, n int, ids binary"
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def packed(ids: list[int]) -> bytes:
    """Ids in order as the first one and the gaps, in the fewest bytes that hold every gap; the first byte tells how many."""
    a = np.sort(np.array(ids, dtype=np.int64))
    gaps = np.diff(a).view(np.uint64)
    width = next(i for i, w in enumerate(_WIDTHS) if not len(gaps) or gaps.max() <= np.iinfo(w).max)
    return bytes([width]) + a[:1].tobytes() + gaps.astype(_WIDTHS[width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    first, gaps = np.frombuffer(data, np.int64, 1, 1), np.frombuffer(data, _WIDTHS[data[0]], -1, 9)
    return np.cumsum(np.concatenate([first, gaps.astype(np.int64)]))


def trigrams_of(pattern: str) -> set[str]:
    """Trigrams that any text must hold, in lower case, to match an ILIKE pattern: those of its runs between % and _, a
    backslash taking the next character as it is. Trigrams with other than ASCII characters are left out, since how these
    are lower-cased is the engine's matter; a search is only wider without them."""
    runs, escaped = [""], False
    for c in pattern:
        if not escaped and c == "\\":
            escaped = True
        elif not escaped and c in "%_":
            runs.append("")
        else:
            runs[-1], escaped = runs[-1] + c, False
    found = {run[i : i + 3].lower() for run in runs for i in range(len(run) - 2)}
    return {t for t in found if t.isascii()}


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each trigram, gathered over a bounded amount of text."""
    held: dict[str, list[int]] = {}
    chars = 0

    def out() -> pa.RecordBatch:
        each = sorted(held)
        ids = [held[t] for t in each]
        return pa.RecordBatch.from_arrays([pa.array(each, pa.string()), pa.array([len(x) for x in ids], pa.int32()), pa.array([packed(x) for x in ids], pa.binary())], names=["trigram", "n", "ids"])

    for batch in batches:
        for key, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for t in {text[i : i + 3] for text in texts if text for i in range(len(text) - 2)}:
                held.setdefault(t, []).append(key)
            chars += sum(len(text or "") for text in texts)
            if chars >= BATCH_CHARS:
                yield out()
                held.clear()
                chars = 0
    if held:
        yield out()


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for trigram, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = unpacked(data)
            yield pa.RecordBatch.from_arrays([pa.array([trigram] * len(ids), pa.string()), pa.array(ids, pa.int64())], names=["trigram", "_id"])


class TrigramIndex:
    """An index below a path of columns of rows with a key.

    It grows by appending: add() takes new rows, sync() finds those whose texts it has not seen, so work follows what is new. What a row once held
    stays listed, so an index only ever finds too much, and search() checks the rule itself on the rows given to it."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], key: str = "id") -> None:
        self.spark, self.path, self.columns, self.key = spark, path, columns, key

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _own(self, rows: DataFrame) -> DataFrame:
        texts = F.array(*(F.lower(c) for c in self.columns))
        return rows.select(F.col(self.key).cast("long").alias("_id"), texts.alias("_texts")).filter("_id is not null").withColumn("_digest", F.xxhash64("_texts"))

    def _append(self, own: DataFrame) -> None:
        found = own.select("_id", "_texts").mapInArrow(_postings, "trigram string, n int, ids binary")
        dealt = found.withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int"))
        dealt.repartition("bucket").sortWithinPartitions("bucket", "trigram").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        own.select("_id", "_digest").write.mode("append").parquet(f"{self.path}/ledger")

    def add(self, rows: DataFrame) -> None:
        """Adds rows that are known to be new, as those of an ingested batch; nothing is compared. Rows without a key are
        never found."""
        self._append(self._own(rows))

    def sync(self, rows: DataFrame) -> None:
        """Adds those of the rows that are new or have other texts. The ledger of what was added is written last: a job that
        fails in between is made good by the next one."""
        self._append(self._own(rows).join(self._read("ledger", "_id long, _digest long"), ["_id", "_digest"], "left_anti"))

    def _ids(self, trigrams: set[str]) -> DataFrame | None:
        """The ids that have all of the rarest trigrams; None if one of them is nowhere."""
        buckets = self.spark.createDataFrame([(t,) for t in sorted(trigrams)], "trigram string").select("trigram", F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int").alias("bucket")).collect()
        bucket = {r["trigram"]: r["bucket"] for r in buckets}
        postings = self._read("postings", _POSTINGS)
        of = lambda some: postings.filter(F.col("bucket").isin(sorted({bucket[t] for t in some})) & F.col("trigram").isin(sorted(some)))
        sizes = {r["trigram"]: r["n"] for r in of(trigrams).groupBy("trigram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(trigrams):
            return None
        rarest = set(sorted(sizes, key=lambda t: (sizes[t], t))[:LOOKED_UP])
        each = of(rarest).select("trigram", "ids").mapInArrow(_listed, "trigram string, _id long").distinct()
        return each.groupBy("_id").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(rarest)).select("_id")

    def search(self, rows: DataFrame, query: str | None) -> DataFrame:
        """The rows of which a column holds the query, by the rule of filters.contains_text(): any case, % and _ as
        wildcards, a blank or over-long query filters nothing. The index must have the rows. Of a query with trigrams, the
        folders of these are read, ids that have all of the rarest are joined with the rows, and the rule is checked on those;
        one without, as of fewer than three characters between wildcards, is a scan."""
        check = filters.contains_text(query, self.columns)
        text = (query or "").strip()
        trigrams = trigrams_of(text) if len(text) <= filters.LONGEST_QUERY else set()
        if not trigrams:
            return rows.transform(check)
        ids = self._ids(trigrams)
        if ids is None:
            return rows.filter(F.lit(False))
        return rows.join(ids.withColumnRenamed("_id", self.key), self.key, "left_semi").transform(check)
