"""Simple-8b word-aligned coding of token ids, and a file format of blocks with offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import fresh_path, shared_dir, sliced
from feedloom.llm.tokens import encoder, with_end

#: Fixed values of the format: selector s packs COUNTS[s] ids of BITS[s] bits in the 60 bits below it; the last selector
#: is the escape, whose whole next word is one id of up to 64 bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
#: Ids in a full block; a block is decoded by itself.
BLOCK_IDS = 1 << 16
MAGIC = b"S8B1"


#: The bits of the narrowest packed selector that holds an id of so many bits; 255 if none does.
_WIDTH_OF = np.array([min((int(c) for c in BITS[:ESCAPE] if c >= b), default=255) for b in range(66)], dtype=np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that a packed selector needs for each id; 255 for those over 30 bits."""
    return _WIDTH_OF[np.frexp(ids.astype(np.float64))[1]]  # below 2**53 the exponent is the length in bits


def _widest(width: np.ndarray, n: int) -> np.ndarray:
    """The largest width of the n ids from each place on; past the end nothing fits."""
    out, done = width, 1
    while done < n:
        step = min(done, n - done)
        out = np.maximum(out, np.append(out[step:], np.full(min(step, len(out)), 255, dtype=np.uint8)))
        done += step
    return out


def encode_words(ids: np.ndarray) -> np.ndarray:
    """64-bit words holding ids. Selectors 0-1 hold runs of zeros, 2-14 packed ids, 15 escapes one id over 30 bits.

    A selector fits where the widest of as many ids from there on is no wider than its bits; the first that fits at a
    place packs most, so it is taken."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, dtype="<u8")
    width = _widths(ids)
    which = np.full(n, ESCAPE, dtype=np.uint8)
    for s in range(ESCAPE):
        wide = _widest(width, int(COUNTS[s])) > BITS[s].astype(np.uint8)
        np.minimum(which, wide * np.uint8(ESCAPE) + np.uint8(s), out=which)
    jump = COUNTS.astype(np.uint8)[which]
    # A tail too short for any full word is filled up with zeros; the id count in the block's header ends it.
    filled = np.append(ids, np.zeros(COUNTS[2], dtype=np.uint64))
    for i in range(n - 1, max(-1, n - 1 - COUNTS[2]), -1):
        if which[i] == ESCAPE:
            most = int(ids[i:].max())
            s = next((s for s in range(2, ESCAPE) if n - i <= COUNTS[s] and most < 1 << int(BITS[s])), ESCAPE)
            if s != ESCAPE:
                jump[i], which[i] = n - i, s
    steps, starts, here = jump.tolist(), [], 0
    while here < n:
        starts.append(here)
        here += steps[here]
    first = np.array(starts)
    chosen = which[first]
    escaped = chosen == ESCAPE
    place = np.arange(len(first)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(first) + int(escaped.sum()), dtype=np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    words[place[escaped] + 1] = ids[first[escaped]]
    for s in range(2, ESCAPE):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            # Beyond a tail's end lie zeros; a full word holds ids of its own only.
            packed = filled[first[mine]]
            for j in range(1, int(COUNTS[s])):
                packed |= filled[first[mine] + j] << np.uint64(j * int(BITS[s]))
            words[place[mine]] |= packed
    return words.astype("<u8")


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids in the words, a selector at a time."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # A word after an escape is data. Escapes in a row of words that look like escapes alternate from the first.
    looks = selector == ESCAPE
    data = np.zeros(len(words), dtype=bool)
    if looks.any():
        here, marks = -1, np.flatnonzero(looks).tolist()
        for m in marks:
            if m != here:
                here = m + 1
                if here < len(words):
                    data[here] = True
    heads = np.flatnonzero(~data)
    counts = COUNTS[selector[heads]]
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s in range(2, ESCAPE):
        mine = np.flatnonzero(selector[heads] == s)
        if len(mine):
            word, mask = words[heads[mine]], np.uint64((1 << int(BITS[s])) - 1)
            for j in range(int(COUNTS[s])):
                out[begins[mine] + j] = (word >> np.uint64(j * int(BITS[s]))) & mask
    mine = np.flatnonzero(selector[heads] == ESCAPE)
    out[begins[mine]] = words[heads[mine] + 1]
    return out[:n]


def encode_block(docs: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: magic, number of documents, ids and words; doc ids; the end of each document in ids; words; CRC-32."""
    words = encode_words(ids)
    nulls = np.array([d is None for d in docs], dtype=np.uint8)
    body = MAGIC + struct.pack("<qqq", len(docs), len(ids), len(words)) + np.array([d or 0 for d in docs], dtype="<i8").tobytes() + nulls.tobytes() + ends.astype("<i8").tobytes() + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ends, token ids) of a block."""
    body = block[:-4]
    if body[:4] != MAGIC or struct.unpack("<I", block[-4:])[0] != zlib.crc32(body):
        raise ValueError("damaged block")
    docs, n, words = struct.unpack_from("<qqq", body, 4)
    at = 28
    ids = np.frombuffer(body, "<i8", docs, at)
    nulls = np.frombuffer(body, np.uint8, docs, at + 8 * docs)
    ends = np.frombuffer(body, "<i8", docs, at + 9 * docs)
    return [None if z else d for d, z in zip(ids.tolist(), nulls.tolist(), strict=True)], ends, decode_words(np.frombuffer(body, "<u8", words, at + 17 * docs), n)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes token files at path: parts in ascending id order, blocks in order in each, and an index of what precedes.

    Rows are range-partitioned by id and sorted, each with its encoded ids, end id last. A part's rows are (part, block,
    first id of the block in its part, data); Spark's writer stores them, so that any store it can write will do.
    path/index holds one row for each part: ids before it, from a prefix sum over the parts' totals.
    Null texts count as empty, null ids come first, repeated ids stay apart, an empty table gives an index with no rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_column
        docs: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        number = before = size = 0
        part = None

        def block() -> pa.RecordBatch:
            nonlocal number, before, size
            data = encode_block(docs, np.cumsum(sizes), np.concatenate(held))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "before", "n_ids", "data"])
            number, before, size = number + 1, before + size, 0
            for x in (docs, sizes, held):
                x.clear()
            return out

        for batch in sliced(batches, "_text", 8 << 20):
            part = batch.column(2)[0].as_py()
            ids, ends = with_end(*encode(batch.column(1)), end_id)
            begin = 0
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                docs.append(doc)
                sizes.append(end - begin)
                held.append(ids[begin:end])
                begin, size = end, size + end - begin
                if size >= BLOCK_IDS:
                    yield block()
            held = [x.copy() for x in held]
        if docs:
            yield block()

    # A row's number behind its id, so that rows of a common id, or without one, are dealt over parts as well.
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange("_id", "_row").sortWithinPartitions("_id", "_row").select("_id", "_text", F.spark_partition_id().alias("_part"))
    dealt.mapInArrow(run, "part int, block long, before long, n_ids long, data binary").write.option("compression", "none").parquet(f"{path}/data")
    totals = spark.read.parquet(f"{path}/data").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("ids_before"), "n_ids").write.parquet(f"{path}/index")


def read_tokens(spark, path: str, *, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start (ids of all documents before it), n_tokens, ids, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, begin in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                docs, ends, ids = decode_block(data.as_py())
                raw, starts = ids.astype("<u4").tobytes(), np.append(0, ends[:-1])
                each = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + begin), pa.array(ends - starts), pa.array(each if with_ids else [None] * len(each), pa.binary()), pa.array([zlib.crc32(x) for x in each], pa.int64())],
                    ["_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    index = F.broadcast(spark.read.parquet(f"{path}/index").select("part", "ids_before"))
    blocks = spark.read.parquet(f"{path}/data").join(index, "part").select("data", (F.col("ids_before") + F.col("before")).alias("begin"))
    return blocks.mapInArrow(run, "_id long, start long, n_tokens long, ids binary, ids_crc32 long").withColumnRenamed("_id", id_col)


def stored_tokens(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """The documents written as token files in the shared folder and read back, without the ids themselves."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path, **options)
    return read_tokens(docs.sparkSession, path, with_ids=False, id_col=options.get("id_col", "doc_id"))
