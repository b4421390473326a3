"""Packing by power-of-two decomposition: pieces of binary lengths, so that no sequence crosses documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import sliced
from feedloom.llm.tokens import encoder, with_end

PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as a sum of powers of two, largest first, none over longest (itself a power of two)."""
    return [longest] * (n // longest) + [1 << i for i in range(longest.bit_length() - 2, -1, -1) if n % longest >> i & 1]


def pack(docs: DataFrame, vocabulary: str, *, longest: int = 1024, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32 bits), ids_crc32, doc_tokens, bucket, sequence_id, offset.

    A document's ids and its end id are cut into lengths that are powers of two, at most `longest`. Each piece is a
    sequence by itself: it holds no padding, crosses no document, and shares a bucket (log2 of its length) with all of
    its length, from which batches are drawn. So there is no bin to search, no shuffle, and no state across documents.
    sequence_id is unique (partition and row); offset is always 0. Null or empty texts give one piece of the end id;
    repeated rows give repeated pieces with sequences of their own; null ids stay null; other columns are not read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = with_end(*encoder(vocabulary).encode_column(batch.column(1)), end_id)
        data, begin = memoryview(ids.tobytes()), 0
        rows: list[tuple] = []
        for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
            total, start = end - begin, 0
            for length in binary_lengths(total, longest):
                piece = data[4 * (begin + start) : 4 * (begin + start + length)]
                rows.append((doc, start, length, bytes(piece) if with_ids else None, zlib.crc32(piece), total))
                start += length
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text", 4 << 20):
            yield pieces(batch)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, PIECES).select(
        F.col("doc_id").alias(id_col), "start", "length", "ids", "ids_crc32", "doc_tokens",
        F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


NAMES = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, one folder for each length, so that a reader draws batches of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
