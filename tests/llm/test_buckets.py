"""Packed sequences written by length, read back bucket by bucket."""

import numpy as np

from feedloom.llm import packing
from feedloom.llm.tokens import BYTE_BPE, vocabulary_path


def test_buckets_hold_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a short text"), (2, " ".join(f"w{i}" for i in range(300))), (3, None), (2, "a short text")], "doc_id long, text string")
    packed = packing.pack(docs, vocabulary_path(BYTE_BPE), longest=64)
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    rows = back.collect()
    assert len(rows) == packed.count() and {r.bucket for r in rows} >= {0, 6}
    for r in rows:
        assert r.length == 1 << r.bucket == len(np.frombuffer(r.ids, dtype="<u4"))
