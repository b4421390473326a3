"""Texts with an added token's content have the library's ids, by its default call."""

import zlib

import numpy as np

from feedloom.llm import packing, simple8b
from feedloom.llm.tokens import BYTE_BPE, PieceEncoder, vocabulary_path

BPE = vocabulary_path(BYTE_BPE)
TEXTS = ["plain text", "a <|endoftext|> b", "", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n  y", "<|endof text|>", "\t<|endoftext|>\u00a0z", "the last one", "<|endoftext|", "|>"]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_encoder():
    assert 50256 in library_ids(TEXTS[1])
    got = PieceEncoder(BPE).encode(TEXTS)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [library_ids(t) for t in TEXTS]


def test_operators(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = [np.array([*library_ids(t), 0], dtype="<u4") for t in TEXTS]
    simple8b.write_tokens(docs, BPE, str(tmp_path / "a"))
    got = sorted(simple8b.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r["doc_id"])
    starts = np.cumsum([0, *map(len, ids[:-1])]).tolist()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(s, len(x), zlib.crc32(x.tobytes())) for s, x in zip(starts, ids, strict=True)]
    for r in packing.pack(docs, BPE, longest=64).collect():
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()))
