"""Each registered query against a brute-force version of its contract, over whole small tables."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from feedloom.llm import queries as Q
from feedloom.llm.tokens import BYTE_BPE, vocabulary_path

REGISTERED = Q.queries()


@pytest.fixture(scope="module")
def table(sf):
    return lambda name, cols: duckdb.sql(f"select {cols} from '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def result(spark, sf):
    return lambda name: [r.asDict() for r in REGISTERED[next(n for n in REGISTERED if n.startswith(name))](spark, sf).collect()]


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


def test_op1(result, table):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in result("op1_")}
    docs = table("documents", "doc_id, text")
    assert len(got) == len(docs)
    for i, text in docs:
        ids = np.array(sp.encode(text), dtype="<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids) // 4, zlib.crc32(ids))
        assert got[i]["decoded_crc32"] == zlib.crc32(sp.decode(sp.encode(text)).encode())


def test_op2(result, table):
    turns = defaultdict(list)
    said = "</s>[INST] ok [/INST]"
    for c, t, role, text in [*table("conversations", "conv_id, turn, role, text"), (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        turns[c].append((t, role or "", text or ""))
    got = {r["conv_id"]: r for r in result("op2_")}
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(x for _, role, x in rows if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in rows).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(x) for _, _, x in rows)


def test_op3(result, table):
    got = {r["doc_id"]: r for r in result("op3_")}
    docs = table("documents", "doc_id, text")
    assert len(got) == len(docs)
    for i, text in docs:
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {k for j, w in enumerate(windows) if counts[w] > 1 for k in (j, j + 1, j + 2)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    labels = table("labels", "doc_id, quality")
    good = [got[i]["kept"] or got[i]["base_failed"] for i, q in labels if q]
    junk = [got[i]["kept"] for i, q in labels if not q]
    assert np.mean(good) > 0.99 and np.mean(junk) < 0.1


def test_op4(result, table):
    docs = [(i, (t or "").encode().split()) for i, t in table("documents", "doc_id, text")]
    first = {}
    for i, words in docs:
        for j in range(len(words) - 12):
            w = tuple(words[j : j + 13])
            first[w] = min(first.get(w, i), i)
    got = {r["doc_id"]: r for r in result("op4_")}
    assert len(got) == len(docs)
    lost = 0
    for i, words in docs:
        gone = {k for j in range(len(words) - 12) if first[tuple(words[j : j + 13])] < i for k in range(j, j + 13)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(words), len(gone), hashlib.sha256(kept).hexdigest())
        lost += bool(gone)
    assert lost > 20


def test_op5(result, table, ids_of):
    docs = {i: ids_of(t) for i, t in table("documents", "doc_id, text")}
    pieces, seen = defaultdict(list), defaultdict(list)
    for r in result("op5_"):
        pieces[r["doc_id"]].append(r)
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys()
    for i, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(docs[i]) // 4
            assert r["ids_crc32"] == zlib.crc32(docs[i][4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(docs[i]) // 4
    for placed in seen.values():
        assert placed == [(0, placed[0][1])] and placed[0][1] in {1 << k for k in range(11)}


def test_op6(result, table, ids_of):
    got, start = {r["doc_id"]: r for r in result("op6_")}, 0
    docs = sorted(table("documents", "doc_id, text"))
    assert len(got) == len(docs)
    for i, t in docs:
        ids = ids_of(t)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_op7(result, table):
    docs = sorted((i, (t or "").encode()) for i, t in table("documents", "doc_id, text"))
    got = {r["doc_id"]: r for r in result("op7_")}
    total, before, slots = sum(len(t) + 8 for _, t in docs), 0, Counter()
    for i, t in docs:
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        assert (r["shard"], r["slot"]) == (before * 24 // total, slots[before * 24 // total])
        slots[r["shard"]] += 1
        before += r["size"]
    assert sorted(slots) == list(range(24))


def test_op8(result, table):
    docs = table("documents", "doc_id, text")
    fps = {}
    for i, t in docs:
        words = t.encode().lower().split()
        k = min(3, len(words))
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + k]), 42) for j in range(len(words) - k + 1)] if words else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in result("op8_")}
    assert got.keys() == fps.keys()
    for i in fps:
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fps[i]:016x}", find(i))


def test_op9(result, table):
    rows = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in table("embeddings", "vec_id, embedding")]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.int64)
    want = set()
    for i, v in rows:
        if i % 100 == 0:
            scores = vectors @ np.array(v)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:10]
            want |= {(i, rank, int(ids[j]), int(scores[j])) for rank, j in enumerate(order, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result("op9_")} == want


def test_op10(result, table):
    pages = table("pages", "page_id, html")
    first = {}
    for i, h in pages:
        first[h] = min(first.get(h, i), i)
    got = {r["page_id"]: r for r in result("op10_")}
    assert len(got) == len(pages)
    for i, h in pages:
        data, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h] == i else ("revisit", first[h]))
