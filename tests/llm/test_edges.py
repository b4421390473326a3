"""Nulls, empty tables, repeated rows, long texts and clashing names, with their defined results."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import chat, covertree, packing, phrases, pieces, quality, sharding, simhash, simple8b, warc
from feedloom.llm.components import connected_components
from feedloom.llm.tokens import BYTE_BPE, vocabulary_path

BPE = vocabulary_path(BYTE_BPE)
WORDS = " ".join(f"w{i}" for i in range(200))
DOCS = [(1, WORDS, "en"), (2, None, None), (3, "", "en"), (4, WORDS, "en"), (4, WORDS, "en"), (None, WORDS, "fr"), (5, "x" * 100_000, "zz"), (6, " \t\n a  b ", "en")]
SCHEMA = "doc_id long, text string, lang string, size string, `Shard` string, _id string, band int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "s", "t", "u", 1) for d in DOCS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))


def test_pieces(docs, none):
    got = by_id(pieces.decode(pieces.encode(docs)))
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert [r["decoded"] for r in got] == [WORDS, WORDS, "", "", WORDS, WORDS, "x" * 100_000, " \t\n a  b "]
    assert pieces.encode(none).count() == 0


def test_quality(docs, none):
    got = by_id(quality.with_quality(docs, quality.LABELLED_BANDS))
    assert [r["n_words"] for r in got] == [200, 200, 0, 0, 200, 200, 1, 2]
    assert [r["base_failed"] for r in got] == [False, False, True, True, False, False, True, True]
    assert quality.with_quality(none, quality.LABELLED_BANDS).count() == 0
    with pytest.raises(ValueError):
        quality.with_quality(docs.withColumn("N_Words", F.lit(1)), quality.LABELLED_BANDS)


def test_phrases(docs, none):
    got = by_id(phrases.dedup_substrings(docs, with_text=True, carry=("lang", "band")))
    assert [(r["n_words"], r["n_removed"]) for r in got] == [(200, 0), (200, 0), (0, 0), (0, 0), (200, 200), (200, 200), (1, 0), (2, 0)]
    assert got[-1]["kept_text"] == " \t\n a  b " and got[1]["lang"] == "en"
    assert phrases.dedup_substrings(none).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, BPE, longest=64)
    assert got.select("sequence_id").distinct().count() == got.count()
    assert [r["doc_tokens"] for r in by_id(got.filter("start = 0"))][2:4] == [1, 1]
    assert packing.pack(none, BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, BPE, longest=100)


def test_tokens_round_trip(spark, docs, none, tmp_path):
    simple8b.write_tokens(docs, BPE, str(tmp_path / "a"))
    got = [r.asDict() for r in simple8b.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()]
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6]
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]))
    simple8b.write_tokens(none, BPE, str(tmp_path / "b"))
    assert simple8b.read_tokens(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_simple8b_words(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 2, 3, 59, 60, 61, 240, 241, 5000):
        bits = rng.integers(0, [1, 2, 8, 17, 31, 64][seed], n).astype(np.uint64)
        ids = rng.integers(0, 2**63, n, dtype=np.uint64) & ((np.uint64(1) << bits) - np.uint64(1)) if n else np.empty(0, np.uint64)
        ids[rng.random(n) < 0.4] = 0
        assert (simple8b.decode_words(simple8b.encode_words(ids), n) == ids).all()
    big = np.array([2**64 - 1, 15 << 60, 0, 2**63, 1], dtype=np.uint64)
    assert (simple8b.decode_words(simple8b.encode_words(big), 5) == big).all()


def test_sharding(docs, none):
    got = by_id(sharding.shard_by_bytes(docs, 3))
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6] and got[2]["size"] == 8
    assert sharding.shard_by_bytes(none, 3).count() == 0


def test_simhash(docs, none):
    got = by_id(simhash.near_duplicate_components(docs))
    assert [r["component_id"] for r in got] == [1, 1, 2, 2, 1, 1, 5, 6]
    assert [(r["doc_id"], r["group"]) for r in by_id(simhash.near_duplicate_groups(docs))] == [(3, 2), (4, 1)]
    assert simhash.near_duplicate_components(none).count() == 0
    assert simhash.near_duplicate_groups(none).count() == 0


def test_links_beyond_one_tree(spark):
    rng = np.random.default_rng(0)
    fps = {0}
    while len(fps) < 300:  # one dense cluster, so that most shards need several chunks
        x = int(rng.choice(list(fps)))
        fps.add(x ^ 1 << int(rng.integers(0, 63)) ^ (1 << int(rng.integers(0, 63)) if rng.random() < 0.5 else 0))
    fps = sorted(fps)
    parent = list(range(len(fps)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    members = spark.createDataFrame([(f, f, None) for f in fps], "id long, fp long, sketch binary")
    edges = simhash.links(members, simhash.bit_routes(members, 2), radius=2, tree_size=16)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert [roots.get(f, f) for f in fps] == [fps[find(i)] for i in range(len(fps))]


def test_near_copies_are_caught(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(40):
        words = [f"t{x}" for x in rng.integers(0, 10**6, 400)]
        for edits in (0, 2, 4):
            copy = list(words)
            for k in rng.integers(0, 400, edits):
                copy[k] = f"e{rng.integers(0, 10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    got = {r.doc_id: r.group for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 3 for i in range(n) if i % 3}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7)], "a long, b long")
    assert {(r.node, r.root) for r in connected_components(edges).collect()} == {(i, 0) for i in range(1, 101)}
    assert connected_components(edges.limit(0)).count() == 0


def test_top_k(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [0.5, 0.5])]
    vectors = covertree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = covertree.top_k(vectors, vectors.filter("id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 512 * 1024), (2, 512 * 1024)]
    assert covertree.top_k(vectors.limit(0), vectors, 2).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_tree_search(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-50, 50, (1500, 6)) if seed else np.repeat(rng.integers(-3, 3, (15, 6)), 100, axis=0)
    ids = rng.permutation(len(points))
    found = covertree.search(covertree.Indexed(ids[:200], points[:200]), covertree.Indexed(ids, points), 5)
    for q in range(0, 200, 20):
        scores = points @ points[q]
        want = [(int(ids[q]), int(ids[j]), int(scores[j])) for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:5]
        assert [f for f in found if f[0] == ids[q]] == want


ODD = ["", "<|end|>", "<\\|end|>", "<\\\\|x", "</s>", "<\\/s>", "[INST] [/INST] [\\INST]", "a<", "|turn|>", "<s><<s>", "\\", "é<|🙂"]


def test_chat(spark):
    for text in ODD:
        assert chat.unescape(chat.escape(text)) == text
        assert chat.parse(chat.turn_text(text, text)[0]) == [(text, text)]
    rows = [(1, i, "assistant" if i % 2 else "user", t, 9) for i, t in enumerate(ODD[:-1])] + [(None, None, None, None, 9), (2, 0, "assistant", "only", 9), (2, 0, "assistant", "only", 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target int")
    examples = chat.expand(turns)
    for e in examples.collect():
        assert e.text[e.loss_start : e.loss_end] in {chat.escape(t) for t in ["", *ODD, "only"]}
    got = {r.conv: r for r in chat.read_back(examples).collect()}
    assert (got[1].n_turns, got[1].n_examples, got[2].loss_chars, got[None].n_turns) == (11, 6, 8, 1)
    assert chat.expand(turns.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x y", "é" * 30_000, "z"), (2, None, None, "z"), (3, "u", "", "z"), (4, "u", "é" * 30_000, "z"), (None, "u", "", "z")], "page_id long, url string, html string, segment string")
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=1000)
    got = {r.page_id: r for r in warc.with_revisit_bytes(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert bytes(got[1].payload).decode() == "é" * 30_000 and got[1].whole
    assert (got[4].record_type, got[4].refers_to, got[4].payload_bytes) == ("revisit", 1, 60_000)
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes, got[None].record_type) == ("revisit", 2, 0, "response")
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_missing_segment_is_seen(spark, tmp_path):
    records = list(warc.page_records(1, 0, "u", b"x" * 5000, None, 1000))
    assert len(records) > 4
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0.txt").write_bytes(warc.SEPARATOR.join(r for i, r in enumerate(records) if i != 2))
    (r,) = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert not r.whole and r.payload is None
    assert warc.unchunked(b"3;a=b\r\nabc\r\n0\r\nT: x\r\n\r\n") == b"abc"


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    rows = C.run(spark, sf).select("doc_id", "start", "length", "doc_tokens").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(os.path.join(sf, "documents.parquet")).collect()}
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert whole and all(a == b for a, b in whole.values()) and whole.keys() < docs.keys()


def test_short_near_copies_exactly(spark):
    """Texts of 30 to 90 words around the similarity of 0.8: groups are those of exact five-word shingle sets."""
    import random

    rng = random.Random(7)
    texts = []
    for base in range(60):
        words = [f"w{base}x{rng.randrange(10_000)}" for _ in range(rng.randrange(30, 90))]
        texts.append(words)
        for cut in range(1, 13, 2):
            texts.append(words[: len(words) - cut] + [f"v{base}y{cut}z{i}" for i in range(cut // 2)])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i // 7 * 7, i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(texts)) if find(i) != i}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.group for r in simhash.near_duplicate_groups(df).collect()}
    assert got == want
    assert 100 < len(want) < len(texts) - 60
