"""Substring dedup removes what the words show, whatever the hashes say."""

import hashlib

import numpy as np

from feedloom.llm import phrases


def words(n, seed):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 50_000, n)]


def run(texts, passages, owners):
    ids = np.arange(10, 10 + len(texts))
    return phrases.located(ids, np.zeros(len(texts), dtype=bool), [" ".join(t).encode() for t in texts], 13, [" ".join(p).encode() for p in passages], np.array(owners))


def test_equal_words_only():
    a, b = words(100, 1), words(100, 2)
    masks = run([a[:40] + b, b], [a[20:60], b[:30]], [1, 10])
    assert masks[0].nonzero()[0].tolist() == list(range(20, 40))
    assert masks[1].nonzero()[0].tolist() == list(range(30))


def test_forged_hashes_remove_nothing(monkeypatch):
    a, b = words(60, 1), words(60, 2)
    near = b[:20] + a[:12] + b[20:]  # a piece of the passage, one word short of a window
    monkeypatch.setattr(phrases.Windows, "hashes", lambda self: np.full(len(self.at), 7, dtype=np.uint64))
    assert run([b, near], [a], [1]) == {}


def test_many_passages_in_several_automata(monkeypatch):
    monkeypatch.setattr(phrases, "AUTOMATON_BYTES", 100)
    parts = [words(13, s) for s in range(30)]
    masks = run([sum(parts, [])], parts, [1] * 30)
    assert masks[0].all()


def test_smallest_owner_of_a_window_decides():
    a, b = words(60, 1), words(60, 2)
    # Document 10 holds what 5 owns; a passage of 20, quoted whole, holds the same windows and arrives first.
    masks = run([a + b], [b[:20] + a[:40], a], [20, 5])
    assert masks[0].nonzero()[0].tolist() == list(range(60))


def test_further_passages_of_a_hash_are_looked_at(monkeypatch):
    a, b = words(60, 1), words(60, 2)
    monkeypatch.setattr(phrases.Windows, "hashes", lambda self: np.full(len(self.at), 7, dtype=np.uint64))
    masks = run([b + a], [words(30, 3), b[:40], a], [1, 2, 99])
    assert masks[0].nonzero()[0].tolist() == list(range(40))


def brute(docs):
    first = {}
    for i, text in docs:
        w = text.split()
        for j in range(len(w) - 12):
            first[tuple(w[j : j + 13])] = min(first.get(tuple(w[j : j + 13]), i), i)
    out = []
    for i, text in docs:
        w = text.split()
        out.append((i, len({k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)})))
    return sorted(out)


def test_owners_that_quote_each_other_in_any_order(spark):
    """Passages shared by many documents, two in a part, ids that lie in several shards, and both orders of arrival."""
    g = np.random.default_rng(5)
    shared = [words(40, 100 + s) for s in range(12)]
    docs = []
    for i in range(300):
        parts = [words(int(g.integers(0, 30)), 1000 + i)]
        for _ in range(4):
            p = shared[g.integers(12)]
            cut = int(g.integers(0, 20))
            parts += [p[cut : cut + int(g.integers(10, 40))], words(int(g.integers(0, 8)), int(g.integers(1 << 30)))]
        docs.append((i % 250, " ".join(sum(parts, []))))
    for rows in (docs, docs[::-1]):
        found = phrases.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shard_bytes=20_000)
        assert sorted((r["doc_id"], r["n_removed"]) for r in found.collect()) == brute(docs)


def test_whole_larger_sample(spark):
    """op4's query on the 0.1-scale sample, by hashes of windows: what shows only with several shards and many owners."""
    import duckdb

    from feedloom.llm import queries

    sf = "/root/testdata/sf0.1"
    docs = [(i, (t or "").encode().split()) for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()]
    first = {}
    for i, w in docs:
        for j in range(len(w) - 12):
            h = hash(tuple(w[j : j + 13]))
            first[h] = min(first.get(h, i), i)
    got = {r["doc_id"]: r for r in queries.op4_phrase_automata(spark, sf).collect()}
    for i, w in docs:
        gone = {k for j in range(len(w) - 12) if first[hash(tuple(w[j : j + 13]))] < i for k in range(j, j + 13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
