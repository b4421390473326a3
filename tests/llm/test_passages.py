"""Location of passages: the same words go as by brute force, and automata hold only what the shard's documents meet."""

import ahocorasick
import numpy as np
import pytest

from feedloom.llm import phrases


def words(n, seed, most=10**9):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, most, n)]


def located(texts, passages, owners, window=13):
    ids = np.arange(100, 100 + len(texts))
    return phrases.located(ids, np.zeros(len(texts), dtype=bool), [" ".join(t).encode() for t in texts], window, [" ".join(p).encode() for p in passages], np.array(owners))


@pytest.mark.parametrize("window", [4, 5, 12, 13])
@pytest.mark.parametrize("automaton_bytes", [300, 4 << 20])
def test_words_go_as_by_brute_force(monkeypatch, window, automaton_bytes):
    monkeypatch.setattr(phrases, "AUTOMATON_BYTES", automaton_bytes)
    g = np.random.default_rng(window)
    passages = [words(int(g.integers(window, 60)), i) for i in range(20)] + [words(80, 50, most=2), ["same"] * 40]
    passages += [p[3:] for p in passages[:10] if len(p) > window + 3]
    owners = g.integers(90, 115, len(passages)).tolist()
    texts = [words(30, 999), []]
    for i in range(20):
        text = words(int(g.integers(0, 9)), 2000 + i)
        for _ in range(4):
            p = passages[g.integers(len(passages))]
            cut = int(g.integers(0, len(p)))
            text += p[cut : cut + int(g.integers(1, 40))] + words(int(g.integers(0, 3)), int(g.integers(1 << 30)))
        texts.append(text)
    least: dict[tuple, int] = {}
    for p, owner in zip(passages, owners, strict=True):
        for j in range(len(p) - window + 1):
            key = tuple(p[j : j + window])
            least[key] = min(least.get(key, owner), owner)
    found = located(texts, passages, owners, window)
    for d, t in enumerate(texts):
        gone = {k for j in range(len(t) - window + 1) if least.get(tuple(t[j : j + window]), 1 << 60) < 100 + d for k in range(j, j + window)}
        assert set(np.flatnonzero(found.get(d, [])).tolist()) == gone


def test_only_what_is_met_is_compiled_and_streamed(monkeypatch):
    added, streamed = [], []

    class Seen:
        def __init__(self, inner=ahocorasick.Automaton):
            self.inner = inner()
            self.make_automaton = self.inner.make_automaton

        def __len__(self):
            return len(self.inner)

        def add_word(self, word, value):
            added.append(word)
            return self.inner.add_word(word, value)

        def iter(self, stream):
            streamed.append(stream)
            return self.inner.iter(stream)

    monkeypatch.setattr(ahocorasick, "Automaton", Seen)
    long, other = words(128, 1), words(128, 2)
    found = located([words(50, 3), words(20, 4) + long[40:55] + words(20, 5), words(50, 6)], [long, other], [1, 2])
    assert {d: np.flatnonzero(m).tolist() for d, m in found.items()} == {1: list(range(20, 35))}
    assert len(streamed) == 1 and set(added) == {f" {' '.join(long[42:49])} "}
