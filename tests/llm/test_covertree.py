"""Exact long scores, levels, and pairs that the trees prune."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import covertree as C


def best(ids, points, n, k):
    """Brute force in Python's integers."""
    exact = points.astype(object)
    out = set()
    for i in range(n):
        scores = exact @ exact[i]
        order = sorted((-s, int(j)) for s, j, same in zip(scores, ids, ids == ids[i], strict=True) if not same)[:k]
        out |= {(int(ids[i]), j, -s) for s, j in order}
    return out


RNG = np.random.default_rng(4)
CASES = {
    "clusters": (np.floor(1024 * (RNG.normal(size=(40, 32))[RNG.integers(0, 40, 3000)] + 0.05 * RNG.normal(size=(3000, 32)))).astype(np.int64), 0.5),
    "few dimensions": (RNG.integers(-5000, 5000, (3000, 3)), 0.5),
    "unlike lengths": ((RNG.normal(size=(3000, 16)) * np.exp(1.5 * RNG.normal(size=(3000, 1))) * 1024).astype(np.int64), 0.5),
    "large": (RNG.integers(-(1 << 27), 1 << 27, (400, 64)), None),
    "nearly 2**63": (RNG.integers(-(1 << 30), 1 << 30, (300, 4)), None),
    "far from zero": (RNG.integers(0, 9, (1000, 8)) + 10**9 // 2, None),
    "equal": (np.repeat(RNG.integers(-3, 3, (9, 5)), 200, axis=0), 0.5),
}


@pytest.mark.parametrize("name", CASES)
def test_search(name):
    points, pruned = CASES[name]
    ids = RNG.permutation(len(points))
    run = C.Search(C.Indexed(ids[:150], points[:150]), 7)
    cut = len(points) // 3
    for part in (slice(0, cut), slice(cut, None)):  # scores are carried from block to block
        run.add(C.Indexed(ids[part], points[part]))
    wanted = {int(i) for i in ids[:25]}
    assert {x for x in run.result() if x[0] in wanted} == best(ids, points, 25, 7)
    assert pruned is None or run.scored < pruned * run.met


def test_levels_fall():
    tree = C.Indexed(np.arange(3000), CASES["clusters"][0])
    assert len({x for x in tree.levels if x is not None}) > 3
    for n in range(len(tree.lo)):
        for c in range(int(tree.first[n]), int(tree.end[n])):
            assert tree.lo[n] <= tree.lo[c] < tree.hi[c] <= tree.hi[n]
            assert tree.levels[c] is None or tree.levels[c] <= tree.levels[n]
        own = tree.floats[tree.lo[n] : tree.hi[n]]
        assert np.sqrt(((own - tree.centre[n]) ** 2).sum(axis=1)).max() <= tree.radius[n] * (1 + 1e-12)


def test_beyond_a_long():
    points = np.full((80, 2), 3 << 30, dtype=np.int64)
    with pytest.raises(OverflowError):
        C.search(C.Indexed(np.arange(80), points), C.Indexed(np.arange(80), points), 2)


def test_query_of_large_components(spark):
    rows = [(i, [float(x) for x in RNG.integers(-(1 << 17), 1 << 17, 64)]) for i in range(300)] + [(300, [1.0]), (301, [2.0]), (302, []), (None, [1.0])]
    vectors = C.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("V", F.lit(1)))
    got = {(r.query_id, r.vec_id, r.score) for r in C.top_k(vectors, vectors.filter("id % 50 = 0 or id > 299"), 5).collect()}
    points = np.array([[int(1024 * x) for x in v] for _, v in rows[:300]], dtype=np.int64)
    want = {x for x in best(np.arange(300), points, 251, 5) if x[0] % 50 == 0}
    assert got == want | {(300, 301, 2 << 20), (301, 300, 2 << 20)}
    with pytest.raises(Exception, match="does not fit"):
        C.quantised(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()
