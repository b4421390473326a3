"""Merkle manifests against a plain recursion, for several arities, odd rows and tampered leaves."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from feedloom.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree int, digest string, path string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def proofs(leaves, arity):
    """(root, siblings of each leaf as (left, right) pairs)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p - p % arity : p - p % arity + arity]
            paths[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        level = [sha("".join(level[j : j + arity])) for j in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0], paths


def brute(rows, arity, show=lambda r: r):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), leaf_of(show(r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [proofs([x[2] for x in sorted(groups[s])], arity) for s in names]
    root, upper = proofs([t[0] for t in trees], arity)
    out = []
    for s, (subroot, paths), above in zip(names, trees, upper, strict=True):
        for (known, i, leaf, shown), own in zip(sorted(groups[s]), paths, strict=True):
            x, said = shown, ""
            for left, right in own + above:
                x, said = sha(left + x + right), said + left + right
            out.append((i if known else None, leaf, subroot, root, said, x))
    return sorted(out, key=repr)


def found(spark, rows, arity, tampered=None):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = M.manifest(df, arity=arity, presented={"text": tampered} if tampered is not None else None)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", M.siblings_of(F.col("path")), M.folded(F.col("path"), F.col("shown"))).collect()), key=repr)


ROWS = [(i, f"s{i % 3}" if i % 4 else "hot", "en", i, f"Text {i}") for i in range(150)]
ODD = [(1, None, None, None, None), (1, "", "en", 0, ""), (2, "lone", "é", 3, "é" * 3000), (None, "hot", "en", 1, "no id"), (None, "hot", "en", 1, "No id"), (5, "hot", "en", 5, "same"), (5, "hot", "en", 5, "same"), (5, "hot", "en", 5, "other"), (-3, "zz", "a:b", 1, "-"), (7, None, "-", 1, "1:x")]


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_brute_force(spark, arity):
    rows = ROWS + ODD
    low = lambda r: (*r[:4], r[4].lower() if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4])
    tampered = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    assert found(spark, rows, arity, tampered) == brute(rows, arity, low)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "x")], [(3, None, None, None, None)] * 40])
def test_few_rows(spark, rows):
    got = found(spark, rows, 16)
    assert got == (brute(rows, 16) if rows else [])
    assert all(r[3] == r[5] for r in got)


def test_a_changed_sibling_is_noticed(spark):
    rows = [(i, "a", "en", 1, f"t{i}") for i in range(20)]
    root = found(spark, rows, 16)[0][3]
    rows[7] = (7, "a", "en", 1, "T7")
    assert found(spark, rows, 16)[0][3] != root
