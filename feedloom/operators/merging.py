"""Known-listing filters, closing, keep-first, candidates, deduplication, and snapshots with deltas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import similarity as sim
from feedloom.operators import neighbours

Transform = Callable[[DataFrame], DataFrame]
KEYS = ["source_name", "external_id"]
MERGE_OVER, SIMILAR_FROM, NEAR = 0.90, 0.70, 0.5
#: Distinct features of one key on either side that are compared at once.
BLOCK = 1024
#: Distinct features of one key on either side of a group, in expectation, and parts of a larger key, at least. Each row is
#: copied for each part of the other side.
GROUP, PARTS = 1 << 16, 6
#: Cells that an incoming vector may reach, as a mean: each takes a copy of it. Beyond, all vectors are one cell.
MOST_CELLS = 32
BACKFILLED = ["salary_min", "salary_max", "location", "is_remote", "description_html", "description_text", "apply_url"]


def unknown_listings(stored: DataFrame, keys: list[str] = KEYS, closed_at: str | None = "closed_at", reopen_closed: bool = True) -> Transform:
    """Listings not stored yet; with reopen_closed, closed ones do not count as stored. Nulls in a key match nothing."""
    known = stored.filter(F.col(closed_at).isNull()) if reopen_closed and closed_at else stored
    return lambda df: df.join(known.select(*keys), keys, "left_anti")


def to_close(fresh: DataFrame, complete_sources: DataFrame, keys: list[str] = KEYS) -> Transform:
    """Open stored rows of completely fetched sources that the fresh ids lack; sources that gave nothing are skipped."""
    fetched = fresh.select(keys[0]).distinct().join(complete_sources, keys[0], "left_semi")
    return lambda stored: stored.filter(F.col("closed_at").isNull()).join(fetched, keys[0], "left_semi").join(fresh.select(*keys), keys, "left_anti")


def keep_first(keys: list[str], position: str) -> Transform:
    """The first row by position of each key; ties are equal positions, so give a unique one. Window-group limits drop
    later rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(position)
    return lambda df: df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def insert_absent(stored: DataFrame, delta: DataFrame, keys: list[str], position: str) -> DataFrame:
    """stored and the first delta row of each key that it lacks."""
    new = delta.join(stored.select(*keys), keys, "left_anti").transform(keep_first(keys, position)).drop(position)
    return stored.unionByName(new, allowMissingColumns=True)


def upsert(stored: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of delta replace those of stored; delta has one row for each key."""
    return stored.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def or_candidates(left: DataFrame, right: DataFrame, pairs: list[tuple[Column, Column]], left_id: str, right_id: str, most: int | None = None) -> DataFrame:
    """(left_id, right_id) where any pair of expressions is equal, as a union of equality joins instead of one with OR.

    With `most`, a left row meets of each key's right rows only that many with the smallest ids, so a common value does
    not give all pairs; the others are dropped before the shuffle."""
    out = None
    for a, b in pairs:
        l, r = left.select(left_id, a.alias("_a")), right.select(right_id, b.alias("_b")).filter(F.col("_b").isNotNull())  # noqa: E741
        if most is not None:
            w = Window.partitionBy("_b").orderBy(right_id)
            r = r.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")
        found = l.join(r, F.col("_a") == F.col("_b")).select(left_id, right_id)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _keyed(rows: DataFrame, incoming: bool, pivots: neighbours.Pivots, distance: float, numbers: str = "array<double>") -> DataFrame:
    """(id, kind, key, feature, vector): a row for each way in which a row may meet candidates: 0 fingerprint, 1 company,
    2 title (lower case), 3 the cell of a vector. Incoming rows with a vector look for near ones only, in each cell that they reach;
    stored rows are found by all that they have."""
    from feedloom.functions.places import normal_place

    place = F.lower(normal_place(F.nullif(F.col("location"), F.lit(""))))
    feature = F.struct(F.col("fingerprint").alias("fingerprint"), F.lower("company").alias("company"), place.alias("place"), F.col("salary_min").cast("double").alias("low"), F.col("salary_max").cast("double").alias("high"))
    vector = F.col("embedding").cast(numbers) if "embedding" in rows.columns else F.lit(None).cast(numbers)
    texts = [F.when(vector.isNull(), c) if incoming else c for c in (F.col("fingerprint"), F.lower("company"), F.lower("title"))]
    keys = F.array(*(F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, k in enumerate(texts)))
    said = rows.select("id", feature.alias("feature"), F.explode(keys).alias("_k")).filter("_k.key is not null").select("id", "_k.kind", "_k.key", "feature", F.lit(None).cast(numbers).alias("vector"))
    if "embedding" not in rows.columns:
        return said
    near = neighbours.with_cells(rows.select("id", feature.alias("feature"), vector.alias("vector")).filter("vector is not null"), pivots, "vector", distance if incoming else None, "key")
    return said.unionByName(near.select("id", F.lit(3).alias("kind"), "key", "feature", "vector"))


def _ranks(similarities: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.floor((1 - similarities) * 100 + 0.5))


def _fused(ranks: list[np.ndarray]) -> np.ndarray:
    """Reciprocal rank fusion; a rank of 0 is unknown and left out."""
    return sum(np.where(r > 0, (sim.RRF_K + 1.0) / (sim.RRF_K + r), 0.0) for r in ranks) / sum((r > 0).astype(int) for r in ranks)


class _Names:
    """One name of each row on both sides: bounds of the ranks of all pairs, and exact ranks where they are asked for."""

    def __init__(self, a: list[str | None], b: list[str | None]) -> None:
        self.sides, self.at = [], []
        for side in (a, b):
            numbers = {v: i for i, v in enumerate(dict.fromkeys(v for v in side if v is not None))}
            self.sides.append(list(numbers))
            self.at.append(np.array([-1 if v is None else numbers[v] for v in side], dtype=np.int64))
        x, y = self.sides
        least = _ranks(sim.jaro_winkler_bounds(x, y)) if x and y else np.zeros((len(x), len(y)))
        known = np.zeros((len(x) + 1, len(y) + 1))  # the last row and column stand for no name
        known[:-1, :-1] = least
        self.least = known[np.ix_(self.at[0], self.at[1])]
        self.compared: dict[int, float] = {}

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of rows i and j; each pair of names is compared once."""
        width = len(self.sides[1]) + 1
        p, q = self.at[0][i], self.at[1][j]
        keys, back = np.unique(np.where((p < 0) | (q < 0), -1, p * width + q), return_inverse=True)
        fresh = [k for k in keys.tolist() if k >= 0 and k not in self.compared]
        if fresh:
            found = sim.jaro_winkler_pairs([self.sides[0][k // width] for k in fresh], [self.sides[1][k % width] for k in fresh])
            self.compared.update(zip(fresh, _ranks(found).tolist(), strict=True))
        return np.array([self.compared.get(k, 0.0) for k in keys.tolist()])[back]


def _cosines(a: list, b: list) -> np.ndarray:
    """Of all pairs; 0 for a vector without length. Vectors of another dimension than the first are far from all."""
    width = len(a[0])
    unit = lambda vs: np.array([np.array(v) / (np.linalg.norm(v) or 1.0) if len(v) == width else np.zeros(width) for v in vs])
    return unit(a) @ unit(b).T


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one dimension as rows of length 1; one without length stays zero."""
    rows = vectors.combine_chunks()
    m = rows.flatten().to_numpy().astype(np.float64).reshape(len(rows), -1)
    size = np.sqrt((m**2).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=m, where=size > 0)


def _best_of_group(stored: pa.Table, incoming: pa.Table, distance: float, block: int) -> pa.Table:
    """Each incoming feature's highest confidence in the group, and the smallest stored id that gives it. Features meet by
    blocks, so what is held beside the group's own rows is bounded."""
    own = incoming.select(["kind", "key", "rep"])
    if not stored.num_rows or not incoming.num_rows:
        return own.slice(0, 0).append_column("confidence", pa.array([], pa.float64())).append_column("cand_id", pa.array([], pa.int64()))
    stored = stored.sort_by("least")
    near = incoming.column("kind")[0].as_py() == 3
    a, b = (_units(x.column("vector")) if near else None for x in (incoming, stored))
    best, cand = np.full(incoming.num_rows, -1.0), np.zeros(incoming.num_rows, dtype=np.int64)
    at = ["kind", "key", "feature", "vector"]
    for i in range(0, incoming.num_rows, block):
        some = incoming.slice(i, block).select(at).set_column(3, "vector", pa.array(np.arange(i, min(i + block, incoming.num_rows))))
        for j in range(0, stored.num_rows, block):
            found = _best_of_block(stored.slice(j, block), some, distance, a[i : i + block] @ b[j : j + block].T if near else None)
            rows, top = found.column("vector").to_numpy(), found.column("confidence").to_numpy()
            more = top > best[rows]  # of equal ones the first stays, and stored ids ascend
            best[rows[more]], cand[rows[more]] = top[more], found.column("cand_id").to_numpy()[more]
    return own.append_column("confidence", pa.array(best)).append_column("cand_id", pa.array(cand)).filter(pa.array(best >= 0))


def _best_of_block(stored: pa.Table, incoming: pa.Table, distance: float, alike: np.ndarray | None = None) -> pa.Table:
    """Each incoming feature's highest confidence in the block, and the smallest stored id that gives it. alike has the
    vectors' cosines if they are known; stored ids ascend then."""
    stored = stored.sort_by("least") if alike is None else stored
    a, b = incoming.column("feature").to_pylist(), stored.column("feature").to_pylist()
    own = incoming.select(["kind", "key", "feature", "vector"])
    if not a or not b:
        return own.slice(0, 0).append_column("confidence", pa.array([], pa.float64())).append_column("cand_id", pa.array([], pa.int64()))
    x, y = ({v: i for i, v in enumerate(dict.fromkeys(f["fingerprint"] for f in rows if f["fingerprint"] is not None))} for rows in (a, b))
    prints = np.array([-1 if f["fingerprint"] is None else y.get(f["fingerprint"], -1) for f in a])[:, None], np.array([-2 if f["fingerprint"] is None else y[f["fingerprint"]] for f in b])[None, :]
    names = [_Names([f[c] for f in a], [f[c] for f in b]) for c in ("company", "place")]
    number = lambda rows, c: np.array([np.nan if f[c] is None else f[c] for f in rows], dtype=np.float64)
    a_low, b_low = number(a, "low")[:, None], number(b, "low")[None, :]
    a_top, b_top = (np.where(np.isnan(t := number(rows, "high")), number(rows, "low"), t) for rows in (a, b))
    a_top, b_top = a_top[:, None], b_top[None, :]
    low, high, union = np.maximum(a_low, b_low), np.minimum(a_top, b_top), np.maximum(a_top, b_top) - np.minimum(a_low, b_low)
    with np.errstate(invalid="ignore", divide="ignore"):
        shared = np.where(high < low, 0.0, np.where(union == 0, 1.0, (high - low) / union))
    pay = np.where(np.isnan(shared), 0, _ranks(np.nan_to_num(shared)))
    before, after = [np.where(prints[0] == prints[1], 1, 100)], [pay]
    near = np.ones((len(a), len(b)), dtype=bool)
    if incoming.column("kind")[0].as_py() == 3:
        alike = _cosines(incoming.column("vector").to_pylist(), stored.column("vector").to_pylist()) if alike is None else alike
        near = 1 - alike < distance
        after.append(_ranks(alike))
    # No pair passes its bound. Names are compared for each row's most promising pair, then for all that may reach what that gave.
    bound = np.where(near, _fused([*before, *(n.least for n in names), *after]), -1.0)
    total = np.full(bound.shape, -1.0)
    rows = np.arange(len(a))
    best, todo = np.full(len(a), -1.0), (rows, bound.argmax(axis=1))
    for _ in range(2):
        i, j = todo
        total[i, j] = np.where(near[i, j], _fused([*(r[i, j] for r in before), *(n.exact(i, j) for n in names), *(r[i, j] for r in after)]), -1.0)
        best = total.max(axis=1)
        todo = np.nonzero((bound >= best[:, None]) & near & (total < 0))
    first = total.argmax(axis=1)
    out = own.append_column("confidence", pa.array(total[rows, first])).append_column("cand_id", stored.column("least").take(pa.array(first)))
    return out.filter(pa.array(near.any(axis=1)))


def fingerprint_merges(incoming: DataFrame, stored: DataFrame, distance: float = NEAR, block: int = BLOCK) -> DataFrame:
    """(in_id, cand_id, confidence, disposition): incoming rows with their most confident stored candidate, and whether
    they are merged, similar or new.

    Candidates of a row with a vector are the stored rows within a cosine distance, of another those of its
    fingerprint, company or title (lower case), all of them: a limit in no order would let the best one go. Confidence fuses fingerprint, company,
    place, salary and vector ranks; ties go to the smaller stored id. Both sides are reduced to the distinct features of
    each key, with their smallest ids; they meet in groups of bounded size, each of which gives the best of each
    incoming feature by that id, so no pairs are kept and no task grows with a hot key. Work is the product of the features of a key;
    vectors meet those of the cells around pivots that the distance reaches, or all of their dimension where it reaches too
    many cells for a copy in each. A row has a copy for each group of its key on the other side, so shuffles grow with the
    square of a key of more than GROUP features, by a GROUP-th of the pairs."""
    both = "embedding" in incoming.columns and "embedding" in stored.columns
    pivots = neighbours.Pivots.fit(stored.filter(F.col("embedding").isNotNull()), "embedding") if both else neighbours.Pivots({})
    if pivots.copies(distance) > MOST_CELLS:
        pivots = neighbours.Pivots({})
    floats = both and all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (incoming, stored))
    mine, theirs = (_keyed(df, new, pivots, distance, "array<float>" if floats else "array<double>") for df, new in ((incoming, True), (stored, False)))
    key, each = ["kind", "key"], ["kind", "key", "feature", "vector"]
    a, b = mine.groupBy(*each).agg(F.min("id").cast("long").alias("rep")), theirs.groupBy(*each).agg(F.min("id").cast("long").alias("least"))
    whole = lambda n: F.ceil(F.count("*") / n)
    cuts = lambda df, name: df.groupBy(*key).agg(F.greatest(whole(GROUP), F.least(whole(block), F.lit(PARTS))).cast("int").alias(name))
    sizes = cuts(a, "_na").join(cuts(b, "_nb"), key)
    part = lambda n: F.pmod(F.xxhash64("feature", "vector"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(sizes, key).select(*each, "rep", part("_na").alias("_a"), every("_nb").alias("_b"))
    right = b.join(sizes, key).select(*each, "least", part("_nb").alias("_b"), every("_na").alias("_a"))
    group = [*key, "_a", "_b"]
    found = right.groupBy(*group).cogroup(left.groupBy(*group)).applyInArrow(lambda x, y: _best_of_group(x, y, distance, block), "kind int, key string, rep long, confidence double, cand_id long")
    order = F.struct("confidence", (-F.col("cand_id")).alias("_less"))
    best = found.groupBy(*key, "rep").agg(F.max(order).alias("_top"))
    same = a.select(*(F.col(c).alias(f"_{c}") for c in each), "rep")
    reps = mine.join(same, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in each]).select("id", *key, "rep")
    top = reps.join(best, [*key, "rep"]).groupBy(F.col("id").alias("in_id")).agg(F.max("_top").alias("_top")).select("in_id", (-F.col("_top._less")).alias("cand_id"), F.col("_top.confidence").alias("confidence"))
    c = F.col("confidence")
    return incoming.select(F.col("id").alias("in_id")).join(top, "in_id", "left").withColumn("disposition", F.when(c > MERGE_OVER, "merged").when(c >= SIMILAR_FROM, "similar").otherwise("new"))


def merge_attributions(own: Column, new: Column) -> Column:
    """own, then each new source whose (name, external_id) it lacks, in order."""
    same = lambda x, y: (x["name"] == y["name"]) & (x["external_id"] == y["external_id"])
    return F.concat(own, F.filter(new, lambda y: ~F.exists(own, lambda x: same(x, y))))


def merged(stored: DataFrame, incoming: DataFrame, found: DataFrame, position: str, columns: list[str] = BACKFILLED) -> DataFrame:
    """stored after the incoming rows that found (as fingerprint_merges() gives it) calls merged: null columns take the first
    incoming value by position, sources the attributions that they lack, in order, dedup_confidence that of the last row.
    Closed rows stay closed; _needs_score marks changed rows without a score; other rows stay as they are.

    incoming has id, position (unique), sources and the columns. Attributions are made distinct before they are gathered,
    so a row's array holds no more than the row itself will."""
    rows = found.filter("disposition = 'merged'").select("in_id", "cand_id", "confidence").join(incoming, F.col("in_id") == F.col("id"))
    said = rows.groupBy("cand_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_{c}") for c in columns), F.max_by("confidence", position).alias("_confidence"))
    each = rows.select("cand_id", F.col(position).alias("_at"), F.posexplode("sources").alias("_i", "_s"))
    once = each.groupBy("cand_id", "_s.name", "_s.external_id").agg(F.min(F.struct("_at", "_i", "_s")).alias("_x"))
    new = once.groupBy("cand_id").agg(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["_s"]).alias("_sources"))
    joined = stored.join(said.join(new, "cand_id", "left"), F.col("id") == F.col("cand_id"), "left")
    seen = F.col("cand_id").isNotNull()
    none = F.array().cast(stored.schema["sources"].dataType)
    filled = {c: F.coalesce(c, f"_{c}") for c in columns} | {"sources": F.when(seen, merge_attributions(F.coalesce("sources", none), F.coalesce("_sources", none))).otherwise(F.col("sources")), "dedup_confidence": F.coalesce("_confidence", "dedup_confidence"), "_needs_score": seen & F.col("match_score").isNull()}
    return joined.withColumns(filled).select(*stored.columns, "_needs_score")


def refreshed(stored: DataFrame, incoming: DataFrame, position: str, keys: list[str] = KEYS, columns: list[str] = BACKFILLED) -> DataFrame:
    """stored with what the same source says anew: null columns take the first incoming value by position, closed rows
    reopen, other columns stay; _needs_score marks matched rows without a score. Rows without a match stay as they are.
    If stored has sources, a matched row's own attribution (name, external_id) is appended where it lacks it."""
    said = incoming.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(f"_{c}") for c in columns), F.lit(True).alias("_seen"))
    joined = stored.join(said, keys, "left")
    seen = F.coalesce("_seen", F.lit(False))
    filled = {c: F.coalesce(c, f"_{c}") for c in columns} | {"closed_at": F.when(~seen, F.col("closed_at")), "_needs_score": seen & F.col("match_score").isNull()}
    if "sources" in stored.columns:
        kind = stored.schema["sources"].dataType
        named = {"name": F.col(keys[0]), "external_id": F.col(keys[1])}
        own = F.array(F.struct(*(named.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields)))
        filled["sources"] = F.when(seen, merge_attributions(F.coalesce("sources", F.array().cast(kind)), own)).otherwise(F.col("sources"))
    return joined.withColumns(filled).select(*stored.columns, "_needs_score")
