"""SimHash near-duplicates: fingerprints, linked by BK-trees, gathered into components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import ascii_lower, checkpointed, let_go, mix64, saved, sliced, texts_of
from feedloom.llm.components import connected_components

#: Fingerprints of one band value that meet in one tree at most (in expectation); larger groups are cut into chunks.
TREE_SIZE = 1024
#: Bytes of their shingle sets, likewise; one larger set makes a chunk of its own.
TREE_BYTES = 16 << 20
#: Smallest hashes of a set that stand for it in a first search, and standard errors by which their estimate may fall short.
SAMPLE, MARGIN = 128, 4.0


def shingle_hashes(text: bytes, words_per_shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle of a lower-cased text, repeats included; of fewer words, that of the whole sequence."""
    words = ascii_lower(text).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    k = min(words_per_shingle, len(words))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(b" ".join(s), seed) for s in zip(*(words[i:] for i in range(k)), strict=False)), dtype=np.uint64, count=len(words) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words_per_shingle: int, seed: int) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    return simhash(shingle_hashes(text, words_per_shingle, seed))


def fingerprints(docs: DataFrame, *, words_per_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed 64-bit integer. Null texts count as empty (fp 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batches, "_text", 4 << 20):
            fps = np.array([fingerprint(t, words_per_shingle, seed) for t in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, fp long").withColumnRenamed("_id", id_col)


class BkTree:
    """Children of a node are keyed by their integer Hamming distance to it; equal values share a node's list of items."""

    def __init__(self) -> None:
        self.root: tuple[int, list, dict] | None = None

    def add(self, value: int, item: object) -> None:
        if self.root is None:
            self.root = (value, [item], {})
            return
        node = self.root
        while d := (node[0] ^ value).bit_count():
            if d not in node[2]:
                node[2][d] = (value, [item], {})
                return
            node = node[2][d]
        node[1].append(item)

    def within(self, value: int, radius: int) -> Iterator[list]:
        """Items of values at most radius away: only edges whose key is within radius of the node's own distance can
        lead there."""
        stack = [self.root] if self.root else []
        while stack:
            at, items, children = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                yield items
            if len(children) <= 2 * radius:
                stack.extend(child for key, child in children.items() if -radius <= key - d <= radius)
            else:
                stack.extend(children[key] for key in range(max(1, d - radius), d + radius + 1) if key in children)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two whole sets of hashes have a Jaccard similarity of at least `similarity`."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared)


def maybe_similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets may be similar, by their SAMPLE smallest hashes (all, if fewer): those of the union that both have
    are an unbiased estimate; it passes if it lies at most MARGIN standard errors below the similarity."""
    both = np.union1d(a, b)[: max(len(a), len(b))]
    shared = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True))
    return shared >= similarity * len(both) - MARGIN * (similarity * (1 - similarity) * len(both)) ** 0.5


Member = tuple[int, int, "np.ndarray | None"]  # id, fingerprint, set of shingle hashes


def _local_links(own: list[Member], others: list[Member], radius: int, similarity: float, alike: Callable[[np.ndarray, np.ndarray, float], bool] = similar) -> dict[int, int]:
    """A star for each local component: id to the smallest id of its component. own fills the tree and, if there are no
    others, is searched as well; else only others are searched."""
    tree, parent = BkTree(), {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def look(i: int, fp: int, sketch: np.ndarray | None) -> None:
        for items in tree.within(fp, radius):
            for j, other in items:
                a, b = find(i), find(j)
                if a != b and (sketch is None or alike(sketch, other, similarity)):
                    parent[max(a, b)] = min(a, b)

    for i, fp, sketch in own:
        parent.setdefault(i, i)
        if not others:
            look(i, fp, sketch)
        tree.add(fp, (i, sketch))
    for i, fp, sketch in others:
        parent.setdefault(i, i)
        look(i, fp, sketch)
    return {x: r for x in parent if (r := find(x)) != x}


def links(members: DataFrame, routes: DataFrame, *, radius: int, similarity: float = 0.0, sampled: bool = False, tree_size: int = TREE_SIZE, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """(a, b): edges between ids whose closure is that of all pairs that share a route, have fingerprints within radius,
    and, if members have sketches, at least that similarity.

    members: (id, fp, sketch), the sketch being a whole set of shingle hashes (64 bits each), a sample of one (32 bits) if
    sampled, or null; routes: (id, band, value), and bytes if there are whole sets. A shard is all members of one route. Each shard gets a BK-tree; a shard above
    tree_size members or tree_bytes is cut into chunks by a hash, and each pair of chunks meets in a group of its own
    (one chunk's tree, the other's queries), so no tree or group grows with a hot value. Trees go to their queries
    through the shuffle: broadcasting them would bring the fingerprints of all documents to the driver. Each group
    gives a star for each local component instead of its pairs.
    """
    sizes = routes.groupBy("band", "value").agg(F.count("*").alias("_n"), F.sum("bytes" if "bytes" in routes.columns else F.lit(0)).alias("_bytes")).filter("_n > 1")
    chunks = F.greatest(F.ceil(F.col("_n") / tree_size), F.least(F.col("_n"), F.ceil(F.col("_bytes") / tree_bytes))).cast("int")
    placed = routes.join(sizes, ["band", "value"]).withColumn("_chunks", chunks).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int"))
    # Each chunk with itself, and each two chunks once: the lower one's tree, the higher one's queries.
    pairs = placed.select("id", "band", "value", "_own", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_with"))
    keyed = pairs.select("id", "band", "value", F.least("_own", "_with").alias("_tree"), F.greatest("_own", "_with").alias("_query"), "_own").join(members, "id")

    kind = "<u4" if sampled else "<u8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        key, own, others = None, [], []
        a: list[int] = []
        b: list[int] = []

        def flush() -> None:
            if len(own) + len(others) > 1:
                for x, y in _local_links(own, others, radius, similarity, maybe_similar if sampled else similar).items():
                    a.append(x)
                    b.append(y)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
            return batch

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for i, fp, sketch, band, value, tree, query, mine in zip(*cols, strict=True):
                if (now := (band, value, tree, query)) != key:
                    flush()
                    key, own, others = now, [], []
                (own if mine == tree else others).append((i, fp & 0xFFFFFFFFFFFFFFFF, None if sketch is None else np.frombuffer(sketch, dtype=kind)))
            if len(a) > 20_000:
                yield out()
        flush()
        if a:
            yield out()

    group = ["band", "value", "_tree", "_query"]
    dealt = keyed.repartition(*group).sortWithinPartitions(*group, "id").select("id", "fp", "sketch", *group, "_own")
    return dealt.mapInArrow(run, "a long, b long")


def bit_routes(fps: DataFrame, radius: int) -> DataFrame:
    """Of radius + 2 bands of bits, two fingerprints within radius agree on two: (id, band, value) of each two bands. Two
    bands have half of the bits at radius 2, so that few unlike fingerprints share a value however many there are."""
    cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    bits = lambda i: F.shiftrightunsigned(F.shiftleft("fp", 64 - cuts[i + 1]), 64 - cuts[i + 1] + cuts[i])
    pairs = [(i, j) for j in range(radius + 2) for i in range(j)]
    bands = F.array(*(F.struct(F.lit(n).alias("band"), F.shiftleft(bits(i), cuts[j + 1] - cuts[j]).bitwiseOR(bits(j)).alias("value")) for n, (i, j) in enumerate(pairs)))
    return fps.select("id", F.explode(bands).alias("_b")).select("id", "_b.band", "_b.value")


def near_duplicate_components(docs: DataFrame, *, radius: int = 2, words_per_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (signed 64 bits), component_id (the smallest id reachable by links, itself included).

    Equal fingerprints are gathered before any search, so thousands of copies are one value. Null or empty texts have
    fingerprint 0 and are linked like any other; null ids stay and never become a component_id while others are there;
    repeated rows give repeated results; an empty table gives no rows.
    """
    docs_fp = checkpointed(fingerprints(docs, words_per_shingle=words_per_shingle, seed=seed, id_col=id_col, text_col=text_col))
    smallest = checkpointed(docs_fp.groupBy("fp").agg(F.min(id_col).alias("_least")))
    members = smallest.select(F.col("fp").alias("id"), "fp", F.lit(None).cast("binary").alias("sketch"))
    roots = connected_components(links(members, bit_routes(members, radius), radius=radius))
    rooted = smallest.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("_root"), "_least")
    named = rooted.join(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("fp", "component_id")
    return docs_fp.join(named, "fp").select(id_col, "fp", "component_id")


#: Salts of the minima by which likely copies find each other: of sets with similarity 0.8, two of six minima agree but
#: for one pair in 600, and one of six but for one in 15,000.
ROUTES = np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def signatures(docs: DataFrame, *, words_per_shingle: int = 5, seed: int = 42, whole: bool = False) -> DataFrame:
    """(id, text_hash, fp, key, bytes, sample, routes) of each row (id, text, text_hash), or (key, sketch) if whole; of whole
    texts. All are of the distinct shingles, so that repeats weigh in neither radius nor similarity: fp is their SimHash,
    key a 64-bit hash that names them, the sketch their whole set, bytes its size, the sample its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batches, "text", 4 << 20):
            fps, keys, sizes, samples, routes, sketches = [], [], [], [], [], []
            for text in texts_of(batch.column(1)):
                distinct = np.unique(shingle_hashes(text, words_per_shingle, seed))
                data = distinct.astype("<u8").tobytes()
                keys.append(xxhash.xxh3_64_intdigest(data))
                if whole:
                    sketches.append(data)
                    continue
                fps.append(simhash(distinct))
                sizes.append(len(data))
                samples.append((distinct[:SAMPLE] >> np.uint64(32)).astype("<u4").tobytes())
                routes.append([int(mix64(distinct ^ salt).min().view(np.int64)) for salt in ROUTES] if len(distinct) else [0])
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            if whole:
                yield pa.RecordBatch.from_arrays([signed(keys), pa.array(sketches, pa.binary())], ["key", "sketch"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed(fps), signed(keys), pa.array(sizes, pa.int64()), pa.array(samples, pa.binary()), pa.array(routes, pa.list_(pa.int64()))], ["id", "text_hash", "fp", "key", "bytes", "sample", "routes"])

    return docs.select("id", "text", "text_hash").mapInArrow(run, "key long, sketch binary" if whole else "id long, text_hash long, fp long, key long, bytes long, sample binary, routes array<long>")


def near_duplicate_groups(docs: DataFrame, *, words_per_shingle: int = 5, similarity: float = 0.8, radius: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, group): for each row of an id that is not the smallest of its group of near copies, that
    smallest id, and the xxhash64 of the row's text.

    Copies within `radius` bits of SimHash whose word shingles have a Jaccard similarity of `similarity` are linked, judged
    by their whole sets of shingles at any length. At that similarity fingerprints differ in ten bits, give or take three, so
    the radius passes all but some 6 in 12,000 simulated pairs, and unrelated texts (32 bits) stay out. No band of bits is sure to
    survive that; so shards are the texts that share one of six smallest shingle hashes, each with its BK-tree. Texts with
    equal sets are one member, however many. A first search links texts within the radius whose samples (the SAMPLE smallest
    hashes of each set) put them at most MARGIN standard errors below the similarity, one in 30,000 of the pairs at 0.8
    not among them; only texts that it links make their sets again and send them once, to meet all others of their
    component in a second search that judges whole sets. Texts
    without words form one group; null ids are in no group; an empty table gives no rows. Of an id with several texts,
    each is judged by itself, and a class of copies is named by its first row's id.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = saved(signatures(docs, words_per_shingle=words_per_shingle), "signatures")
    # A class is all rows of one set of shingles; its key is its node and determines the rest.
    least = F.min(F.struct("id", "text_hash")).alias("row")
    classes = checkpointed(signed.groupBy("key").agg(least, *(F.any_value(c).alias(c) for c in ("fp", "bytes", "sample", "routes"))))
    routes = classes.select(F.col("key").alias("id"), F.posexplode("routes").alias("band", "value"))
    shared = routes.groupBy("band", "value").agg(F.count("*").alias("_n")).filter("_n > 1")
    met = checkpointed(routes.join(shared.drop("_n"), ["band", "value"], "left_semi"))
    likely = connected_components(links(classes.select(F.col("key").alias("id"), "fp", F.col("sample").alias("sketch")), met.select("id", "band", "value"), radius=radius, similarity=similarity, sampled=True))
    placed = checkpointed(likely.select(F.col("node").alias("key"), "root").unionByName(likely.select(F.col("root").alias("key"), "root")).distinct())
    chosen = classes.join(placed, "key").select("key", "fp", "bytes", "root", "row.id", "row.text_hash")
    again = docs.join(chosen.select("id", "text_hash"), ["id", "text_hash"], "left_semi")
    sets = signatures(again, words_per_shingle=words_per_shingle, whole=True).dropDuplicates(["key"])
    members = chosen.select("key", "fp").join(sets, "key").select(F.col("key").alias("id"), "fp", "sketch")
    together = chosen.select(F.col("key").alias("id"), "bytes", F.lit(0).alias("band"), F.col("root").alias("value"))
    roots = connected_components(links(members, together, radius=radius, similarity=similarity))
    rooted = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", F.coalesce("root", "key").alias("_root"), F.col("row.id").alias("_least"))
    named = rooted.join(rooted.groupBy("_root").agg(F.min("_least").alias("group")), "_root").select("key", "group")
    return signed.select("id", "text_hash", "key").join(named, "key").filter("id <> group").select(F.col("id").alias(id_col), "text_hash", "group").distinct()
