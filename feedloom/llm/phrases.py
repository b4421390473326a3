"""Substring dedup: recurring passages are confirmed by hashes, compiled into sharded Aho-Corasick automata, and located."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import let_go, mix64, shared_dir, texts_of

#: Bytes of text in one shard of documents, on average; a longer text makes its shard larger.
SHARD_BYTES = 4 << 20
#: Words of an anchor; every window is known by the smallest hash of the anchors in it.
ANCHOR_WORDS = 5
#: Windows that begin in one part of a document; parts are quoted whole, with the words up to their last window's end.
PART_WINDOWS = 116
#: Bytes of passages in one automaton, about; a shard with more gets several, one after the other.
AUTOMATON_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Values of bytes, and the base and factor of the polynomial hashes (odd, so powers of the base can be undone).
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _FACTOR = 0x5851F42D4C957F2D, np.uint64(0xD1342543DE82EF95)
_STEP = 1 << 20
#: What of an anchor's hash is sent; anchors that share it send more windows than need be.
_ANCHOR_BITS = np.uint64((1 << 56) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POWERS[size]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, 64-bit hash) of each word of the data, which is handled in steps cut at white space."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        to = min(len(data), at + _STEP)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        a = np.frombuffer(data, np.uint8, to - at, at)
        edge = np.diff(np.concatenate([[False], ~_SPACE[a], [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _base_powers(len(a) + 1)
        total = np.append(np.uint64(0), np.cumsum(_BYTES[a] * up[: len(a)], dtype=np.uint64))
        starts.append(begin + at)
        hashes.append(mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)))
        at = to
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


class Windows:
    """The word windows of a shard's documents: doc (position in the shard) and hash of each, anchors on demand."""

    def __init__(self, texts: list[bytes], window: int, anchor: int) -> None:
        data = b"\n".join(texts)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.empty(0, np.int64)
        starts, words = word_hashes(data)
        of = np.searchsorted(begins, starts, side="right") - 1
        self.first_word = np.searchsorted(of, np.arange(len(texts) + 1))
        self.n = max(0, len(words) - window + 1)
        self.at = np.flatnonzero(of[: self.n] == of[window - 1 :]) if self.n else np.empty(0, np.int64)
        self.doc = of[self.at]
        self.window, self.anchor, self.words = window, anchor, words

    def _grams(self, k: int) -> np.ndarray:
        n = len(self.words) - k + 1
        out, factor = np.zeros(n, dtype=np.uint64), np.uint64(1)
        for j in range(k):
            out += self.words[j : j + n] * factor
            factor = np.uint64(int(factor) * int(_FACTOR) & 0xFFFFFFFFFFFFFFFF)
        return mix64(out)

    def hashes(self) -> np.ndarray:
        return self._grams(self.window)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """The smallest anchor hash in each window: equal windows have equal anchors, and neighbours mostly share them."""
        if not len(self.at):
            return np.empty(0, np.uint64)
        grams = self._grams(self.anchor)
        least = grams[: self.n].copy()
        for j in range(1, self.window - self.anchor + 1):
            np.minimum(least, grams[j : j + self.n], out=least)
        return least[self.at]


def _least(keys: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys with the smallest id of each, whether there is another id, and the smallest place with that id."""
    if not len(keys):
        return keys, ids, np.empty(0, dtype=bool), ids
    if at is None:
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
        keys, ids = keys[fresh], ids[fresh]
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    least = np.minimum.reduceat(ids, first)
    many = least < np.maximum.reduceat(ids, first)
    if at is None:
        return keys[first], least, many, np.zeros(len(first), dtype=np.int64)
    of_least = ids == np.repeat(least, np.diff(first, append=len(keys)))
    place = np.minimum.reduceat(np.where(of_least, at[order], np.iinfo(np.int64).max), first)
    return keys[first], least, many, place


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each key in known (sorted), or -1."""
    out = np.full(len(keys), -1)
    if not len(known):
        return out
    # Most keys are not there, which a table of their last bits tells sooner than a search.
    last_bits = np.uint64((1 << min(24, (16 * len(known)).bit_length())) - 1)
    table = np.zeros(int(last_bits) + 1, dtype=bool)
    table[(known & last_bits).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(keys & last_bits).astype(np.int64)])
    some = keys[maybe]
    place = np.minimum(np.searchsorted(known, some), len(known) - 1)
    out[maybe] = np.where(known[place] == some, place, -1)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if len(column) else np.empty(0, np.uint64)


def _shard(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids = table.column("_id").combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), texts_of(table.column("_text"))


def quotes(ids: np.ndarray, null: np.ndarray, texts: list[bytes], window: int, owners: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(owner, part, words joined by spaces) of the asked parts of the shard's own documents."""
    order = np.lexsort((parts, owners))
    owners, parts = owners[order], parts[order]
    for doc in np.flatnonzero(np.isin(ids, owners) & ~null).tolist():
        lo, hi = np.searchsorted(owners, [ids[doc], ids[doc] + 1])
        words = texts[doc].split()
        for part in parts[lo:hi].tolist():
            said = words[part * PART_WINDOWS : (part + 1) * PART_WINDOWS + window - 1]
            if len(said) >= window:
                yield int(ids[doc]), part, b" ".join(said)


def _piece(window: int) -> int:
    """Words of a piece. Pieces follow each other in a passage, so that every window of it holds one."""
    return (window + 1) // 2


def _matches(streams: dict[int, str], pieces: Iterator[str], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each document (its words, each with one space around) the words at which one of the pieces of n words begins."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for words in pieces:
        automaton.add_word(f" {words} ", 0)
    automaton.make_automaton()
    for doc, stream in streams.items():
        ends = np.fromiter((end for end, _ in automaton.iter(stream)), dtype=np.int64)
        if len(ends):
            spaces = np.flatnonzero(np.frombuffer(stream.encode("utf-32-le"), np.uint32) == 0x20)
            yield doc, np.searchsorted(spaces, ends) - n


def _pieces(passages: list[str], wanted: np.ndarray, n: int) -> Iterator[str]:
    """The n words of each (passage, first word), which are in order."""
    last, words = -1, []
    for p, at in wanted.T.tolist():
        if p != last:
            last, words = p, passages[p].split(" ")
        yield " ".join(words[at : at + n])


def located(ids: np.ndarray, null: np.ndarray, texts: list[bytes], window: int, passages: list[bytes], owners: np.ndarray) -> dict[int, np.ndarray]:
    """A mask of removed words for each document of the shard that loses any.

    Parts are quoted whole, so most of their windows are in no other document. The documents' windows are looked up among
    those of the passages by hash; an automaton is compiled of a piece of each passage's window that is met, and every
    document with such a window streams through it. The windows around each occurrence are removed if their words are a
    passage's, compared as text, whose owner is smaller. Several passages may hold a window, those of larger owners too:
    the smallest owner's comes first, and others only where its words differ."""
    out: dict[int, np.ndarray] = {}
    if not passages:
        return out
    quoted = Windows(passages, window, window)
    keys = quoted.hashes()
    by_key = np.lexsort((owners[quoted.doc], keys))
    keys = keys[by_key]
    windows = Windows(texts, window, window)
    first = _among(windows.hashes(), keys)
    looked = np.flatnonzero(first >= 0)
    first = first[looked]
    smaller = (owners[quoted.doc[by_key[first]]] < ids[windows.doc[looked]]) & ~null[windows.doc[looked]]
    looked, first = looked[smaller], first[smaller]
    if not len(looked):
        return out
    streams = {d: f" {b' '.join(texts[d].split()).decode()} " for d in np.unique(windows.doc[looked]).tolist()}
    near = np.zeros(len(windows.words) + 1, dtype=bool)
    plain = [p.decode() for p in passages]
    # A piece lies in a window if it begins early enough in it; of each window that is met, the first one.
    piece = _piece(window)
    same_key = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
    met = by_key[np.isin(same_key, same_key[first])]
    of, at = quoted.doc[met], quoted.at[met] - quoted.first_word[quoted.doc[met]]
    wanted = np.stack(np.divmod(np.unique((of << 32) | (-(-at // piece) * piece)), 1 << 32))
    sizes, lo = np.cumsum([len(p) for p in passages]), 0
    while lo < len(plain):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + AUTOMATON_BYTES, side="right")))
        begin, end = np.searchsorted(wanted[0], [lo, hi])
        if begin < end:
            for d, hits in _matches(streams, _pieces(plain, wanted[:, begin:end], piece), piece):
                near[hits + windows.first_word[d]] = True
        lo = hi
    upto = np.cumsum(np.append(0, near))
    held = upto[np.minimum(windows.at[looked] + window - piece + 1, len(near))] > upto[windows.at[looked]]
    looked, first = looked[held], first[held]
    if not len(looked):
        return out

    # Lists of words take many times their text, so few are held at a time; a document's windows follow each other.
    @lru_cache(maxsize=1)
    def words_of(d: int) -> list[str]:
        return streams[d][1:-1].split(" ")

    @lru_cache(maxsize=256)
    def said(p: int) -> list[str]:
        return plain[p].split(" ")

    doc, passage = windows.doc[looked], quoted.doc[by_key[first]]
    at, there = windows.at[looked] - windows.first_word[doc], quoted.at[by_key[first]] - quoted.first_word[passage]

    def among_others(i: int) -> bool:
        """Whether a further passage of window i's hash has its words and a smaller owner."""
        words, key = words_of(int(doc[i]))[int(at[i]) : int(at[i]) + window], keys[first[i]]
        for other in by_key[int(first[i]) + 1 : int(np.searchsorted(keys, key, side="right"))].tolist():
            p = int(quoted.doc[other])
            if owners[p] >= ids[doc[i]]:
                return False
            b = int(quoted.at[other] - quoted.first_word[p])
            if said(p)[b : b + window] == words:
                return True
        return False

    fresh = np.append(True, (np.diff(doc) != 0) | (np.diff(passage) != 0) | (np.diff(at) != 1) | (np.diff(there) != 1))
    run = np.flatnonzero(fresh)
    for lo, hi in zip(run.tolist(), np.append(run[1:], len(looked)).tolist(), strict=True):
        d, words, other = int(doc[lo]), words_of(int(doc[lo])), said(int(passage[lo]))
        a, b, n = int(at[lo]), int(there[lo]), hi - lo
        same = [range(n)] if words[a : a + n + window - 1] == other[b : b + n + window - 1] else [range(i, i + 1) for i in range(n) if words[a + i : a + i + window] == other[b + i : b + i + window] or among_others(lo + i)]
        for part in same:
            if d not in out:
                out[d] = np.zeros(len(words), dtype=bool)
            out[d][a + part.start : a + part.stop + window - 1] = True
    return out


def dedup_substrings(docs: DataFrame, *, window: int = 13, anchor: int = ANCHOR_WORDS, shard_bytes: int = SHARD_BYTES, with_text: bool = False, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, with_text also kept_text (the kept words joined by one
    space; the text as it is if none is removed), and the columns named in carry.

    A word is removed if a window of that many words covers it whose words also start somewhere in a document with a
    smaller id; windows are judged on the input.

    Documents are dealt once into shards of bounded bytes by a hash of the id and the row's number, so that a hot id has
    no shard of its own; all passes read that one shuffle.
    1. Anchors. Each window is known by the smallest hash of its word 5-grams; neighbouring windows mostly share it, so
       a shard sends each of its distinct anchors once, a fifth of the windows. Anchors seen in two shards, or in two
       documents of one, recur.
    2. Confirmation. Windows with recurring anchors send their hash, once for each shard, with the smallest id there
       and its part of that document. Those with two ids are confirmed; the smallest id of all shards is the owner.
    3. Quotation. Documents fall into parts of PART_WINDOWS windows. Each owner's shard quotes a part that holds confirmed
       windows once, in words, and it goes to the shards that sent one of these, each of which gets it once.
    4. Location. Each shard compiles pieces of the passages it got, those that its windows meet by hash, into an
       Aho-Corasick automaton and streams the documents with such windows through it; occurrences are compared with the
       passage's words, and removed where the owner is smaller.
    Hashes choose what is quoted and where it goes; words decide. A hash that two sequences share can only hide a
    repeat. Anchors and windows are combined within a shard first, so a passage that all documents share has a row for
    each shard of that shuffle, and the passes over such rows stream.

    Null texts have no words; texts shorter than a window keep all; rows with a null id lose nothing and own nothing;
    rows with the same id do not remove each other's words; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), "*")

    def name_anchors(table: pa.Table) -> pa.Table:
        let_go()
        ids, null, texts = _shard(table)
        w = Windows(texts, window, anchor)
        fine = ~null[w.doc]
        keys, _, many, _ = _least(w.anchors()[fine], ids[w.doc[fine]])
        # The last bit tells that two documents of the shard have the anchor. Packed rows take fewer bytes in a shuffle.
        return pa.table({"a": _signed(keys & _ANCHOR_BITS), "place": pa.array(table.column("shard")[0].as_py() * 2 + many)})

    def name_windows(table: pa.Table, recurring: pa.Table) -> pa.Table:
        let_go()
        if not table.num_rows or not recurring.num_rows:
            return pa.table({"w": pa.array([], pa.int64()), "place": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        ids, null, texts = _shard(table)
        w = Windows(texts, window, anchor)
        fine = (_among(w.anchors() & _ANCHOR_BITS, np.sort(_unsigned(recurring.column("a")))) >= 0) & ~null[w.doc]
        doc = w.doc[fine]
        keys, least, many, at = _least(w.hashes()[fine], ids[doc], w.at[fine] - w.first_word[doc])
        order = np.lexsort((at, least))  # neighbours are alike, so they take fewer bytes in the shuffle
        keys, least, many, at = keys[order], least[order], many[order], at[order]
        # Shard, whether another document of the shard has the window as well, and the first one's part of its document.
        place = (table.column("shard")[0].as_py() << 32) | (many.astype(np.int64) << 31) | at // PART_WINDOWS
        return pa.table({"w": _signed(keys), "place": pa.array(place), "least": pa.array(least)})

    def quote(table: pa.Table, asked: pa.Table) -> pa.Table:
        let_go()
        parts = asked.column("first").to_numpy() & ((1 << 31) - 1)
        found = list(quotes(*_shard(table), window, asked.column("owner").to_numpy(), parts)) if table.num_rows and asked.num_rows else []
        owners, parts, words = zip(*found, strict=True) if found else ((), (), ())
        of = table.column("shard")[0].as_py() << 32 if table.num_rows else 0
        return pa.table({"owner": pa.array(owners, pa.int64()), "first": pa.array([of | part for part in parts], pa.int64()), "words": pa.array(words, pa.binary())})

    def locate(table: pa.Table, passages: pa.Table) -> pa.Table:
        let_go()
        ids, null, texts = _shard(table) if table.num_rows else (np.empty(0, np.int64), np.empty(0, bool), [])
        masks = located(ids, null, texts, window, passages.column("words").to_pylist(), passages.column("owner").to_numpy()) if len(texts) else {}
        out: list[tuple] = []
        for doc, text in enumerate(texts):
            words = text.split()
            removed = 0
            n = len(words)
            if doc in masks:
                removed = int(masks[doc].sum())
                words = [x for x, gone in zip(words, masks[doc].tolist(), strict=True) if not gone]
            kept = b" ".join(words)
            out.append((None if null[doc] else int(ids[doc]), n, removed, hashlib.sha256(kept).hexdigest(), ((kept if removed else text).decode() if with_text else None)))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        made = {n: pa.array(c, t) for n, c, t in zip(["_id", "n_words", "n_removed", "kept_sha256", "kept_text"], columns, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True)}
        return pa.table(made | {f"_c{i}": table.column(f"_c{i}") for i in range(len(carry))})

    by_shard = dealt.groupBy("shard")
    anchors = by_shard.applyInArrow(name_anchors, "a long, place long")
    recurring = anchors.withColumn("_n", F.count("*").over(Window.partitionBy("a"))).filter("place % 2 = 1 or _n > 1").select(F.shiftright("place", 1).cast("int").alias("shard"), "a")
    windows = by_shard.cogroup(recurring.groupBy("shard")).applyInArrow(name_windows, "w long, place long, least long").filter("w is not null")
    # Read twice, for what is quoted and for who needs it, but alike down to the shuffle by w, so that this runs once.
    same = Window.partitionBy("w")
    # By owner, then place, so that both readings choose the same place whatever order the shuffle gives.
    owned = windows.withColumn("_least", F.min(F.struct("least", "place")).over(same)).select("w", "place", "least", F.col("_least.least").alias("owner"), F.col("_least.place").bitwiseAND(F.lit(~(1 << 31))).alias("first"))
    shard_of = lambda c: F.shiftright(c, 32).cast("int")
    asked = owned.filter((F.col("least") > F.col("owner")) | (F.col("place").bitwiseAND(F.lit(1 << 31)) != 0)).select("owner", "first", shard_of("place").alias("shard")).distinct()
    wanted = asked.select("owner", "first").distinct()
    quoted = by_shard.cogroup(wanted.groupBy(shard_of("first").alias("of"))).applyInArrow(quote, "owner long, first long, words binary")
    passages = asked.join(quoted, ["owner", "first"]).select("shard", "owner", "words")
    result = by_shard.cogroup(passages.groupBy("shard")).applyInArrow(locate, ", ".join(["_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", *(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))]))
    names = [F.col("_id").alias(id_col), "n_words", "n_removed", "kept_sha256"]
    return result.select(*names, *(["kept_text"] if with_text else []), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))
