"""SentencePiece encoding and decoding by suffix-array matching of a BPE model's pieces."""

from __future__ import annotations

import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import resident, sliced
from feedloom.llm.tokens import vocabulary_path

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
#: Segments in each of the cache's two generations, and pairs of pieces, kept by one Python worker; at so many pairs their
#: cache starts anew. Ids do not depend on it. Longer segments are not kept.
CACHE_SEGMENTS, CACHE_PAIRS, LONG_SEGMENT = 300_000, 2_000_000, 64
#: Bytes of text in a batch, and characters of new segments in one suffix array, about.
BATCH_BYTES, MATCH_CHARS = 4 << 20, 1 << 19
#: A line feed, which no piece joins to anything; else a run of marks, if any, and what follows up to the next cut.
_SEGMENT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class PieceModel:
    """The pieces of a BPE model with byte fallback, and the encoder of batches of texts.

    A text gets a mark in front and one for each space. Pieces hold a mark at their beginning only (or are runs of
    marks), so segments between marks are encoded apart: Arrow splits a batch of texts and numbers the distinct segments,
    and their ids are gathered by number. What the cache does not hold is encoded once, punctuation behind a segment
    apart from it where no piece joins the two. The cache has two generations: what is used moves to the young one, and
    when that is full it becomes the old one, so frequent segments stay and memory is bounded.

    _match(): new segments are joined into one text, whose suffixes are sorted; each piece's occurrences
    are the range that two binary searches give. The occurrences are edges, sorted by their end and relaxed in that
    order: an edge is taken if the last piece before it and its own stay apart when the BPE merges both alone. Exactly
    one edge into each place passes, namely the last piece of the BPE of all text before that place, so the path is the
    library's own result, with no search for a best sum of scores. Characters without a piece fall back to bytes.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(size)]
        self.ids = {self.text[i]: i for i in range(size) if plain[i]}
        self.score = [sp.get_score(i) for i in range(size)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        if any((MARK in p[1:] and p.strip(MARK)) or ("\n" in p and p != "\n") for p in self.ids):
            raise ValueError("the model has pieces across spaces or lines")
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.out = pa.array([bytes([int(self.text[i][3:5], 16)]) if sp.is_byte(i) else self.text[i].replace(MARK, " ").encode() if plain[i] else b"" for i in range(size)], pa.large_binary())
        long = [p for p in self.ids if len(p) > 1 and MARK not in p[1:]]
        self.keys = np.array([p.encode() for p in long])
        self.key_ids = np.array([self.ids[p] for p in long])
        self.key_bytes = np.array([len(p.encode()) for p in long])
        self.width = int(self.key_bytes.max())
        self.upper = np.array([p.encode() + b"\xff" for p in long])
        # Characters that follow each other in a piece; between others nothing merges.
        self.joined = {x + y for p in self.ids for x, y in zip(p, p[1:], strict=False)}
        self.traces: dict[str, tuple] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Known pairs: (left piece + 1, or 0 at a beginning) * span + piece, sorted, and whether they stay apart.
        self.span = size + 0x110000
        self.pair_keys, self.pair_fits = np.array([-1]), np.array([False])

    def merge(self, text: str, steps: list[tuple[float, str, str]] | None = None) -> list[str]:
        """The BPE of one string: the adjacent pair with the best score is merged first, the leftmost of equals. steps
        gets, before each merge, its score and the first and last part so far."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a, a + 1)
        end = len(parts) - 1
        while heap:
            score, a, both = heapq.heappop(heap)
            if parts[a] is None or (b := after[a]) < 0 or parts[a] + parts[b] != both:
                continue
            if steps is not None:
                steps.append((-score, parts[0], parts[end]))
            if b == end:
                end = a
            parts[a], parts[b], after[a] = both, None, after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _ids_of(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in p.encode())
        return np.array(out, dtype="<u4").tobytes()

    def _trace(self, piece: str) -> tuple[bool, list[float], list[str], list[str]]:
        """Whether the BPE of the piece gives it again; and the scores of its merges, one after the other, with the first
        and last part before each and at the end, where the score is that of no merge."""
        if (known := self.traces.get(piece)) is None:
            steps: list[tuple[float, str, str]] = []
            parts = self.merge(piece, steps)
            scores, first, last = zip(*steps, (-np.inf, parts[0], parts[-1]), strict=True)
            known = self.traces[piece] = len(parts) == 1, scores, first, last
        return known

    def _fits(self, left: int, piece: int) -> bool:
        """Whether the BPE of the two pieces joined (of the piece alone at a beginning) gives them again.

        Up to the first merge across, each side's merges are those that it has alone, the better one of both first and
        the left one of equals; so it is enough to ask before each whether the parts that meet would be merged instead."""
        whole, scores, firsts, _ = self._trace(self._name(piece))
        if left < 0 or not whole:
            return whole
        whole, left_scores, _, lasts = self._trace(self._name(left))
        i = j = 0
        while whole:
            here, there = left_scores[i], scores[j]
            if (both := self.ids.get(lasts[i] + firsts[j])) is not None and self.score[both] > here and self.score[both] >= there:
                return False
            if here == there == -np.inf:
                break
            i, j = (i + 1, j) if here >= there else (i, j + 1)
        return whole

    def _name(self, piece: int) -> str:
        """Characters without a piece are numbered beyond the pieces, by code point."""
        return self.text[piece] if piece < len(self.text) else chr(piece - len(self.text))

    def _match(self, segments: list[str]) -> Iterator[bytes]:
        """Ids of each segment, by the suffix array of all of them."""
        joined = "\n".join(segments) + "\n"  # a line feed is in no piece of more than one character
        data = np.frombuffer(joined.encode() + b"\n" * self.width, np.uint8)
        n = len(data) - self.width
        chars = np.flatnonzero((data[:n] & 0xC0) != 0x80)
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.width)[chars]).view(f"S{self.width}").ravel()
        order = np.argsort(suffixes)
        ranked = suffixes[order]
        low, high = np.searchsorted(ranked, self.keys), np.searchsorted(ranked, self.upper)
        counts = high - low
        which = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        start = order[place]
        del suffixes, ranked, place
        number = np.zeros(n + 1, dtype=np.int64)
        number[chars] = np.arange(len(chars))
        number[n] = len(chars)
        # Each character by itself is an edge as well.
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        distinct, inverse = np.unique(points, return_inverse=True)
        alone = np.array([self.ids.get(chr(c), len(self.text) + c) for c in distinct.tolist()])[inverse]
        sizes = np.array([len(s) for s in segments])
        heads = np.cumsum(sizes + 1) - sizes - 1
        head_of = np.repeat(heads, sizes + 1)
        inside = points != 0x0A
        starts = np.concatenate([start, np.flatnonzero(inside)])
        ends = np.concatenate([number[chars[start] + self.key_bytes[which]], np.flatnonzero(inside) + 1])
        pieces = np.concatenate([self.key_ids[which], alone[inside]])
        # Edges by the end's distance from its segment's head: all edges of one distance are relaxed at once.
        far = ends - head_of[starts]
        by_end = np.argsort(far, kind="stable")
        starts, ends, pieces, far = starts[by_end], ends[by_end], pieces[by_end], far[by_end]
        cuts = np.append(np.flatnonzero(np.diff(far, prepend=0)), len(far))
        last, back = np.full(len(points) + 1, -1), np.zeros(len(points) + 1, dtype=np.int64)
        fresh: dict[int, bool] = {}
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            s, e, p = starts[lo:hi], ends[lo:hi], pieces[lo:hi]
            left = np.where(s == head_of[s], -1, last[s])
            keys = (left + 1) * self.span + p
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            fits, unknown = self.pair_fits[at], np.flatnonzero(self.pair_keys[at] != keys)
            for i in unknown.tolist():
                key = int(keys[i])
                if (known := fresh.get(key)) is None:
                    known = fresh[key] = self._fits(int(left[i]), int(p[i]))
                fits[i] = known
            last[e[fits]], back[e[fits]] = p[fits], s[fits]
        if fresh:
            keys = np.append(self.pair_keys, np.fromiter(fresh.keys(), dtype=np.int64))
            by_key = np.argsort(keys)
            self.pair_keys, self.pair_fits = keys[by_key], np.append(self.pair_fits, np.fromiter(fresh.values(), dtype=bool))[by_key]
        ends_here = np.zeros(len(points) + 1, dtype=bool)
        cur = heads + sizes
        while len(cur := cur[cur > head_of[np.minimum(cur, len(points) - 1)]]):
            ends_here[cur] = True
            cur = back[cur]
        path = last[ends_here]
        data = path.astype("<u4").tobytes()
        begin = np.searchsorted(np.flatnonzero(ends_here), heads, side="right")
        bounds = (4 * np.append(begin, len(path))).tolist()
        odd = np.zeros(len(segments) + 1, dtype=np.int64)
        np.add.at(odd, np.searchsorted(begin, np.flatnonzero(path >= len(self.text)), side="right") - 1, 1)
        for i, (lo, hi, strange) in enumerate(zip(bounds, bounds[1:], odd[: len(segments)].tolist(), strict=False)):
            yield self._ids_of([self._name(x) for x in path[lo // 4 : hi // 4].tolist()]) if strange else data[lo:hi]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of new segments."""
        known: dict[str, bytes] = {"": b""}
        young, old, joined = self.young, self.old, self.joined
        whole, tailed = [], []
        for s in new:
            if s == "\n" or s[1:2] == MARK:
                known[s] = self._ids_of(self.merge(s))
                continue
            # Punctuation behind a segment is encoded apart where no piece joins the two.
            core = s.rstrip(string.punctuation)
            if core and core != s and core[-1] + s[len(core)] not in joined:
                tailed.append((s, core, tail := s[len(core) :]))
                for part in (core, tail):
                    if part not in known:
                        if (x := young.get(part) or old.get(part)) is None:
                            whole.append(part)
                        else:
                            known[part] = x
            elif s:
                whole.append(s)
        whole = list(dict.fromkeys(whole))
        sizes, lo = np.cumsum([len(s) for s in whole]), 0
        while lo < len(whole):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + MATCH_CHARS, side="right")))
            known.update(zip(whole[lo:hi], self._match(whole[lo:hi]), strict=True))
            lo = hi
        known.update((s, known[core] + known[tail]) for s, core, tail in tailed)
        return known

    def _ids(self, segments: list[str]) -> list[bytes]:
        """Ids of distinct segments."""
        young, old = self.young, self.old
        out = list(map(young.get, segments))
        missing, new = [i for i, x in enumerate(out) if x is None], []
        for i in missing:
            if (x := old.get(segments[i])) is None:
                new.append(segments[i])
            else:
                young[segments[i]] = out[i] = x
        if len(self.pair_keys) > CACHE_PAIRS:
            self.pair_keys, self.pair_fits = np.array([-1]), np.array([False])
        learnt = self._learn(new)
        for i in missing:
            if out[i] is None:
                out[i] = learnt[segments[i]]
        young.update((s, x) for s, x in learnt.items() if len(s) <= LONG_SEGMENT)
        if len(young) > CACHE_SEGMENTS:
            self.old, self.young = young, {}
        return out

    def _segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(segments of all texts one after the other, empty ones among them, and the end of each text's)."""
        text = lambda x: pa.scalar(x, pa.large_string())
        # A space that is no other's neighbour begins a segment, so Arrow splits at spaces and around line feeds.
        marked = pc.binary_join_element_wise(text(MARK), pc.replace_substring(texts, " ", f" {MARK}"), text(""))
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n "), " ")
        return lists.flatten(), lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()

    def _odd(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The same for texts with runs of marks."""
        split = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.to_pylist()]
        return pa.array([s for segments in split for s in segments], pa.large_string()), np.cumsum([len(segments) for segments in split])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, end of each text's); null texts have none."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        odd = pc.or_(pc.match_substring_regex(texts, f"^ |  |{MARK}"), pc.equal(texts, ""))
        if not pc.any(odd).as_py():
            return self._gathered(*self._segments(texts))
        if pc.all(odd).as_py():
            return self._gathered(*self._odd(texts))
        ids, ends = self._gathered(*self._segments(pc.filter(texts, pc.invert(odd))))
        others, their_ends = self._gathered(*self._odd(pc.filter(texts, odd)))
        plain, rest = iter(np.split(ids, ends[:-1])), iter(np.split(others, their_ends[:-1]))
        each = [next(rest if strange else plain) for strange in odd.to_pylist()]
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def _gathered(self, segments: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments one after the other, and the ends of texts among them."""
        coded = segments.dictionary_encode()
        known = pa.array(self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        upto, data = _flat(known.take(coded.indices))
        return np.frombuffer(data, dtype="<u4"), upto[ends] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(texts) else []

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each part of the ids; bytes that are no UTF-8 become replacement characters."""
        upto, data = _flat(self.out.take(pa.array(ids)))
        bounds = upto[np.append(0, ends)].tolist()
        return [bytes(data[lo:hi]).decode("utf-8", "replace").removeprefix(" ") for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _flat(column: pa.LargeBinaryArray) -> tuple[np.ndarray, memoryview]:
    """(offsets, values) of a column that is no slice of another and has no nulls."""
    _, offsets, data = column.buffers()
    upto = np.frombuffer(offsets, np.int64, len(column) + 1) if len(column) else np.zeros(1, np.int64)
    return upto, memoryview(data or b"")[: upto[-1]]


def model(path: str) -> PieceModel:
    """One model in a Python worker."""
    return resident(("pieces", path), lambda: PieceModel(path))


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """One row per input row: id, ids (little-endian unsigned 32 bits), n_tokens, n_bytes (tokens of byte fallback);
    with_decoded also decoded, the text that the ids give, in the same pass.

    One pass without a shuffle; memory is one batch of texts and bounded caches. Null and empty texts have no ids;
    null ids and repeated rows stay; an empty table gives no rows; other columns are not read."""
    path = path or vocabulary_path(PIECE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in sliced(batches, "_text", BATCH_BYTES):
            ids, ends = m.encode_column(batch.column(1))
            n = np.diff(ends, prepend=0)
            fallback = np.diff(np.append(0, np.cumsum(m.is_byte[ids]))[ends], prepend=0)
            texts = m.decode_column(ids, ends) if with_decoded else [None] * len(ends)
            each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, 4 * ends)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), each.cast(pa.binary()), pa.array(n), pa.array(fallback), pa.array(texts, pa.string())], ["_id", "ids", "n_tokens", "n_bytes", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(run, "_id long, ids binary, n_tokens long, n_bytes long, decoded string").withColumnRenamed("_id", id_col)
    return out if with_decoded else out.drop("decoded")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with a column decoded: the text of its ids. Null ids become null; an empty table stays empty."""
    path = path or vocabulary_path(PIECE_BPE)
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            column = batch.column(at)
            ids = np.frombuffer(b"".join(pc.fill_null(column, b"").to_pylist()), dtype="<u4")
            texts = m.decode_column(ids, np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // 4)
            known = [t if there else None for t, there in zip(texts, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known, pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))

