"""Token ids by the tokenizers library, with a bounded cache of text pieces."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from feedloom.llm.common import resident

BYTE_BPE = "byte_bpe_50k.json"
#: Pieces in each of the cache's two generations; ids do not depend on it. Longer pieces are not kept.
CACHE_PIECES, LONGEST_KEPT = 400_000, 64
#: Longer texts are encoded in parts of about this many characters, cut where a pre-token begins anyway.
PART_CHARS = 4 << 20
#: Pieces whose ids are gathered at a time.
_STEP = 1 << 16
#: New pieces that the library encodes at a time; what it gives for one takes many times its ids.
_LEARNT = 1 << 12


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: in the given folder, or where the public_tokenizers package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Spaces and line feeds that lie together in threes, or in twos at a text's end, and other white space.
_UNUSUAL = r"[\t\x0b\x0c\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{3}|[ \n]{2}\z"
#: Characters that count as white space to some and not to others.
_UNSURE = r"[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{2060}\x{feff}]"
#: White space belongs to what follows it, so a text falls into pre-tokens at every change to white space.
_PIECES = re.compile(r"\s*\S+|\s+")
#: Letters of one pre-token, and ASCII punctuation, which is another behind them; an apostrophe may begin a third kind.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CUT = re.compile(r"(?<=\S)(?= \S)")


class PieceEncoder:
    """Ids of whole texts, the same as tokenizers' encode() of each.

    A byte-level BPE first cuts a text into pre-tokens: where white space begins, before a lone space in front of a
    visible character, and around a line feed there. So Arrow splits a batch of texts at spaces and before line feeds
    and numbers the distinct pieces; each is encoded once while the cache holds it, and the ids are gathered by number.
    A piece without white space in front has an implied space. Texts with unusual white space are cut by a pattern
    into pieces of the same kind; those with an added token's content go to the library whole.

    The cache has two generations: what is used moves to the young one, and when that is full it becomes the old one,
    so frequent pieces stay and memory is bounded.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if not isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) or self.tokenizer.normalizer or self.tokenizer.post_processor:
            raise ValueError("the cuts hold for a plain byte-level BPE only")
        added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = f"{_UNSURE}|{added}" if added else _UNSURE
        self.unusual = f"{_UNUSUAL}|{self.whole}"
        self.model = self.tokenizer.model
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: shown(chr(c))[0][0] for c in range(0xC0, 0x250)}
        self.space = shown(" ")[0][0]
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.feed = self._alone("\n")
        self.cache_pieces = cache_pieces
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces. Words of letters are one pre-token, punctuation behind them another, whatever follows."""
        out: dict[str, bytes] = {}
        young, old, tails, bytes_of, tokenize, space = self.young, self.old, self.tails, self.bytes_of, self.model.tokenize, self.space
        rest = []
        for p in pieces:
            core = p.rstrip(_PUNCTUATION)
            word = core[1:] if core[:1] == "\n" else core
            if word.isascii():
                if not word.isalpha():
                    rest.append(p)
                    continue
                mapped = word
            elif _LETTERS.fullmatch(word):
                mapped = word.translate(self.letters)
            else:
                rest.append(p)
                continue
            ids = (young.get(core) or old.get(core) or out.get(core)) if core != p else None
            if ids is None:
                ids = out[core] = b"".join([bytes_of[t.id] for t in tokenize(space + mapped)]) if word is core else self.feed + b"".join([bytes_of[t.id] for t in tokenize(mapped)])
            if core != p:
                tail = p[len(core) :]
                if (end := tails.get(tail)) is None:
                    if len(tails) > 10_000:
                        tails.clear()
                    end = tails[tail] = b"".join([bytes_of[t.id] for t in tokenize(tail)])
                out[p] = ids + end
        for lo in range(0, len(rest), _LEARNT):
            some = rest[lo : lo + _LEARNT]
            shown = [p if p[:1].isspace() else " " + p for p in some]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(shown, add_special_tokens=False), strict=True):
                out[p] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        young, old = self.young, self.old
        out = list(map(young.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            if (x := old.get(pieces[i])) is None:
                new.append(pieces[i])
            else:
                young[pieces[i]] = out[i] = x
        learnt = self._learn(new)
        for i in missing:
            if out[i] is None:
                out[i] = learnt[pieces[i]]
        young.update((p, x) for p, x in learnt.items() if len(p) <= LONGEST_KEPT)
        if len(young) > self.cache_pieces:
            self.old, self.young = young, {}
        return out

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without anything unusual, and where each text's end. A line feed in front of each is left out
        again: its piece is the text's first, which has no implied space."""
        text = lambda x: pa.scalar(x, pa.large_string())
        marked = pc.replace_substring(pc.binary_join_element_wise(text("\n"), texts, text("")), "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy()
        known = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        n = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        begin, heads, at, ids = np.cumsum(n) - n, bounds[:-1] - bounds[0], 0, []
        ends = np.empty(len(which), dtype=np.int64)
        for lo in range(0, len(which), _STEP):
            source, counts = begin[which[lo : lo + _STEP]], n[which[lo : lo + _STEP]]
            own = heads[np.searchsorted(heads, lo) : np.searchsorted(heads, lo + _STEP)] - lo
            counts[own] = 0
            mark = heads[np.searchsorted(heads, lo - 1) : np.searchsorted(heads, lo + _STEP - 1)] + 1 - lo
            source[mark] += 1
            counts[mark] -= 1
            upto = np.cumsum(counts)
            ids.append(flat[np.repeat(source - (upto - counts), counts) + np.arange(upto[-1])])
            ends[lo : lo + _STEP] = upto + at
            at += int(upto[-1])
        return np.concatenate(ids), ends[bounds[1:] - bounds[0] - 1]

    def _odd(self, text: str) -> bytes:
        """Ids of a text with unusual white space; a piece keeps the white space in front of it, but for a lone space."""
        pieces = _PIECES.findall(text)
        keys = [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else p for p in pieces]
        first = b""
        if not keys[0][0].isspace() and pieces[0][0] != " ":
            first, keys = self._alone(keys[0]), keys[1:]
        distinct = list(dict.fromkeys(keys))
        return first + b"".join(map(dict(zip(distinct, self._ids(distinct), strict=True)).__getitem__, keys))

    def encode_column(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, end of each text's); null texts have none."""
        texts = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        odd = pc.or_(pc.match_substring_regex(texts, self.unusual), pc.greater(pc.utf8_length(texts), PART_CHARS))
        if not pc.any(odd).as_py():
            return self._regular(texts)
        plain = pc.filter(texts, pc.invert(odd))
        ids, ends = self._regular(plain) if len(plain) else (np.empty(0, "<u4"), np.empty(0, np.int64))
        rest = iter(np.split(ids, ends[:-1]))
        each = [self._one(texts[i].as_py()) if strange else next(rest) for i, strange in enumerate(odd.to_pylist())]
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def _one(self, text: str) -> np.ndarray:
        if pc.match_substring_regex(pa.array([text], pa.large_string()), self.whole)[0].as_py():
            return np.frombuffer(self._alone(text), dtype="<u4")
        parts, at = [], 0
        while at < len(text):
            m = _CUT.search(text, at + PART_CHARS)
            end = m.start() if m else len(text)
            part = pa.array([text[at:end]], pa.large_string())
            at = end
            parts.append(np.frombuffer(self._odd(part[0].as_py()), dtype="<u4") if pc.match_substring_regex(part, self.unusual)[0].as_py() else self._regular(part)[0])
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.large_string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])] if len(texts) else []


def encoder(path: str) -> PieceEncoder:
    """One encoder in a Python worker."""
    return resident(("ids", path), lambda: PieceEncoder(path))


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and ends as encode_column() gives them, with end_id behind each text."""
    return np.insert(ids, ends, end_id).astype("<u4"), ends + np.arange(1, len(ends) + 1)
