"""Quality rules: base counts of a text, and tokeniser fertility with rejection bands per language or script."""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import resident, sliced
from feedloom.llm.tokens import vocabulary_path

PIECE_BPE = "piece_bpe_32k.model"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
SPACES = " \t\n\v\f\r"
#: Words kept by one Python worker; at this many the cache starts anew. Results do not depend on it.
CACHE_WORDS = 400_000

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Band:
    """What a text of one language or script may measure; a text outside any of these is rejected."""

    least_chars_per_piece: float
    least_chars_per_token: float
    most_byte_share: float
    least_entropy: float


@dataclass(frozen=True)
class Bands:
    """Bands by lang, else by the script of most letters, else the default. Texts of fewer words than least_words
    measure too little to be judged by fertility. Entropy is in units of its largest value for the token count."""

    by_lang: dict[str, Band] = field(default_factory=dict)
    by_script: dict[str, Band] = field(default_factory=dict)
    default: Band = Band(0.6, 0.6, 0.6, 0.35)
    least_words: int = 50

    def of(self, lang: str | None, script: str) -> Band:
        return self.by_lang.get(lang or "") or self.by_script.get(script) or self.default


#: Bands of languages: at or below what fit_bands() gives for the 3,980 labelled rows of the 0.1-scale sample, lowered by
#: hand where the lowest good texts lie, so that the rules keep clean texts; symbols, shouting and word salad cost more
#: tokens. Bands of scripts are not fitted, since no labelled text is written in them: half of what prose measures where
#: a vocabulary has the script's words or syllables, less where it falls back to bytes.
LABELLED_BANDS = Bands(
    by_lang={
        "en": Band(1.80, 2.04, 0.2, 0.35),
        "de": Band(1.75, 2.14, 0.2, 0.35),
        "es": Band(1.70, 1.91, 0.2, 0.35),
        "fr": Band(1.60, 1.87, 0.2, 0.35),
    },
    by_script={
        "latin": Band(1.2, 1.2, 0.3, 0.35),
        "greek": Band(0.6, 0.8, 0.5, 0.35),
        "cyrillic": Band(1.0, 1.0, 0.4, 0.35),
        "hebrew": Band(0.5, 0.6, 0.6, 0.35),
        "arabic": Band(0.5, 0.6, 0.6, 0.35),
        "indic": Band(0.25, 0.4, 0.9, 0.3),
        "thai": Band(0.25, 0.3, 0.9, 0.3),
        "kana": Band(0.4, 0.5, 0.8, 0.35),
        "han": Band(0.3, 0.4, 0.9, 0.35),
        "hangul": Band(0.3, 0.5, 0.9, 0.35),
        "none": Band(0.6, 0.6, 0.3, 0.35),
    },
)

#: Code point ranges of scripts' letters.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F))),
    ("greek", ((0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x386, 0x386), (0x388, 0x3FF))),
    ("cyrillic", ((0x400, 0x481), (0x48A, 0x52F))),
    ("hebrew", ((0x5D0, 0x5F2),)),
    ("arabic", ((0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FC))),
    ("indic", ((0x904, 0x963), (0x971, 0x9E3), (0xA05, 0xA65), (0xA85, 0xAE3), (0xB05, 0xB63), (0xB83, 0xBD7), (0xC05, 0xC63), (0xC85, 0xCE3), (0xD05, 0xD63), (0xD85, 0xDDF))),
    ("thai", ((0xE01, 0xE3A), (0xE40, 0xE4E))),
    ("kana", ((0x3041, 0x3096), (0x30A1, 0x30FA))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
    ("hangul", ((0xAC00, 0xD7A3),)),
)
_ASCII_LETTER = re.compile("[A-Za-z]")


def script_of(text: str) -> str:
    """The script of most letters, the first of equals; 'none' without any."""
    if text.isascii():
        return "latin" if _ASCII_LETTER.search(text) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = [(sum(int(((points >= lo) & (points <= hi)).sum()) for lo, hi in ranges), name) for name, ranges in SCRIPTS]
    most = max(counts, key=lambda x: x[0])
    return most[1] if most[0] else "none"


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(covered, i)
                covered = i + 3
    return len(words), chars, symbols, dup, repeated


class Fertility:
    """Measures words by public vocabularies: a SentencePiece model with byte fallback, and a byte-level BPE."""

    def __init__(self, piece_path: str, bpe_path: str, cache_words: int = CACHE_WORDS) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(bpe_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.vocab_size())])
        self.ids: dict[str, bytes] = {}
        self.tokens: dict[str, int] = {}
        self.cache_words = cache_words

    def learn(self, words: set[str]) -> None:
        new = {w for w in words if w not in self.ids}
        if len(self.ids) + len(new) > self.cache_words:
            self.ids.clear()
            self.tokens.clear()
            new = words
        part = list(new)
        self.ids.update(zip(part, (np.array(x, dtype="<u2").tobytes() for x in self.piece.encode(part, num_threads=1)), strict=True))
        self.tokens.update(zip(part, (len(self.bpe.encode_ordinary(" " + w)) for w in part), strict=True))

    def measure(self, words: list[str], chars: int) -> tuple[float, float, float, float]:
        """chars per piece, chars per BPE token, byte-fallback share and entropy (of the largest for so many pieces)."""
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), dtype="<u2")
        n = len(ids)
        if not n:
            return 0.0, 0.0, 0.0, 0.0
        counts = np.bincount(ids)
        counts = counts[counts > 0]
        entropy = math.log2(n) - float((counts * np.log2(counts)).sum()) / n
        return chars / n, chars / sum(map(self.tokens.__getitem__, words)), float(self.is_byte[ids].sum()) / n, entropy / math.log2(n) if n > 1 else 0.0


def fertility(piece_path: str, bpe_path: str) -> Fertility:
    """One in a Python worker."""
    return resident(("fertility", piece_path, bpe_path), lambda: Fertility(piece_path, bpe_path))


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("chars_per_piece", pa.float64()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy", pa.float64()), ("kept", pa.bool_())]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_per_piece double, chars_per_token double, byte_share double, entropy double, kept boolean"
#: Texts below this many words, or of which more than half the words repeat, fail before any fertility is measured.
BASE_WORDS, BASE_REPEAT = 50, 50


def with_quality(docs: DataFrame, bands: Bands, *, piece_path: str | None = None, bpe_path: str | None = None, text_col: str = "text", lang_col: str | None = "lang", prefix: str = "") -> DataFrame:
    """The input's columns and the measures of each whole text, base_failed and kept, each named with the prefix.

    One pass without a shuffle; a worker keeps what it knows of words, up to a bound. A text is kept if it passes the
    base rules and lies inside its band. Null texts have no words and fail; a null lang is judged by script; very long
    texts are measured whole; repeated rows get equal results; an empty table stays empty. A column of the input with
    the name of a measure (letter case aside) is an error unless a prefix tells them apart.
    """
    piece_path, bpe_path = piece_path or vocabulary_path(PIECE_BPE), bpe_path or vocabulary_path(MULTI_BPE)
    names = [prefix + n for n, _ in FIELDS] + [prefix + "base_failed"]
    if clash := {c.lower() for c in docs.columns} & {n.lower() for n in names}:
        raise ValueError(f"columns exist already: {sorted(clash)}; give a prefix")
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def measured_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        measures = fertility(piece_path, bpe_path)
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * len(texts)
        split = [_WORDS.findall(t) for t in texts]
        measures.learn(set().union(*split))
        rows = []
        for text, lang, words in zip(texts, langs, split, strict=True):
            base = base_counts(text, words)
            values = measures.measure(words, base[1])
            failed = base[0] < BASE_WORDS or 100 * base[4] > BASE_REPEAT * base[0]
            band = bands.of(lang, "" if lang in bands.by_lang else script_of(text))
            inside = base[0] < bands.least_words or (values[0] >= band.least_chars_per_piece and values[1] >= band.least_chars_per_token and values[2] <= band.most_byte_share and values[3] >= band.least_entropy)
            rows.append((*base, *values, not failed and inside, failed))
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [t for _, t in FIELDS] + [pa.bool_()], strict=True))], [*batch.schema.names, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, 2 << 20):
            yield measured_batch(batch)

    from pyspark.sql import types as T

    measured = T.StructType([*docs.schema.fields, *(T.StructField(prefix + f.name, f.dataType) for f in T._parse_datatype_string(SCHEMA + ", base_failed boolean").fields)])
    return docs.mapInArrow(run, measured)


def fit_bands(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.005, most_languages: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Band]:
    """Bands by language from labelled rows (id, quality 1 for good): what the given share of a language's good texts that
    pass the base rules falls below, and for the byte share, what that share exceeds. The entropy's bound is the default.

    All labelled rows count; one row for each language reaches the driver, at most most_languages of them, those with the
    most good texts first. Rows without a language, and labels that are null, do not count."""
    good = labels.filter("quality = 1").select(id_col).distinct()
    chosen = docs.select(id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull()).join(good, id_col, "left_semi")
    found = with_quality(chosen, Bands(), text_col=text_col, lang_col=lang_col, prefix="_q_").filter("not _q_base_failed")
    low = lambda c, q: F.percentile(F.col(f"_q_{c}"), F.lit(q))
    rows = found.groupBy(lang_col).agg(F.count("*").alias("n"), low("chars_per_piece", quantile).alias("p"), low("chars_per_token", quantile).alias("t"), low("byte_share", 1 - quantile).alias("b")).orderBy(F.desc("n"), lang_col).limit(most_languages)
    return {r[lang_col]: Band(r["p"], r["t"], r["b"], Bands().default.least_entropy) for r in rows.collect()}
