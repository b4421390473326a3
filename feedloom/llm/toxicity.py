"""Toxicity: a weighted lexicon, learned from labels, matched by Aho-Corasick in folded texts and scaled by their length."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import checkpointed, sliced

#: Labelled rows from which the lexicon is fitted, about, chosen by a hash of the id; the bound on what reaches the driver.
LABELLED_ROWS = 20_000
#: Entries of the lexicon, those of the highest weights, and of its exceptions.
MOST_ENTRIES, MOST_EXCEPTIONS = 20_000, 5_000
#: Lengths of the beginnings of words that are entries beside whole words.
STEMS = range(4, 9)
#: The least weight of an entry (natural log of the odds of toxic and other documents), the least number of toxic documents
#: that have it, and the least number of clean documents that an exception needs.
LEAST_WEIGHT, LEAST_TOXIC, LEAST_CLEAN = 1.5, 2, 3
#: Words added to a text's length, so that one hit in few words is no certainty.
LENGTH_FLOOR = 20

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
_LOOKS_FROM = "абвеѕіјкмнорстухѵԁԛԝҺһ" + "αβγεηικνορτυχω" + "ıɑɡʏ"
_LOOKS_TO = "abbesijkmhopctyxvdqwhh" + "abyenikvoptuxw" + "iagy"
_DIGITS = str.maketrans("013457", "oieast")
_SIGNS = str.maketrans("@$!", "asi")
_INVISIBLE = "­​‌‍⁠﻿"

_LOOKS = str.maketrans(_LOOKS_FROM, _LOOKS_TO, _INVISIBLE)
_TO_LOOK_AT = re.compile(f"[{_LOOKS_FROM}{_INVISIBLE}]")
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!]+(?=[^\W\d_])")
_MIXED = re.compile(r"\b(?=\w*[^\W\d_])\w*[013457]\w*\b")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text's words, with one space before, between and after: lower case, compatibility forms and look-alikes as plain
    letters, digits in words with letters and signs between letters as the letters they stand for."""
    text = unicodedata.normalize("NFKC", text).lower()
    if _TO_LOOK_AT.search(text):
        text = text.translate(_LOOKS)
    text = _SIGN.sub(lambda m: m.group().translate(_SIGNS), text)
    text = _MIXED.sub(lambda m: m.group().translate(_DIGITS), text)
    return f" {' '.join(_WORD.findall(text))} "


def terms_of(stream: str) -> set[str]:
    """What may be an entry: whole words, with a space on both sides, and their beginnings, with one before."""
    words = set(stream.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) >= k}


def log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


class Matcher:
    """An automaton of entries (term: toxic and clean documents with it) and exception phrases."""

    def __init__(self, entries: dict[str, tuple[int, int]], exceptions: list[str], sizes: tuple[int, int]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, counts in entries.items():
            self.automaton.add_word(term, (len(term), counts))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.filled, self.sizes = len(self.automaton) > 0, sizes
        if self.filled:
            self.automaton.make_automaton()

    def hits(self, stream: str, label: int | None = None) -> dict[int, float]:
        """The weight of each place (a word's space) where an entry matches, the highest of those that do, without those in
        an exception. With the label of a text that was learned from, weights are those without that text."""
        out: dict[int, float] = {}
        if not self.filled:
            return out
        exempt: list[tuple[int, int]] = []
        own = (label == 1, label == 0) if label is not None else (0, 0)
        for end, (size, counts) in self.automaton.iter(stream):
            start = end - size + 1
            if counts is None:
                exempt.append((start, end))
                continue
            toxic, clean = counts[0] - own[0], counts[1] - own[1]
            weight = log_odds(toxic, clean, self.sizes[0] - own[0], self.sizes[1] - own[1]) if toxic > 0 else 0.0
            if weight >= LEAST_WEIGHT and weight > out.get(start, 0.0):
                out[start] = weight
        for start, end in exempt:
            for at in [a for a in out if start <= a < end]:
                del out[at]
        return out


def features(found: dict[int, float], stream: str) -> tuple[float, float]:
    """Of hits in a folded text: their weights, and the squares of these, for each hundred words, on a log scale. Squares
    tell a few sure hits from many faint ones; both fall with length, so one hit in a long text is little."""
    size = stream.count(" ") - 1 + LENGTH_FLOOR
    return math.log1p(100 * sum(found.values()) / size), math.log1p(100 * sum(w * w for w in found.values()) / size)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, the constant first, of a logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    keep = np.diag([1e-6, *[penalty] * (x.shape[1] - 1)])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return b


def sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label) of all labelled ids, or of about `most` of them, chosen by a hash. Rows without id or label are left
    out; of several labels of an id the highest counts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = known.count()
    picked = known if total <= most else known.filter(F.pmod(F.xxhash64("_id"), F.lit(total)) < most)
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), "_id").select("text", "label")


def _counts(batches: Iterable[pa.RecordBatch], terms: Callable[[str], set[str]]) -> Iterator[pa.RecordBatch]:
    """Each term's number of toxic and of clean documents, combined within a task as far as memory should be used for it."""
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        each = list({*found[0], *found[1]})
        return pa.RecordBatch.from_arrays([pa.array(each, pa.string()), *(pa.array([c[t] for t in each], pa.int64()) for c in (found[1], found[0]))], names=["term", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[1 if label else 0].update(terms(fold(text)))
            if len(found[0]) + len(found[1]) > 1_000_000:
                yield out()
                found = (Counter(), Counter())
    yield out()


def _counted(rows: DataFrame, make_terms: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    return rows.mapInArrow(lambda batches: _counts(batches, make_terms()), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _pairs(matcher: Matcher) -> Callable[[str], set[str]]:
    """Of a folded text each hit's word with the one before and with the one after."""

    def pairs(stream: str) -> set[str]:
        out = set()
        for at in matcher.hits(stream):
            end = stream.index(" ", at + 1)
            before, after = stream.rfind(" ", 0, at), stream.find(" ", end + 1)
            out |= ({stream[before : end + 1]} if before >= 0 else set()) | ({stream[at : after + 1]} if after > 0 else set())
        return out

    return pairs


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> dict:
    """A lexicon of a bounded sample of labelled rows: entries, exceptions, and coefficients of a score.

    Entries are words and beginnings of words, folded, that toxic documents have more often by a factor; weights are log
    odds of documents. Exceptions are pairs of words, one of them an entry's, that only clean documents have. The score's
    coefficients are fitted to features that leave the text's own label out of the weights, so that chance entries of few
    documents don't look certain. Without labels of both kinds nothing is toxic."""
    rows = checkpointed(sample(docs, labels, most))
    sizes = tuple(rows.filter(F.col("label") == y).count() for y in (1, 0))
    if not all(sizes):
        return {"entries": {}, "exceptions": [], "sizes": sizes, "coefficients": [-30.0, 0.0, 0.0]}
    weight = F.log((F.col("toxic") + 0.5) / (sizes[0] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[1] + 1))
    likely = _counted(rows, lambda: terms_of).filter(F.col("toxic") >= LEAST_TOXIC).withColumn("weight", weight).filter(F.col("weight") >= LEAST_WEIGHT)
    entries = {r["term"]: (r["toxic"], r["clean"]) for r in likely.orderBy(F.desc("weight"), "term").limit(MOST_ENTRIES).collect()}
    clean = _counted(rows, lambda: _pairs(Matcher(entries, [], sizes))).filter(f"toxic = 0 and clean >= {LEAST_CLEAN}")
    exceptions = [r["term"] for r in clean.orderBy(F.desc("clean"), "term").limit(MOST_EXCEPTIONS).collect()]

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, exceptions, sizes)
        for batch in batches:
            streams = [(fold(text), label) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            found = [features(matcher.hits(stream, label), stream) for stream, label in streams]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)), batch.column(1)], names=["weight", "square", "label"])

    x = np.array(sorted(tuple(r) for r in rows.mapInArrow(measured, "weight double, square double, label int").collect()), dtype=np.float64)
    return {"entries": entries, "exceptions": exceptions, "sizes": sizes, "coefficients": logistic(x[:, :2], x[:, 2]).tolist()}


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 from 0.5 on), n_hits, and the columns of carry.

    Every whole text streams once through the model's automaton; nothing is shuffled and no row waits for another. The
    model is bounded by MOST_ENTRIES and MOST_EXCEPTIONS. Null and empty texts have no hits; a very long text makes a batch
    of its own; repeated rows and null ids are scored like others; an empty table gives no rows; other columns are not
    read."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), *(c.alias(f"_c{i}") for i, c in enumerate(carry)))
    schema = ", ".join([f"_id {rows.schema['_id'].dataType.simpleString()}", "score double, n_hits long", *(f"_c{i} {rows.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(carry)))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model["entries"], model["exceptions"], model["sizes"])
        b = model["coefficients"]
        for batch in sliced(batches, "_text", 8 << 20):
            scores, hits = [], []
            for text in batch.column(1).to_pylist():
                stream = fold(text)
                found = matcher.hits(stream)
                weight, square = features(found, stream)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * weight + b[2] * square)))))
                hits.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), *batch.columns[2:]], names=["_id", "score", "n_hits", *(f"_c{i}" for i in range(len(carry)))])

    return rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", *(F.col(f"_c{i}") for i in range(len(carry))))
