"""Skills that are a column: which of its own list each row's text names, by one automaton for a batch of rows."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from feedloom.functions.text import trim_all

#: Rows whose distinct skills share an automaton, at most.
ROWS = 2048
_WORD = frozenset(string.ascii_letters + string.digits + "_")
_ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _automaton(terms: set[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, t)
    if len(found):
        found.make_automaton()
    return found


def _low(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def _matches(batch: pa.RecordBatch) -> list[list[str] | None]:
    """Of each row (text, its lower case, skills, and of each skill: trimmed, lower case, special) the skills it names."""
    rows = list(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True))
    each = [s for *_, skills in rows for s in skills or () if s["s"]]
    words, parts = _automaton({_low(s["s"]) for s in each if not s["special"]}), _automaton({s["low"] for s in each if s["special"]})
    out: list[list[str] | None] = []
    for text, low, own, skills in rows:
        if own is None:
            out.append(None)
            continue
        if text is None or not any(s["s"] for s in skills):
            out.append([])
            continue
        named: set[str] = set()
        if len(words):
            for end, term in words.iter(_low(text)):
                start = end + 1 - len(term)
                if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                    named.add(text[start : end + 1])
        blind = {_low(n) for n in named}
        inside = {term for _, term in parts.iter(low)} if len(parts) else set()
        fits = lambda s: bool(s["s"]) and (s["low"] in inside if s["special"] else s["s"] in named if len(s["s"]) <= 3 else _low(s["s"]) in blind)  # noqa: B023, E731
        out.append([skill for skill, s in zip(own, skills, strict=True) if skill is not None and fits(s)])
    return out


def with_named(df: DataFrame, text: str, skills: str, name: str) -> DataFrame:
    """df with an array of those of a row's skills (an array column) that its text names, by the rule of
    functions.text.skill_matches(): those with special characters as case-blind substrings, others as whole words,
    case-sensitive if of three characters or fewer.

    A batch's distinct skills are compiled once, and each text streams through that automaton once, however many skills
    there are; limits of words and case are checked on what it finds. Nothing is shuffled. Null skills in a list match
    nothing, a null list stays null, a null text names none; other columns stay."""
    skill = lambda s: F.struct(trim_all(s).alias("s"), F.lower(trim_all(s)).alias("low"), F.regexp_like(F.lower(trim_all(s)), F.lit(r"[^a-z0-9\s]")).alias("special"))
    asked = df.select(F.col(text).alias("_text"), F.lower(text).alias("_low"), F.col(skills).alias("_own"), F.transform(skills, skill).alias("_skills"), F.struct(*df.columns).alias("_row"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(4), pa.array(_matches(part), pa.list_(pa.string()))], names=["_row", "_named"])

    found = asked.mapInArrow(run, StructType([asked.schema["_row"], StructField("_named", ArrayType(StringType()))]))
    return found.select(*(F.col("_row").getField(c).alias(c) for c in df.columns), F.col("_named").alias(name))
