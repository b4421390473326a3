"""Near copies of long texts and of texts with repeated lines, against exact sets of five-word shingles."""

import random

import pytest

from feedloom.llm import simhash


def groups(spark, texts):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.group for r in simhash.near_duplicate_groups(df).collect()}


@pytest.mark.parametrize("length", [200, 500, 1000])
def test_long_near_copies_exactly(spark, length):
    """Pairs with a similarity of 0.75 to 0.85: linked from 0.8 on, and only these."""
    rng, texts, want = random.Random(length), [], {}
    for base in range(60):
        words = [f"w{base}x{i}y{rng.randrange(10_000)}" for i in range(length)]
        aim = rng.uniform(0.75, 0.85)
        end = round((length - 4) * (1 - aim) / (1 + aim))
        copy = words[: length - end] + [f"v{base}z{i}" for i in range(end)]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, copy))
        if 10 * len(a & b) >= 8 * len(a | b):
            want[len(texts) + 1] = len(texts)
        texts += [words, copy]
    assert 15 < len(want) < 45
    assert groups(spark, texts) == want


@pytest.mark.parametrize(("length", "line", "times"), [(300, 12, 15), (1000, 15, 20), (1000, 15, 40)])
def test_copies_with_a_repeated_line(spark, length, line, times):
    rng, texts = random.Random(times), []
    for base in range(30):
        words = [f"w{base}x{rng.randrange(10**6)}" for _ in range(length)]
        texts += [words, words + words[-line:] * times]
    assert groups(spark, texts) == {i: i - 1 for i in range(1, 60, 2)}
