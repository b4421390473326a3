"""Every header and empty sentence holds one of the parts by which its pattern is searched for."""

import re

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as X

SAID = [
    ["What you'll do", "what youll bring", "WHAT YOU'LL NEED", "what we're looking for", "What were looking for"],
    ["Key Responsibilities", "responsibilities", "requirements", "Qualifications"],
    ["About the role", "about this position", "Role overview", "job description", "Position Summary"],
    ["An overview of this role", "The Opportunity", "your role", "the role"],
]
EMPTY = ["About us", "About the company", "Who we are", "Our mission is", "An Equal Opportunity Employer", "We do not discriminate", "Are you looking for", "Do you love the challenge", "If you're passionate about", "We'd love to meet you", "if youre passionate about", "wed love to meet you"]


def test_stems():
    for pattern, stems, said in zip(X.SECTIONS, X.SECTION_STEMS, SAID, strict=True):
        for x in said:
            assert re.search(f"(?i)(?:{pattern})", x) and any(s in x.lower() for s in stems)
        assert len(re.findall(r"\|", re.sub(r"\([^)]*\)", "", pattern))) + 1 <= len(said)
    for x in EMPTY:
        assert any(re.search(f"(?i){j}", x) for j in X.JUNK) and any(s in x.lower() for s in X.JUNK_STEMS)


@pytest.mark.parametrize("x,want", [
    (None, None), ("", ""), ("Intro here. Requirements: none of it", "Requirements: none of it"), ("A text. " * 9 + "The role", "A text. " * 9 + "The role"),
    ("Who we are: a firm. We pay. About us. Do you love the challenge of it? Yes.", "We pay. Yes."), ("WHAT YOU'LL DO all day. Key responsibilities", "WHAT YOU'LL DO all day. Key responsibilities"),
])
def test_cases(spark, x, want):
    got = spark.createDataFrame([(x,)], "t string").select(X.strip_boilerplate(F.col("t"))).first()[0]
    assert got == (want.strip() if want else want)
