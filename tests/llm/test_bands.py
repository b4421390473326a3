"""Bands fitted from labelled rows, and the script of a text by its letters."""

import pytest
from pyspark.sql import functions as F

from feedloom.llm import quality


def test_fit(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("N", F.lit(1))
    fitted = quality.fit_bands(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert fitted.keys() == quality.LABELLED_BANDS.by_lang.keys()
    for lang, own in quality.LABELLED_BANDS.by_lang.items():
        got = fitted[lang]
        assert 0.8 * got.least_chars_per_piece <= own.least_chars_per_piece <= got.least_chars_per_piece
        assert 0.95 * got.least_chars_per_token <= own.least_chars_per_token <= got.least_chars_per_token
        assert own.most_byte_share >= got.most_byte_share


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None), (None, None, "en")], "doc_id long, text string, lang string")
    assert quality.fit_bands(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")) == {}


@pytest.mark.parametrize(("text", "script"), [("", "none"), ("12 + 3 = [15]", "none"), ("a1", "latin"), ("×÷~", "none"), ("é", "latin"), ("Привет", "cyrillic"), ("日本語のテキスト", "kana"), ("中文", "han"), ("한국어", "hangul"), ("שלום", "hebrew"), ("नमस्ते", "indic"), ("٣٤", "none")])
def test_script(text, script):
    assert quality.script_of(text) == script
    assert script == "none" or script in quality.LABELLED_BANDS.by_script
