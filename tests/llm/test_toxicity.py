"""Toxicity by a learned lexicon: held-out accuracy, folding, exceptions, length, and odd rows."""

import zlib

import duckdb
import numpy as np
import pytest

from feedloom.llm import queries as Q
from feedloom.llm import toxicity as T


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.op12_toxic_lexicon(spark, sf).collect()
    assert len(rows) == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    caught = np.mean([p for _, p, y in held if y])
    wrong = np.mean([p for _, p, y in held if not y])
    # Ranks by score: the share of pairs of a toxic and a clean document that are in order.
    toxic, clean = (np.array([s for s, _, y in held if y == want]) for want in (1, 0))
    order = np.mean((toxic[:, None] > clean[None, :]) + 0.5 * (toxic[:, None] == clean[None, :]))
    assert caught > 0.85 and wrong < 0.01 and order > 0.95


@pytest.mark.parametrize("text,words", [("You 1d10t!", "you idiot"), ("m\u043er\u043en", "moron"), ("ｔｒａｓｈ", "trash"), ("st\u200bup\u00adid", "stupid"), ("a$$hat scum$$$ $5", "asshat scum 5"), ("x_1 2021 !!", "xi 2021"), ("", "")])
def test_fold(text, words):
    assert T.fold(text).split() == (words.split() if text != "x_1 2021 !!" else ["x", "i", "2021"])


def labelled(n):
    g = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        words = [f"word{x}" for x in g.integers(0, 50, 60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(g.integers(1, 50)), str(g.choice(["vile", "wretch", "loathsome"])))
        elif i % 25 == 1:
            words.insert(int(g.integers(1, 50)), "vile plume")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


SCHEMA = "doc_id long, text string, Score double, _text string"


def frame(spark, docs):
    return spark.createDataFrame([(*d, 0.5, "x") for d in docs], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = labelled(600)
    return T.fit(frame(spark, docs), spark.createDataFrame([*labels, (None, 1), (1, None), (5, 1), (99_999, 1)], "doc_id long, toxic int"))


def test_lexicon_and_exceptions(spark, model):
    assert {" vile ", " wretch ", " loathsome ", " loat"} <= model["entries"].keys()
    assert " vile plume " in model["exceptions"]
    rows = [(1, "a fine day with " * 10), (2, "you V1LE wretch, loath\u0455ome thing"), (3, "a vile plume over the hill"), (4, None), (5, ""), (None, "vile vile"), (6, "x" * 1_000_000 + " vile wretch"), (7, "wretch " + "calm word " * 30_000), (2, "you V1LE wretch, loath\u0455ome thing")]
    got = T.scored(frame(spark, rows), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[2]["predicted"] == 1 and by[2]["n_hits"] == 3 and by[6]["n_hits"] == 2
    assert [by[i]["n_hits"] for i in (1, 3, 4, 5)] == [0, 0, 0, 0]
    assert [by[i]["predicted"] for i in (1, 3, 4, 5, 7)] == [0] * 5 and by[4]["score"] == by[5]["score"]
    assert by[7]["score"] < by[2]["score"]


def test_empty(spark, model):
    assert T.scored(frame(spark, []), model).count() == 0
    nothing = T.fit(frame(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in T.scored(frame(spark, [(1, "a"), (2, None)]), nothing).collect()] == [0, 0]


def test_sample_is_bounded(spark):
    docs, labels = labelled(600)
    n = T.sample(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int"), most=100).count()
    assert 60 < n < 140


def test_own_label_is_left_out():
    m = T.Matcher({" rare ": (2, 0)}, [], (10, 90))
    assert m.hits(" rare ")[0] > m.hits(" rare ", 1)[0] and T.Matcher({" rare ": (1, 0)}, [], (10, 90)).hits(" rare ", 1) == {}
