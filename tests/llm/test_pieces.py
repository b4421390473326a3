"""The piece encoder: the library's ids for any text, and work only for what is new."""

import itertools
import random

import pytest
import sentencepiece

from feedloom.llm import pieces
from feedloom.llm.tokens import vocabulary_path

PATH = vocabulary_path(pieces.PIECE_BPE)
ODD = ["", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a \n b", "\n\nab\n", "▁", "a▁b ▁ c", "word!?...", "'twas (so-called) \"x\"!!", "!!!", "...word", "naïve,élan;", "日本語 テキスト。", "🙂 🙂🙂!", "tab\tand\r\nline", "x=1;y=[2]", "-- a --", "word.\nword,\n", "0.5 1,000 3%%%", "\x00 \x7f", "A" * 300 + "!" * 300]


def test_ids_of_odd_texts_are_the_librarys():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["a", "the", "Er", "é", "ß", " ", " ", "  ", "\n", ".", ",", "!?", "'", "-", "▁", "7", "中"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    m = pieces.PieceModel(PATH)
    for texts in (ODD, mixed, ODD + mixed):
        got = m.encode(texts)
        assert [list(memoryview(x).cast("I")) for x in got] == [sp.encode(t) for t in texts]


def test_pairs_stay_apart_as_their_whole_bpe_says():
    m, rng = pieces.PieceModel(PATH), random.Random(5)
    ids = [i for i, p in enumerate(m.text) if p in m.ids]
    short = [i for i in ids if len(m.text[i]) <= 3]
    for _ in range(20_000):
        left, piece = rng.choice(rng.choice([ids, short])), rng.choice(rng.choice([ids, short]))
        names = [m.text[left], m.text[piece]]
        assert m._fits(left, piece) == (m.merge("".join(names)) == names)


@pytest.mark.parametrize("kept", [40, 300_000])
def test_frequent_and_punctuated_segments_are_matched_once(monkeypatch, kept):
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", kept)
    m, matched = pieces.PieceModel(PATH), []
    inner = m._match
    monkeypatch.setattr(m, "_match", lambda segments: (matched.extend(segments), inner(segments))[1])
    rare = ("".join(x) for x in itertools.product("qxzj", repeat=4))
    for end in ("", "!", "!?", "...", '",', "):", "%%%", ";", ".", ","):
        m.encode(["frequent" + end + " " + " ".join(itertools.islice(rare, 15))])
    assert sum("frequent" in s for s in matched) == 1
