"""The archives are WARC files for any reader: here gzip and a few lines."""

import glob
import gzip
import random

import pytest

from feedloom.llm import warc


def records_of(data):
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        at = end + 4 + len(block) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
        yield headers, block


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{i}.example/ a\t\x7fb\r\n", "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), 10, 13, 31, 0x8B])) for _ in range(rng.choice([0, 5, 400, 20_000]))), 1) for i in range(60)]
    rows += [(i + 300, "later", rows[i][2], 2) for i in (1, 2, 3)] + [(7, "again", rows[7][2], 2), (7, "again", rows[7][2], 2), (100, None, rows[7][2], 2), (101, "u", None, 3), (None, None, None, 3), (200, "long", "x<é>" * 400_000, 4)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record int").repartition(3)


def test_a_plain_reader_reads_them(pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "w"))
    files = [f for f in glob.glob(str(tmp_path / "w" / "part-*"))]
    found = []
    for f in files:
        of = list(records_of(gzip.open(f).read()))
        assert of[0][0]["WARC-Type"] == "warcinfo" and of[0][0]["Content-Type"] == "application/warc-fields"
        found += of[1:]
    ids = [h["WARC-Record-ID"] for h, _ in found]
    assert len(set(ids)) == len(ids)
    kinds = {h["WARC-Record-ID"]: h for h, _ in found}
    revisits = [(h, b) for h, b in found if h["WARC-Type"] == "revisit"]
    assert revisits
    for h, block in revisits:
        assert block.endswith(b"\r\n\r\n") and b"chunked" not in block
        if h["WARC-Refers-To-Page"] == "7":  # two rows have this id and payload, so no one record is named
            assert "WARC-Refers-To" not in h
            continue
        origin = kinds[h["WARC-Refers-To"]]
        assert origin["WARC-Type"] == "response" and origin["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
        assert origin["WARC-Page-ID"] == h["WARC-Refers-To-Page"]
    for h, _ in found:
        assert h["WARC-Type"] == "continuation" or h["Content-Type"] == "application/http; msgtype=response"
        assert not set(h["WARC-Target-URI"]) & set(" \t\r\n\x7f")


def test_round_trip(spark, pages, tmp_path):
    warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode(), r.whole) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    rows, first = pages.collect(), {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", 10**9), r.page_id)
    want = []
    for r in rows:
        again = r.page_id is not None and first[r.html or ""] != r.page_id
        want.append((r.page_id or -1, "revisit" if again else "response", first[r.html or ""] if again else None, None if again else r.html or "", True))
    key = lambda x: tuple(map(repr, x))
    assert sorted(got, key=key) == sorted(want, key=key)
