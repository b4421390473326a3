"""WARC archives: records with segments and chunked bodies are written, read back and reassembled."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import checkpointed, fresh_path, sliced

#: A record block longer than this is cut into segments.
SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
#: Bytes of records in one Arrow batch, about.
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PARTS = "record_id string, type string, page_id long, refers_to long, digest string, segment int, origin string, total long, block binary"
#: Between the records of a file lies an empty gzip member. To a reader of gzip it is nothing; to Spark's text source it
#: is the line separator, by which files are written, split and read in any store.
SEPARATOR = gzip.compress(b"", compresslevel=1, mtime=0)
TEXT_OPTIONS = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked framing."""
    out = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload in chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        size = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as its own gzip member, which does not hold the separator."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    whole = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return next(x for x in (gzip.compress(whole, compresslevel=level, mtime=0) for level in range(1, 10)) if SEPARATOR not in x)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _uri(*ids: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, ':'.join(map(str, ids)))}>"


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c > " " and c != "\x7f")


def info_record(archive: int) -> bytes:
    """The record at the head of a file."""
    fields = b"software: feedloom\r\nformat: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _uri("info", archive)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], fields)


def page_records(page: int | None, row: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None, bool] | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations. A page's record is named by
    its id and digest, and by its row as well if others may have both. refers_to: id and url of the response that a
    revisit repeats, and whether these name one record."""
    digest = digest32(payload)
    own = _uri("page", page, digest, *([] if row is None else [row]))
    named = lambda kind, uri: [("WARC-Type", kind), ("WARC-Record-ID", uri), ("WARC-Date", DATE)]
    common = [("WARC-Target-URI", _clean(url)), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", HTTP_TYPE)]
    if refers_to is not None:
        of, where, alone = refers_to
        names = [("WARC-Refers-To", _uri("page", of, digest))] if alone else []
        yield record([*named("revisit", own), *common, ("WARC-Profile", REVISIT_PROFILE), *names, ("WARC-Refers-To-Target-URI", _clean(where)), ("WARC-Refers-To-Date", DATE), ("WARC-Refers-To-Page", of)], REVISIT_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    n = -(-len(block) // segment_bytes)
    if n == 1:
        yield record([*named("response", own), *common], block)
        return
    for k in range(1, n + 1):
        headers = [*named("response", own), *common] if k == 1 else [*named("continuation", _uri("segment", own, k)), ("WARC-Target-URI", _clean(url)), ("WARC-Segment-Origin-ID", own)]
        headers.append(("WARC-Segment-Number", k))
        if k == n:
            headers.append(("WARC-Segment-Total-Length", len(block)))
        yield record(headers, block[(k - 1) * segment_bytes : k * segment_bytes])


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the pages as gzipped WARC files, one for each task, by Spark's text writer: a warcinfo record, then the
    pages' records in order, each its own gzip member. Any reader of gzip and WARC reads them.

    Of pages with equal payloads of at least least_bytes, the one with the smallest id is a response, the others are
    revisits. First pages are found by digests alone, pre-aggregated; the join that tells each page of them can be
    split where one payload is very common. A revisit names the response's record, unless repeated rows have several. Null html counts as empty; a null url becomes an empty header value; of
    repeated rows with the smallest id all are responses; rows with a null id are responses and never referred to.
    """
    keyed = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html")).withColumn("_key", F.unhex(F.sha1("_html")))
    counted = keyed.filter(F.octet_length("_html") >= least_bytes).groupBy("_key", "_id").agg(F.count("*").alias("_n"), F.min("_url").alias("_of_url"))
    least = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n", "_of_url"))).alias("_first")
    many = counted.groupBy("_key").agg(least, F.sum("_n").alias("_all")).filter("_all > 1 and _first is not null").select("_key", "_first")
    later = F.coalesce(F.col("_first._id") != F.col("_id"), F.lit(False))
    alone = F.coalesce(F.col("_first._n"), F.lit(1)) == 1
    unique = ~later & alone & F.col("_id").isNotNull() & (F.octet_length("_html") >= least_bytes)
    told = keyed.join(many, "_key", "left").select("_id", "_url", "_html", F.when(later, F.col("_first._id")).alias("_refers"), F.col("_first._of_url").alias("_of_url"), alone.alias("_alone"), F.when(~unique, F.monotonically_increasing_id()).alias("_row"), F.spark_partition_id().alias("_archive"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        size, begun = 0, False

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
            out.clear()
            size = 0
            return batch

        for batch in sliced(batches, "_html", BATCH_BYTES):
            for page, url, html, refers, of_url, alone, row, archive in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun:
                    out.append(info_record(archive))
                    begun = True
                for r in page_records(page, row, url, html.encode(), None if refers is None else (refers, of_url, alone), segment_bytes):
                    out.append(r)
                    size += len(r)
                    if size >= BATCH_BYTES:
                        yield flush()
        if out:
            yield flush()

    told.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.options(**TEXT_OPTIONS).text(path)


def read_archives(spark, path: str, *, with_payload: bool = True, id_col: str = "page_id") -> DataFrame:
    """One row per page from the archives: id, payload, payload_bytes, payload_digest, record_type, refers_to, whole.

    Records that are whole pass straight through. Segments are shuffled by their origin and stream in order of their
    number: they must be numbered from 1 without a gap and add up to the stated total length, else `whole` is false and
    the payload null. Then chunked framing is undone and the digest verified. Memory is one page. A revisit's byte count
    comes from the page that it refers to.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x in (None, "None") else int(x)
        for batch in sliced(batches, "record", 2 << 20):
            out = []
            for data in batch.column(0).to_pylist():
                h, block = parse_record(data)
                if h["WARC-Type"] != "warcinfo":
                    out.append((h["WARC-Record-ID"], h["WARC-Type"], number(h.get("WARC-Page-ID")), number(h.get("WARC-Refers-To-Page")), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), number(h.get("WARC-Segment-Number")), h.get("WARC-Segment-Origin-ID"), number(h.get("WARC-Segment-Total-Length")), block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()], strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_()], strict=True)], ["_id", "record_type", "refers_to", "payload_digest", "payload", "_bytes", "whole"])

    def decoded(page: int | None, kind: str, refers: int | None, digest: str, block: bytes, whole: bool) -> tuple:
        payload = None
        if kind == "response" and whole:
            payload = unchunked(block.partition(b"\r\n\r\n")[2])
            whole = digest32(payload) == digest
        return page, kind, refers, digest, payload if with_payload else None, None if payload is None else len(payload), whole

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "block", 2 << 20):
            yield told([decoded(*row, True) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        origin, first, parts, fine, total, size = None, None, [], True, None, 0

        def close() -> None:
            nonlocal size
            if origin is not None:
                block = b"".join(parts)
                page, digest = first or (None, "")
                rows.append(decoded(page, "response", None, digest, block, fine and first is not None and len(block) == total))
                size += len(block)

        for batch in sliced(batches, "block", 2 << 20):
            for of, segment, length, block, page, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != origin:
                    close()
                    if size > BATCH_BYTES:
                        yield told(rows)
                        rows, size = [], 0
                    origin, first, parts, fine, total = of, None, [], True, None
                parts.append(block)
                fine = fine and segment == len(parts)
                first = (page, digest) if segment == 1 else first
                total = total if length is None else length
        close()
        if rows:
            yield told(rows)

    out = "_id long, record_type string, refers_to long, payload_digest string, payload binary, _bytes long, whole boolean"
    parts = spark.read.options(**TEXT_OPTIONS).text(path).select(F.col("value").cast("binary").alias("record")).mapInArrow(parse, PARTS)
    alone = parts.filter("segment is null").select("page_id", "type", "refers_to", "digest", "block").mapInArrow(decode, out)
    segments = parts.filter("segment is not null").select(F.coalesce("origin", "record_id").alias("origin"), "segment", "total", "block", "page_id", "digest")
    again = segments.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(reassemble, out)
    return alone.unionByName(again).withColumnRenamed("_id", id_col).withColumnRenamed("_bytes", "payload_bytes")


def with_revisit_bytes(pages: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """Gives each revisit the byte count of the response that it refers to; a response's own count stays."""
    sizes = pages.filter(f"record_type = 'response' and `{id_col}` is not null").groupBy(F.col(id_col).alias("_of"), F.col("payload_digest").alias("_d")).agg(F.max("payload_bytes").alias("_n"))
    joined = pages.join(sizes, (F.col("refers_to") == F.col("_of")) & (F.col("payload_digest") == F.col("_d")), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "_n")).drop("_of", "_d", "_n")


def archived(pages: DataFrame, *, id_col: str = "page_id", **options) -> DataFrame:
    """The pages written as archives in the shared folder and read back, without the payloads themselves."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col=id_col, **options)
    return with_revisit_bytes(checkpointed(read_archives(pages.sparkSession, path, with_payload=False, id_col=id_col).drop("payload")), id_col=id_col)
