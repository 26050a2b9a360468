"""WARC writing and segment reassembly.

Writing: each page is an HTTP response with a chunked body. Blocks above ``segment_bytes`` are
split: a first record with segment number 1 and continuation records that name it as origin, the
last with the total length. Of records with equal payloads of at least ``min_revisit`` bytes, the
one with the smallest page id is the response; the others are revisit records without a body.
Records go through Spark's text writer (the text's line separator is the two line ends after
each record), so archives land wherever Spark can write, gzip-compressed, a bounded number of
records to a file.

Reading: each archive is parsed record by record. Segments whose set is complete within their
archive are joined there; only the rest are shuffled, grouped by origin, ordered by segment
number. The total length is verified, the chunked framing decoded and the payload's digest
compared with the header. Archives may come from elsewhere: a record whose id does not name a page has a null
page_id and keeps its record_id; what cannot be read (no length, cut short, segments missing, framing broken,
another digest than stated) gives a row with its error and goes on at the next record.

Defined results: null html: empty payload; null url: empty target. A null page id is carried: its record is a
revisit if a page with an id has the same payload of at least ``min_revisit`` bytes, else a response. Rows
that repeat a page id and payload are one record written several times: as many rows come back.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import holds, new_folder, slot_bits, slot_of, taken_slots, written

SEGMENT_BYTES = 16384
CHUNK_BYTES = 4096
MIN_REVISIT = 100
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
_URI = re.compile(rb"<urn:lexilake:page:(-?\d*):([0-9a-f]*)(?::(\d+))?>")


def _cuts(data: bytes, size: int) -> list[int]:
    """Ends of pieces of at most ``size`` bytes that do not split a character."""
    out, at = [], 0
    while len(data) - at > size:
        end = at + size
        while end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(end)
        at = end
    return [*out, len(data)]


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[str]:
    """The WARC records of one page, without the separator after each."""
    uri = f"urn:lexilake:page:{'' if page_id is None else page_id}:{digest[:16]}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Record-ID", f"<{uri}>"), ("WARC-Target-URI", target), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    start = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        head = [("WARC-Type", "revisit"), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:lexilake:page:{refers_to}:{digest[:16]}>")]
        return [_record(head, f"{start}Content-Length: {len(payload)}\r\n\r\n".encode())]
    parts, at = [start.encode(), b"Transfer-Encoding: chunked\r\n\r\n"], 0
    for end in _cuts(payload, CHUNK_BYTES):
        if end > at:
            parts += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    block = b"".join([*parts, b"0\r\n\r\n"])
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *common], block)]
    out, at, ends = [], 0, _cuts(block, segment_bytes)
    for n, end in enumerate(ends, 1):
        if n == 1:
            head = [("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uri}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{uri}>"), ("WARC-Segment-Number", n)]
            head += [("WARC-Segment-Total-Length", len(block))] if n == len(ends) else []
        out.append(_record(head, block[at:end]))
        at = end
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Only digests that come up twice are joined with the pages, and only pages in a slot that such a
    digest takes pass through that join; all others are written in the pass that reads them. The slot
    table is sized by the number of those digests, which are kept in a written table."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    some = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    twice = written(some.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "twice")
    bits = slot_bits(twice.count())
    rows = rows.withColumn("slot", F.when(F.octet_length("html") >= min_revisit, slot_of(F.xxhash64("digest"), bits)))
    sent = pages.sparkSession.sparkContext.broadcast(taken_slots(twice.select(slot_of(F.xxhash64("digest"), bits).alias("s")), bits))

    def split(shared: bool):
        def work(batches):
            for b in batches:
                slot = b.column(4)
                hit = holds(sent.value, slot.fill_null(0).to_numpy(zero_copy_only=False)) & slot.is_valid().to_numpy(zero_copy_only=False)
                part = b.filter(pa.array(hit if shared else ~hit))
                if shared:
                    yield part.select([0, 1, 2, 3])
                else:
                    yield from records(part, None)

        return work

    def records(b: pa.RecordBatch, first: int | None):
        out, size = [], 0
        for i in range(b.num_rows):
            page, payload = b.column(0)[i].as_py(), b.column(2)[i].as_py().encode()
            origin = b.column(first)[i].as_py() if first is not None else None
            refers = origin if origin is not None and origin != page else None
            out += page_records(page, b.column(1)[i].as_py(), payload, b.column(3)[i].as_py(), refers, segment_bytes)
            size += len(payload)
            if size > 4 << 20:
                yield pa.record_batch([pa.array(out)], ["value"])
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(out)], ["value"])

    def joined(batches):
        for b in batches:
            yield from records(b, 4)

    maybe = rows.mapInArrow(split(True), "page_id long, url string, html string, digest string").join(twice, "digest", "left")
    text = rows.mapInArrow(split(False), "value string").unionByName(maybe.select("page_id", "url", "html", "digest", "first").mapInArrow(joined, "value string"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes, strict: bool = True):
    """(headers, block) of each record of an archive, plain or gzip. Not ``strict``: what is no whole record gives
    (None, what is wrong), and reading goes on at the next record's start."""
    broken = None
    while data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            unzip = zlib.decompressobj(31)
            try:
                parts.append(unzip.decompress(rest))
            except zlib.error:
                broken = "compression"
                break
            broken = None if unzip.eof else "compression"
            rest = unzip.unused_data
        data = b"".join(parts)
    if broken and strict:
        raise ValueError(broken)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        wrong = None
        if end < 0 or not data.startswith(b"WARC/", at):
            wrong = "not a WARC record"
        else:
            lines = data[at:end].split(b"\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
            size = headers.get(b"content-length", b"")
            block = data[end + 4 : end + 4 + int(size)] if size.isdigit() else b""
            if not size.isdigit():
                wrong = "a record without a length"
            elif len(block) != int(size):
                wrong = "a record is cut short"
        if wrong is None:
            yield headers, block
            at = end + 4 + len(block) + 4
            continue
        if strict:
            raise ValueError(wrong)
        yield None, wrong
        at = data.find(b"\r\n\r\nWARC/", at + 1)
        at = len(data) if at < 0 else at + 4
    if broken:
        yield None, broken


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk framing")
        at = end + 4 + size


#: One row for each record read.
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, error string"


def _page(uri: bytes | None) -> int | None:
    m = _URI.match(uri or b"")
    return int(m[1]) if m and m[1] else None


def _result(kind: bytes, uri: bytes, refers: bytes | None, digest: bytes, block: bytes, http: bool = True) -> tuple:
    """The row of one record. ``http``: the block is a response with a head of its own, else it is the payload."""
    page, name, error = _page(uri), uri.decode("utf-8", "replace"), None
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    stated = digest.removeprefix(b"sha256:").decode() if digest.startswith(b"sha256:") else None
    if kind == b"revisit":
        size = fields.get(b"content-length", b"")
        return page, int(size) if size.isdigit() else None, stated, "revisit", _page(refers), name, None
    try:
        payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    except ValueError:
        return page, None, stated, kind.decode(), None, name, "chunk framing"
    found = hashlib.sha256(payload).hexdigest()
    if stated is not None and found != stated:
        error = "payload digest differs"
    return page, len(payload), found, kind.decode(), None, name, error


def assembled(pieces: list[tuple[int, bytes, int | None]]) -> bytes:
    """Segments (number, block, total or None) of one record, in any order, joined and verified.
    Repeats of a segment count once."""
    by = {}
    total = None
    for n, block, t in pieces:
        by[n] = block
        total = t if t is not None else total
    block = b"".join(by[n] for n in sorted(by))
    if sorted(by) != list(range(1, len(by) + 1)) or total is None or len(block) != total:
        raise ValueError("segments are missing")
    return block


def _whole(origin: bytes, digest: bytes, pieces: list[tuple[int, bytes, int | None]]) -> tuple:
    try:
        return _result(b"response", origin, None, digest, assembled(pieces))
    except ValueError as e:
        return _page(origin), None, None, "response", None, origin.decode("utf-8", "replace"), str(e)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, error) of every record; a record in
    segments is one."""
    files = spark.read.format("binaryFile").load(path).select("content")
    raw = f"{RESULT}, origin string, number int, total long, digest string, block binary"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in raw.split(", ")]
    width = len(RESULT.split(", "))

    def number_of(h: dict, name: bytes) -> int | None:
        return int(h[name]) if h.get(name, b"").isdigit() else None

    def archives(batches):
        for b in batches:
            for i in range(b.num_rows):
                out, open_sets = [], {}
                for h, block in parse(b.column(0)[i].as_py(), False):
                    if h is None:
                        out.append((None,) * (width - 1) + (block,) + (None,) * 5)
                        continue
                    number, uri, kind = number_of(h, b"warc-segment-number"), h.get(b"warc-record-id", b""), h.get(b"warc-type", b"")
                    if not number:
                        http = h.get(b"content-type", b"").startswith(b"application/http") and kind in (b"response", b"revisit")
                        out.append((*_result(kind, uri, h.get(b"warc-refers-to"), h.get(b"warc-payload-digest", b""), block, http), None, None, None, None, None))
                        continue
                    origin = h.get(b"warc-segment-origin-id", uri)
                    total = number_of(h, b"warc-segment-total-length")
                    have = open_sets.setdefault(origin, [])
                    have.append((number, block, total, h.get(b"warc-payload-digest")))
                    if total is not None and [x[0] for x in have] == list(range(1, number + 1)):
                        out.append((*_whole(origin, have[0][3] or b"", [x[:3] for x in have]), None, None, None, None, None))
                        del open_sets[origin]
                for origin, have in open_sets.items():
                    for number, block, total, digest in have:
                        out.append((None,) * width + (origin.decode("utf-8", "replace"), number, total, (digest or b"").decode(), block))
                if out:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), types)], names)

    # both branches below read the same parse
    parsed = written(files.mapInArrow(archives, raw), "parsed")
    whole = parsed.where("origin IS NULL").select(*names[:width])
    sets = parsed.where("origin IS NOT NULL").groupBy("origin").agg(F.max("digest").alias("digest"), F.greatest(F.lit(1), F.sum(F.expr("int(number = 1)"))).alias("copies"), F.sort_array(F.collect_set(F.struct("number", "block", "total"))).alias("pieces"))

    def sets_work(batches):
        for b in batches:
            out = []
            for origin, digest, copies, pieces in zip(*(b.column(i).to_pylist() for i in range(4))):
                out += [_whole(origin.encode(), digest.encode(), [(p["number"], p["block"], p["total"]) for p in pieces])] * copies
            if out:
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), types)], names[:width])

    return whole.unionByName(sets.mapInArrow(sets_work, RESULT))


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: the rows of ``read_archives``."""
    spark = pages.sparkSession
    path = f"{new_folder(spark)}/warc"
    write_archives(pages, path, **columns)
    return read_archives(spark, path)
