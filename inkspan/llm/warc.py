"""Operator 3: WARC archives, written in segments and reassembled.

Payloads travel as HTTP responses in chunked framing; a long one is cut into a
first record and continuations.  Reading groups continuations by origin
identifier, orders them by segment number, verifies the total length, decodes
the chunked framing and verifies the payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_filter, modest, passing, quoted, table, written

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive that are inflated at a time.
STEP = 1 << 14


class Damaged(ValueError):
    """An archive does not hold what its records say."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP chunked framing of ``payload``."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(raw: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = raw.find(CRLF, at)
        if end < 0:
            raise Damaged("chunk size cut short")
        try:
            size = int(raw[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise Damaged("chunk size is no number") from None
        at = end + 2
        if not size:
            return b"".join(out)
        if raw[at + size : at + size + 2] != CRLF:
            raise Damaged("chunk cut short")
        out.append(raw[at : at + size])
        at += size + 2


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (headers | {"Content-Length": str(len(block))}).items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + CRLF + block + 2 * CRLF, 1, mtime=0)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, of plain or gzip archives."""
    if archive[:2] == b"\x1f\x8b":
        parts, view, at = [], memoryview(archive), 0
        while at < len(view):
            if not view[at]:  # padding between members
                at += 1
                continue
            one = zlib.decompressobj(31)
            while not one.eof and at < len(view):  # in steps: what a member leaves over is copied
                parts.append(one.decompress(view[at : at + STEP]))
                at = min(at + STEP, len(view)) - len(one.unused_data)
            if not one.eof:
                raise Damaged("gzip member cut short")
        archive = b"".join(parts)
    at = 0
    while at < len(archive):
        end = archive.find(2 * CRLF, at)
        if end < 0:
            raise Damaged("record header cut short")
        first, *lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise Damaged("no WARC record")
        headers: dict[str, str] = {}
        last = ""
        for line in lines:
            if line[:1] in " \t" and last:  # a folded header goes on
                headers[last] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        start = end + 4
        stop = start + int(headers.get("content-length", 0))
        if stop > len(archive):
            raise Damaged("record block cut short")
        yield headers, archive[start:stop]
        at = stop
        while archive[at : at + 2] == CRLF:
            at += 2


def _urn(ident: str, digest: str, row: str) -> str:
    return f"<urn:page:{ident}:{digest}:{row}>"


def page_records(ident, url, payload: bytes, digest: str, response, row: str, segment: int) -> Iterator[bytes]:
    """The record or records of one page; ``response`` is the id that it revisits, or None."""
    name = "" if ident is None else str(ident)
    # Control characters would end a header line.
    target = "".join(c for c in (url or "") if c >= " ") or "urn:none"
    head = {
        "WARC-Record-ID": _urn(name, digest, row), "WARC-Date": DATE, "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response",
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if response is not None:
        yield record({"WARC-Type": "revisit"} | head | {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(str(response), digest, "")}, http)
        return
    block = http + chunked(payload, 4096)
    cuts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(cuts) == 1:
        yield record({"WARC-Type": "response"} | head, block)
        return
    yield record({"WARC-Type": "response"} | head | {"WARC-Segment-Number": "1"}, cuts[0])
    for k, cut in enumerate(cuts[1:], 2):
        own = {"WARC-Type": "continuation", "WARC-Record-ID": _urn(name, digest, f"{row}-{k}"), "WARC-Date": DATE, "WARC-Target-URI": target,
               "WARC-Segment-Origin-ID": head["WARC-Record-ID"], "WARC-Segment-Number": str(k)}
        if k == len(cuts):
            own["WARC-Segment-Total-Length"] = str(len(block))
        yield record(own, cut)


def _told(batch: pa.RecordBatch, needed: bytes, wanted: bool) -> pa.RecordBatch:
    """Of rows (hash, ...) those that a filter passes, or the others, without the hash."""
    mark = np.zeros(batch.num_rows, bool)
    mark[passing(batch.column(0).to_numpy(), needed)] = True
    return pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(mark == wanted))


def _archived(letter: str, segment: int, archive: int, needed=None):
    """Rows (ident, url, payload, digest, response) to archives.  With a filter, rows (hash, ident, url, payload, digest)
    that it does not pass, all of them responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = f"{letter}{TaskContext.get().partitionId()}"
        out: list[bytes] = []
        size = made = row = 0

        def archived() -> pa.RecordBatch:
            name = f"part-{task}-{made:05d}.warc.gz"
            return pa.RecordBatch.from_pydict({"name": pa.array([name]), "content": pa.array([b"".join(out)], pa.binary())})

        for batch in batches:
            if needed is not None:
                batch = _told(batch, needed.value, False)
                batch = batch.append_column("response", pa.nulls(batch.num_rows, pa.int64()))
            for i, u, p, d, r in zip(*(c.to_pylist() for c in batch.columns)):
                for raw in page_records(i, u, p, base64.b32encode(bytes.fromhex(d)).decode(), r, f"{task}-{row}", segment):
                    out.append(raw)
                    size += len(raw)
                row += 1
                if size >= archive:  # a page's records may lie in several archives
                    yield archived()
                    out, size, made = [], 0, made + 1
        if out:
            yield archived()

    return run


def write_archives(pages: DataFrame, ident: str = "page_id", url: str = "url", payload: str = "html",
                   segment: int = 8192, archive: int = 4 << 20, least: int = 0) -> DataFrame:
    """``(name, content)``: gzip WARC archives of about ``archive`` bytes with every row as a record.

    Of equal payloads of ``least`` bytes or more, the row with the largest id
    is the response and the others revisit it; rows that repeat that id are
    responses too; a null id revisits the largest id there is; with null ids
    only, all are responses.  Which payloads are repeated is decided by digest
    and id.  Rows of other digests are told by a filter and written where they
    lie; only the rest meets the repeated digests in a join.

    The payload is UTF-8 text or bytes, null as empty.  A null url is
    ``urn:none``.  Repeated rows are records of their own.  An empty table
    makes no archives.  Other columns are not looked at.  A page of any length
    is written whole, by one task; it must fit a cell (2 GB).
    """
    rows = modest(pages).select(
        F.col(quoted(ident)).cast("long").alias("ident"), F.col(quoted(url)).cast("string").alias("url"),
        F.coalesce(F.col(quoted(payload)).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("d")).agg(F.max("ident").alias("top"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1").select("d", "top", F.xxhash64("d").alias("h")))
    needed = pages.sparkSession.sparkContext.broadcast(bit_filter(groups.select("h")))  # 16 MB at most
    hashed = rows.select(F.xxhash64("digest").alias("h"), *rows.columns)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_told(batch, needed.value, True) for batch in batches)

    found = hashed.mapInArrow(several, rows.schema).join(groups.select("d", "top"), F.col("digest") == F.col("d"), "left")
    response = F.when(~F.col("top").eqNullSafe(F.col("ident")), F.col("top")).alias("response")
    found = found.select("ident", "url", "payload", "digest", response)
    kinds = "name string, content binary"
    return hashed.mapInArrow(_archived("s", segment, archive, needed), kinds).unionByName(found.mapInArrow(_archived("r", segment, archive), kinds))


_SEGMENT = "origin string, n int, total long, type string, url string, digest string, length long, refers string, block binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in _SEGMENT.split(",")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            out = []
            for h, block in records(content.as_py() or b""):
                kind = h.get("warc-type", "")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                origin = h.get("warc-segment-origin-id") if kind == "continuation" else h.get("warc-record-id")
                if origin is None:
                    raise Damaged("a record without the identifier that it needs")
                number = h.get("warc-segment-number")
                total, length = h.get("warc-segment-total-length"), h.get("warc-payload-length")
                out.append((
                    origin, int(number) if number else 0, int(total) if total else None, kind, h.get("warc-target-uri"),
                    h.get("warc-payload-digest"), int(length) if length else None, h.get("warc-refers-to"), block,
                ))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def joined(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """Segments of one origin in the order of their numbers, none missing, of the stated total length."""
    parts = sorted(parts, key=lambda p: p[0])
    if len(parts) == 1 and parts[0][0] in (0, 1) and parts[0][1] is None and parts[0][0] == 0:
        return parts[0][2]
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise Damaged(f"segments {[p[0] for p in parts]} do not run from 1")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] is None:
        raise Damaged("the last segment states no total length")
    if parts[-1][1] != len(block):
        raise Damaged(f"segments hold {len(block)} bytes of {parts[-1][1]}")
    return block


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, out of its transfer framing."""
    head, _, body = block.partition(2 * CRLF)
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """``(record_id, record_type, url, payload, payload_bytes, payload_digest, refers_to)`` of every response and revisit.

    ``content`` holds whole archives, plain or gzip, one a row, as the
    ``binaryFile`` source also gives them; null and empty ones hold nothing.
    Only segmented records are shuffled.  A revisit has a null payload and the
    length that it states.  Raises :class:`Damaged` for missing segments, wrong
    lengths or a payload that its digest does not fit.
    """
    parsed = archives.select(F.col(quoted(content)).alias("content")).mapInArrow(_parsed, _SEGMENT)
    part = F.struct("n", "total", "block")
    shape = ["origin", "type", "url", "digest", "length", "refers", "parts"]
    whole = parsed.filter("n = 0").withColumn("parts", F.array(part)).select(shape)
    first = F.col("type") != "continuation"
    cut = parsed.filter("n > 0").groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("type", "url", "digest", "length", "refers")], F.collect_list(part).alias("parts")
    ).select(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, kind, url, digest, length, refers = (c.to_pylist() for c in batch.columns[:6])
            payloads, sizes, sums = [], [], []
            for i, own in enumerate(batch.column(6)):
                if kind[i] is None:
                    raise Damaged(f"continuations of {origin[i]} without a first segment")
                stated = (digest[i] or "").removeprefix("sha1:")
                if kind[i] == "revisit":
                    payloads.append(None)
                    sizes.append(length[i])
                    sums.append(stated)
                    continue
                payload = http_payload(joined([(p["n"], p["total"], p["block"]) for p in own.as_py()]))
                found = base32_sha1(payload)
                if stated and stated != found:
                    raise Damaged(f"payload of {origin[i]} does not fit its digest")
                payloads.append(payload)
                sizes.append(len(payload))
                sums.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), batch.column(5)],
                names=["record_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"],
            )

    return whole.unionByName(cut).mapInArrow(
        run, "record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(write_archives(table(spark, sf_dir, "pages")))
    ident = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")
    return read_archives(archives).select(
        ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to")
    )


OP3_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, unhex(sha1(b))::BIT AS d FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM h)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    16 * get_bit(d, (5 * i)::INT) + 8 * get_bit(d, (5 * i + 1)::INT) + 4 * get_bit(d, (5 * i + 2)::INT)
    + 2 * get_bit(d, (5 * i + 3)::INT) + get_bit(d, (5 * i + 4)::INT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
