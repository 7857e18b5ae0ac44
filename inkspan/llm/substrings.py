"""Operator 5: removal of repeated word windows, behind a count-min prefilter.

A window is ``window`` consecutive words of one row.  Three passes decide,
exactly, which windows' word sequences start at more than one place:

1. Every partition sketches the *anchors* of its windows, and the sketches are
   merged by cell block.  A window's anchor is its smallest ``ANCHOR``-word
   sub-window by hash.  Equal windows at two places have equal anchors at two
   places, so the sketched count of an anchor is never less than the count of
   a window that has it: the estimate errs upwards only.
2. Windows estimated to occur once go.  The hashes of the others (96 bits over
   64-bit hashes of their words) are dealt out by hash bucket and grouped exactly.  A partition works in flushes
   of bounded size and combines the windows that a flush repeats before they
   are dealt, so a window that a third of all rows hold is sent once a flush.
   Each bucket answers a flush with a bitmap; the flush's own manifest (where
   its windows lie) meets the bitmaps by the flush's content digest.
3. The word ranges that come out, one row per distinct text, are joined to the
   rows by text digest, and the words they cover are removed.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import fresh, lean, modest, quoted, table, written

ANCHOR = 8
#: Cells per sketch row: at least, at most (a broadcast of 64 MB), and input bytes for each.  Beyond 4 GB of text
#: cells are shared by more and more anchors, so ever more windows pass to the exact pass, until all do: about
#: 12 bytes a word are then dealt out, and the results stay whole.
CELLS_LEAST, CELLS_MOST, BYTES_A_CELL = 1 << 16, 1 << 28, 16
BLOCK = 1 << 16
#: Candidate windows a flush holds (20 bytes each), input bytes for each hash bucket, and buckets at most.
FLUSH, BUCKET_BYTES, BUCKETS_MOST = 1 << 20, 2 << 20, 1 << 20


def _cells(anchors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each anchor in each of the two sketch rows."""
    return (anchors & W.U64(n - 1)).astype(np.int64), ((anchors >> W.U64(36)) & W.U64(n - 1)).astype(np.int64) + n


def _anchored(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row; each one's anchor hash; sub-window hashes."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, W.U64), np.zeros(0, W.U64)
    sub = W.windows(h, min(ANCHOR, window), two=False)[0]
    least = W.sliding(sub, window - min(ANCHOR, window) + 1, np.minimum)
    room = np.maximum(np.diff(first) - window + 1, 0)
    starts = W.ranges(first[:-1], room)
    return starts, least[starts], sub


def _sketch(cells: int, window: int, most: int):
    """Each partition's sketch: by block, the cells that it saw once and those that it saw more often.

    A partition holds the anchors of ``most`` places at a time, never the
    whole sketch, and sends four bytes an anchor.
    """

    def blocks(anchors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        c = np.sort(np.concatenate(_cells(np.concatenate(anchors), cells)))
        heads = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        often = np.diff(np.append(heads, len(c))) > 1
        c = c[heads]
        cut = np.flatnonzero(np.append(True, c[1:] // BLOCK != c[:-1] // BLOCK)) if len(c) else heads
        for i in range(0, len(cut), 256):
            own = list(zip(cut[i : i + 256], np.append(cut[1:], len(c))[i : i + 256]))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([int(c[x]) // BLOCK for x, _ in own], pa.int32()),
                "once": pa.array([(c[x:y][~often[x:y]] % BLOCK).astype(np.uint16).tobytes() for x, y in own], pa.binary()),
                "often": pa.array([(c[x:y][often[x:y]] % BLOCK).astype(np.uint16).tobytes() for x, y in own], pa.binary()),
            })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            data, off = W.utf8(batch.column(0))
            for i, j in W.slices(off):
                w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i])
                starts, least, sub = _anchored(W.hashes(w), w.first, window)
                if not len(starts):
                    continue
                # An anchor counts once for each place it has, however many windows share it.
                span = window - min(ANCHOR, window) + 1
                full = np.zeros(len(sub), W.U64)
                full[starts] = least
                padded = np.concatenate([np.zeros(span - 1, W.U64), full, np.zeros(max(0, len(sub) - len(full)), W.U64)])
                reach = W.sliding(padded, span, np.maximum)[: len(sub)]
                held.append(sub[reach == sub])
            if sum(map(len, held)) > most:
                yield from blocks(held)
                held = []
        if held:
            yield from blocks(held)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """Adds the sketches of one block, saturating at two: a bit per cell says 'two or more'."""
    seen = np.zeros(BLOCK, np.uint8)
    for once, often in zip(group.column("once"), group.column("often")):
        at = np.frombuffer(once.as_buffer(), np.uint16)
        seen[at] = np.minimum(seen[at] + 1, 2)
        seen[np.frombuffer(often.as_buffer(), np.uint16)] = 2
    return pa.table({"block": group.column("block").slice(0, 1), "cells": pa.array([np.packbits(seen == 2).tobytes()], pa.binary())})


class _Flush:
    """Candidate windows of some rows, until there are enough to send."""

    def __init__(self) -> None:
        self.keys: list[bytes] = []
        self.docs: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.h: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def send(self, buckets: int) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h1, h2 = (np.concatenate(x) for x in zip(*self.h))
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        many = np.zeros(len(a), bool)
        many[order] = np.repeat(np.diff(np.append(heads, len(a))) > 1, np.diff(np.append(heads, len(a))))
        sent = np.zeros(len(a), bool)
        sent[order[heads]] = True
        where = np.flatnonzero(sent)
        bucket = ((h1[where] >> W.U64(40)) % W.U64(buckets)).astype(np.uint32)
        manifest = zlib.compress(pickle.dumps((
            self.keys, np.concatenate(self.docs), np.concatenate(self.at), np.packbits(many), np.packbits(sent), bucket,
        )), 1)
        flush = hashlib.blake2b(manifest, digest_size=16).digest()
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cut)):
            own = where[by[cut[k] : cut[k + 1]]]
            blob = h1[own].tobytes() + h2[own].tobytes() + np.packbits(many[own]).tobytes()
            yield _row(int(k), flush, len(own), blob)
        yield _row(buckets + int.from_bytes(flush[:4], "little") % buckets, flush, -1, manifest)
        self.__init__()


_SENT = "target int, flush binary, n int, blob binary"


def _row(target: int, flush: bytes, n: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "target": pa.array([target], pa.int32()), "flush": pa.array([flush], pa.binary()),
        "n": pa.array([n], pa.int32()), "blob": pa.array([blob], pa.binary()),
    })


def _candidates(sketch, cells: int, window: int, buckets: int, most: int):
    """The second pass: hashes of windows estimated repeated, by bucket, and each flush's manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(sketch.value, np.uint8)

        def repeated(c: np.ndarray) -> np.ndarray:
            return (twice[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1

        flush = _Flush()
        for batch in batches:
            keys = batch.column(0)
            data, off = W.utf8(batch.column(1))
            for i, j in W.slices(off):
                w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i])
                h = W.hashes(w)
                starts, least, _ = _anchored(h, w.first, window)
                if not len(starts):
                    continue
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                x, y = _cells(least[new], cells)
                found = (repeated(x) & repeated(y)).astype(bool)[np.cumsum(new) - 1]
                starts = starts[found]
                if not len(starts):
                    continue
                a, b = W.windows(h, window)
                doc = np.searchsorted(w.first, starts, "right") - 1
                own, doc_at = np.unique(doc, return_inverse=True)
                for lo in range(0, len(starts), most):
                    hi = slice(lo, lo + most)
                    flush.docs.append((doc_at[hi] + len(flush.keys)).astype(np.uint32))
                    flush.at.append((starts[hi] - w.first[doc[hi]]).astype(np.uint32))
                    flush.h.append((a[starts[hi]], b[starts[hi]].astype(np.uint32)))
                    flush.keys += [keys[int(i + d)].as_py() for d in own]
                    flush.n += len(flush.at[-1])
                    if flush.n >= most:
                        yield from flush.send(buckets)
        yield from flush.send(buckets)

    return run


def _group(group: pa.Table) -> pa.Table:
    """One bucket: which of each flush's windows start elsewhere too.  Manifests pass through."""
    out = []
    rows = group.to_pylist()
    blobs = [r for r in rows if r["n"] >= 0]
    if blobs:
        h1, h2, many = [], [], []
        for r in blobs:
            n, raw = r["n"], r["blob"]
            h1.append(np.frombuffer(raw, W.U64, n))
            h2.append(np.frombuffer(raw, np.uint32, n, 8 * n))
            many.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 * n), count=n).astype(bool))
        a, b, m = np.concatenate(h1), np.concatenate(h2), np.concatenate(many)
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        same = np.zeros(len(a) + 1, bool)
        same[1:-1] = (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])
        m[order] |= same[1:] | same[:-1]
        at = 0
        for r in blobs:
            out.append((r["target"], r["flush"], r["n"], np.packbits(m[at : at + r["n"]]).tobytes()))
            at += r["n"]
    out += [(r["target"], r["flush"], r["n"], r["blob"]) for r in rows if r["n"] < 0]
    t, f, n, b = zip(*out)
    return pa.table({"target": pa.array(t, pa.int32()), "flush": pa.array(f, pa.binary()), "n": pa.array(n, pa.int32()), "blob": pa.array(b, pa.binary())})


def _ranges(window: int):
    """A flush's manifest and its buckets' bitmaps: the covered word ranges of each of its texts."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys, docs, at, many, sent, bucket = pickle.loads(zlib.decompress(next(r["blob"] for r in rows if r["n"] < 0)))
        hit = np.unpackbits(many, count=len(docs)).astype(bool)
        where = np.flatnonzero(np.unpackbits(sent, count=len(docs)))
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(int(bucket.max()) + 2))
        for r in rows:
            if r["n"] >= 0:
                own = where[by[cut[r["target"]] : cut[r["target"] + 1]]]
                hit[own] |= np.unpackbits(np.frombuffer(r["blob"], np.uint8), count=r["n"]).astype(bool)
        docs, at = docs[hit].astype(np.int64), at[hit].astype(np.int64)
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + window)
        heads = np.flatnonzero(new)
        spans = np.stack([at[heads], at[np.append(heads[1:], len(at)) - 1] + window], 1).astype(np.uint32) if len(at) else np.zeros((0, 2), np.uint32)
        own, first = np.unique(docs[heads], return_index=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends = np.append(first[1:], len(spans))
        return pa.table({
            "key": pa.array([keys[d] for d in own], pa.binary()),
            "spans": pa.array([spans[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
        })

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each text's range lists, as ranges apart from each other."""

    def union(parts: list[bytes]) -> bytes:
        if len(parts) == 1:
            return parts[0]
        spans = np.frombuffer(b"".join(parts), np.uint32).reshape(-1, 2)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        reach = np.maximum.accumulate(spans[:, 1])
        heads = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
        return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], 1).tobytes()

    for batch in batches:
        spans = pa.array([union(parts) for parts in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["key", "spans"])


def _digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary")))


def repeated_ranges(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """``(key, spans)``: per distinct text (md5) the word ranges [start, end) that repeated windows cover.

    ``spans`` are pairs of little-endian uint32.  Texts without any are absent.
    """
    spark = docs.sparkSession
    only = modest(docs).select(F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    size = only.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a scan without Python
    cells = CELLS_LEAST
    while cells < CELLS_MOST and cells * BYTES_A_CELL < size:
        cells *= 2
    buckets = int(min(max(64, size // BUCKET_BYTES), BUCKETS_MOST))
    flush = FLUSH * max(1, buckets >> 17)  # a bucket's part of a flush is some windows at least
    blocks = (
        only.mapInArrow(lean(_sketch(cells, window, FLUSH)), "block int, once binary, often binary")
        .groupBy("block").applyInArrow(_merge, "block int, cells binary")
    )
    merged = bytearray(2 * cells // 8)
    for block, part in blocks.toLocalIterator():  # at most 2 * CELLS_MOST / 8 bytes in all
        merged[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = part
    sketch = spark.sparkContext.broadcast(bytes(merged))
    sent = docs.select(_digest(text).alias("key"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).mapInArrow(
        lean(_candidates(sketch, cells, window, buckets, flush)), _SENT
    )
    answered = sent.groupBy("target").applyInArrow(_group, _SENT)
    spans = answered.groupBy("flush").applyInArrow(_ranges(window), "key binary, spans binary")
    # A text that whole flushes hold has the same ranges in each; one cut over flushes has a part in each.
    parts = spans.groupBy("key").agg(F.collect_set("spans").alias("parts"))
    return parts.mapInArrow(lean(_united), "key binary, spans binary")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, spans, then others: the others with n_words, n_removed and kept text put before.

    A first other column named ``untouched`` asks for the text as it is where nothing goes.
    """
    for batch in batches:
        data, off = W.utf8(batch.column(0))
        spans = batch.column(1)
        for i, j in W.slices(off, 1 << 19):
            w = W.split(data[off[i] : off[j]], off[i : j + 1] - off[i])
            keep = np.ones(len(w.starts), bool)
            part = spans.slice(i, j - i)
            for d in np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False)):
                for a, b in np.frombuffer(part[int(d)].as_py(), np.uint32).reshape(-1, 2):
                    keep[w.first[d] + a : w.first[d] + b] = False
            left = np.add.reduceat(np.append(keep, False).astype(np.int64), w.first[:-1]) * (w.counts > 0)
            row = w.rows[keep]
            starts, size = w.starts[keep], (w.ends - w.starts)[keep] + 1
            joined = np.full(int(size.sum()), 0x20, np.uint8)
            to = np.cumsum(size) - size
            joined[W.ranges(to, size - 1)] = w.data[W.ranges(starts, size - 1)]
            ends = np.zeros(j - i + 1, np.int64)
            np.cumsum(np.bincount(row, size, j - i).astype(np.int64), out=ends[1:])
            # Each row's last word loses its space: drop one byte a row that has words.
            last = ends[1:][left > 0] - 1
            joined = np.delete(joined, last)
            ends[1:] -= np.cumsum(left > 0)
            text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends.tobytes()), pa.py_buffer(joined.tobytes())).cast(pa.string())
            if batch.schema.names[2:3] == ["untouched"]:
                text = pc.if_else(pa.array(left == w.counts), batch.column(0).slice(i, j - i), text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.counts, pa.int64()), pa.array(w.counts - left, pa.int64()), text, *[batch.column(c).slice(i, j - i) for c in range(2, batch.num_columns)]],
                names=["n_words", "n_removed", "kept", *batch.schema.names[2:]],
            )


def remove_repeated(docs: DataFrame, text: str = "text", window: int = 35, keep=None, untouched: bool = False) -> DataFrame:
    """Removes each word covered by a window whose word sequence also starts elsewhere.

    Returns the columns ``keep`` (default: all but the text) with ``sub_words``,
    ``sub_removed`` (longs) and ``sub_kept``, the kept words joined by one space
    (with ``untouched``, the very text where no word goes).
    Windows are judged on the input.  Null text counts as none; a text of fewer
    than ``window`` words keeps them all; repeated rows repeat each other's
    windows; ids are not used, so null or repeated ids do no harm; an empty
    table gives no rows; columns of the three names are replaced.
    """
    added = ("sub_words", "sub_removed", "sub_kept")
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c.lower() not in added]
    spans = written(repeated_ranges(docs, text, window))
    key = fresh(docs, "key")
    rows = docs.select(
        _digest(text).alias(key), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text_in"),
        *[F.col(quoted(c)).alias(f"keep{i}") for i, c in enumerate(keep)],
    )
    flag = [F.lit(True).alias("untouched")] if untouched else []
    rows = rows.join(spans.withColumnRenamed("key", key).hint("merge"), key, "left").select(
        "text_in", "spans", *flag, *[f"keep{i}" for i in range(len(keep))]
    )
    schema = "n_words long, n_removed long, kept string" + ", untouched boolean" * untouched + "".join(
        f", keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)
    )
    return rows.mapInArrow(lean(_cleaned), schema).select(
        *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("n_words").alias("sub_words"), F.col("n_removed").alias("sub_removed"), F.col("kept").alias("sub_kept"),
    )


def without_repeated(docs: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with the words of repeated windows gone from ``text``; other rows and columns stay as they are.

    A null text becomes empty.
    """
    rows = remove_repeated(docs, text, window, untouched=True).withColumnRenamed("sub_kept", text)
    return rows.select([F.col(quoted(c)) for c in docs.columns])


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id", F.col("sub_words").alias("n_words"), F.col("sub_removed").alias("n_removed"),
        F.sha2(F.col("sub_kept").cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
s AS (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM p),
x AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM x),
g AS (SELECT r, count(*) AS n_removed, list(k) AS ks FROM c GROUP BY r),
q AS (SELECT d.r, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS k FROM d),
o AS (
  SELECT q.r, string_agg(q.word, ' ' ORDER BY q.k) AS kept
  FROM q LEFT JOIN c ON q.r = c.r AND q.k = c.k WHERE c.r IS NULL GROUP BY q.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r LEFT JOIN o ON d.r = o.r
"""
