"""Operator 9: SimHash near-duplicates through an index of positional bytes.

Fingerprints that differ in at most ``bits`` bits differ in at most ``bits`` of
their 8 bytes, so a linked pair shares at least ``need = 8 - bits`` positional
bytes, and at least half of these (rounded up) in one half of the eight.  The
inverted index lists the distinct fingerprints under every such run of bytes
(for three bits: each choice of three bytes of either half, eight keys).  The
shared bytes of the pairs that meet there are tallied, pairs below the
guaranteed minimum go, and the rest are verified bit by bit.  A posting list of
more than LOCAL passes on under longer runs, ``need`` bytes each, which deals
it out to many tasks; a list that is still long gives a spanning forest of its
links, found by probing every mask of at most ``bits`` free bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import components, lean, mark, modest, quoted, release, sorted_lists, table, written

SEED = 42
#: Posting lists up to PAIRED are paired at once, up to LOCAL in blocks; longer ones are split by further bytes.
PAIRED, LOCAL = 8, 2048


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each row's lower-cased word shingles; zero for a row without words."""
    w = W.split(data, offsets)
    n = len(offsets) - 1
    out = np.zeros(n, W.U64)
    if not len(w.starts):
        return out
    size = w.ends - w.starts + 1
    to = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, np.uint8)
    joined[W.ranges(to, size - 1)] = W._LOWER[w.data[W.ranges(w.starts, size - 1)]]
    many = np.where(w.counts > 0, np.maximum(w.counts - shingle + 1, 1), 0)
    head = W.ranges(w.first[:-1], many)
    row = np.repeat(np.arange(n), many)
    tail = np.minimum(head + shingle, w.first[row + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], SEED) for a, b in zip(to[head].tolist(), (to[tail] + size[tail] - 1).tolist())], W.U64)
    has = np.flatnonzero(many)
    at = (np.cumsum(many) - many)[has]
    ones = np.empty((len(has), 64), np.int64)
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    np.add.reduceat(bits, at, axis=0, dtype=np.int64, out=ones)
    out[has] = np.packbits(2 * ones > many[has, None], axis=1).view(">u8").ravel().astype(W.U64)
    return out


def _fingerprinted(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column(batch.num_columns - 1))
            for i, j in W.slices(off, 1 << 19):
                fp = fingerprints(data[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                rest = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return run


def runs(bits: int, long: bool = False) -> list[tuple[int, ...]]:
    """Byte positions of each key.  Of any ``8 - bits`` shared positions some key's are all shared;
    of the ``long`` keys that extend any key, some key's are too."""
    need = 8 - bits
    if long:
        return list(combinations(range(8), need))
    return [c for half in (range(4), range(4, 8)) for c in combinations(half, (need + 1) // 2)]


def _keyed(octets: np.ndarray, at: tuple[int, ...], name: int) -> np.ndarray:
    """The bytes at some positions as a number, with the run's own number in the top byte."""
    key = np.zeros(len(octets), W.U64)
    for x in at:
        key = (key << W.U64(8)) | octets[:, x]
    return (W.mix(key) & W.U64((1 << 56) - 1) if len(at) > 6 else key) | W.U64(name << 56)


def _octets(fp: np.ndarray) -> np.ndarray:
    return fp.astype(">u8").view(np.uint8).reshape(-1, 8).astype(W.U64)


def _posted(key: list[np.ndarray], fp: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(fp).view(np.int64))], names=["key", "fp"])


def _postings(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(W.U64)
            for i in range(0, len(fp), 1 << 14):
                own = fp[i : i + (1 << 14)]
                octets = _octets(own)
                keys = [_keyed(octets, at, c) for c, at in enumerate(runs(bits))]
                yield _posted(keys, [own] * len(keys))

    return run


def _longer(bits: int):
    """Rows of long lists under every run of ``8 - bits`` positions that extends their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = runs(bits)
        extending = [[(c, at) for c, at in enumerate(runs(bits, True)) if set(own) <= set(at)] for own in short]
        for batch in batches:
            key, fp = (batch.column(c).to_numpy().view(W.U64) for c in (0, 1))
            name = (key >> W.U64(56)).astype(np.int64)
            for c in np.unique(name):
                own = fp[name == c]
                octets = _octets(own)
                yield _posted([_keyed(octets, at, k) for k, at in extending[c]], [own] * len(extending[c]))

    return run


def tallied(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs share at least ``8 - bits`` positional bytes."""
    return ((a ^ b)[..., None].view(np.uint8) == 0).sum(-1) >= 8 - bits


def linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The tally of shared positional bytes, then the exact bit count of the pairs that reach the minimum."""
    ok = tallied(a, b, bits)
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= bits
    return ok


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints that share a key."""
    m = len(fp)
    root = np.arange(m)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Union of index pairs: labels fall to the smallest, then pointers are followed."""
        while True:
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            if (low == high).all():
                return
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root[:] = root[root]

    free = int(np.bitwise_or.reduce(fp ^ fp[0]))
    at = [k for k in range(64) if free >> k & 1]
    if 50 * sum(comb(len(at), n) for n in range(1, bits + 1)) > m:
        step = max(1, (1 << 18) // m)
        for i in range(0, m, step):
            a, b = np.nonzero(tallied(fp[i : i + step, None], fp[None, i:], bits))
            ok = np.bitwise_count(fp[a + i] ^ fp[b + i]) <= bits
            join(a[ok] + i, b[ok] + i)
    else:
        for n in range(1, bits + 1):
            for mask in combinations(at, n):
                other = fp ^ W.U64(sum(1 << k for k in mask))
                spot = np.minimum(np.searchsorted(fp, other), m - 1)
                hit = np.flatnonzero(fp[spot] == other)
                if len(hit):
                    join(hit, spot[hit])
    tree = np.flatnonzero(root != np.arange(m))
    return fp[root[tree]], fp[tree]


def _links(bits: int, most: int):
    """Sorted postings: the links of each key's list as pairs of fingerprints, and lists of more than
    ``most`` as they are: (key, fp, whether it is a link)."""

    def pairs(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(heads, len(key)))
        every = np.repeat(size, size)
        short = (every > 1) & (every <= PAIRED)
        k, f = key[short], fp[short]
        for d in range(1, PAIRED):
            same = np.flatnonzero(k[d:] == k[:-d])
            ok = same[linked(f[same], f[same + d], bits)]
            yield f[ok], f[ok + d]
        for i in np.flatnonzero(size > PAIRED):
            yield _forest(np.sort(fp[heads[i] : heads[i] + size[i]]), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, long in sorted_lists(batches, most):
            if long:
                yield _rows(key, fp, False)
                continue
            found = list(pairs(key, fp.view(W.U64)))
            a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
            ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield _rows(ab[:, 0].copy(), ab[:, 1].copy(), True)

    return run


def _rows(a: np.ndarray, b: np.ndarray, link: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), link))], names=["a", "b", "link"])


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs at ``bits`` or fewer differing bits.

    ``distinct`` has one column of distinct non-null longs.  After the second
    run of keys a list holds at most 2**24 of them for three bits, which is
    held whole; with more bits, runs are shorter and lists may be longer.
    """
    if not 0 <= bits <= 6:
        raise ValueError("bits must be 0 to 6: with 7 or more, no byte need be shared")

    def met(posted: DataFrame, most: int) -> DataFrame:
        return posted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(_links(bits, most)), "a long, b long, link boolean")

    first = written(met(distinct.mapInArrow(lean(_postings(bits)), "key long, fp long"), LOCAL))
    found, long = first.filter("link"), first.filter("not link").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if not long.isEmpty():
        found = found.union(met(long.mapInArrow(lean(_longer(bits)), "key long, fp long"), 1 << 62))
    return found.select("a", "b")


def classes(rows: DataFrame, ident: str, fp: str, bits: int = 3) -> DataFrame:
    """``(fp, component_id)`` for each distinct fingerprint: the smallest id reachable."""
    reps = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(ident).alias("least")))
    roots = components(links(reps.select("fp"), bits))
    named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = written(named)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(named.join(ids, "root").select("fp", "component_id"))


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, bits: int = 3
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row, under the id's own name.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest
    non-null id reachable over links (null if there is none).  Null and empty
    texts have fingerprint zero and link like any other; repeated rows each get
    a row; a text of any length is fingerprinted whole; ties need no rule, as a
    class is named by its smallest id; an empty table gives no rows; other
    columns are not looked at.
    """
    return _classed(docs, text, doc_id, shingle, bits).select(
        F.col("ident").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classed(docs: DataFrame, text: str, doc_id: str, shingle: int = 3, bits: int = 3) -> DataFrame:
    """``(ident, source, fp, component_id)`` of every row; ``source`` is its text's xxhash64."""
    kept = modest(docs).select(F.col(quoted(doc_id)).alias("ident"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    kept = kept.select("ident", F.xxhash64("text").alias("source"), "text")
    kind, since = docs.schema[doc_id].dataType.simpleString(), mark()
    rows = written(kept.mapInArrow(lean(_fingerprinted(shingle)), f"ident {kind}, source long, fp long"))
    named = classes(rows, "ident", "fp", bits)
    release(docs.sparkSession, since, rows, named)
    return rows.join(named, "fp").select("ident", "source", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with one row left of each component: the one with the smallest id.

    Components are those of 64-bit fingerprints at ``bits`` differing bits; with
    a ``similarity`` each pair that these and, where 64 bits are too few, wider
    ones find is verified on whole shingle sets (:mod:`.similar`).  Rows without an id
    are kept.  Of rows that repeat an id and a text one stays; where texts of
    several components share an id, one of each.
    """
    from .similar import one_of_each, without_similar

    if "similarity" in options:
        return without_similar(docs, text, doc_id, **options)
    since = mark()
    rows = _classed(docs, text, doc_id, **options).filter("ident is not null")
    kept = written(rows.groupBy("component_id", "ident").agg(F.min("source").alias("source")).filter("ident = component_id").select("ident", "source"))
    release(docs.sparkSession, since, kept)
    return one_of_each(docs, kept, text, doc_id)


def op9_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
