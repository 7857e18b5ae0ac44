"""Near-duplicates by SimHash, verified by the Jaccard similarity of whole shingle sets, none left out.

Every text gets its 64-bit SimHash fingerprint; the near-dedup operator's
index (:func:`.nearby.links`) gives those that differ in few bits, and the
pairs are verified.  But documents that are four fifths alike in five-word
shingles lie about ten bits apart in 64, beyond what any byte of such a
fingerprint guarantees.  So the same index follows on a fingerprint with as
many positions as such a pair can differ in, and more:

1. A set's shingles fall by hash into the positions of its size level; the
   value at a position is a hash of the shingles there.  Sets that differ in
   ``t`` shingles differ in ``t`` positions at most, so of ``t + least`` filled
   positions they share ``least``.  Just so many are indexed.  From level
   SAMPLED on a seeded share of the shingles is looked at, and six standard
   deviations of what it may differ by go on top (a loss of 1e-9 for a pair at
   the very bound).
2. Pairs of short lists are tallied over their shared positions; those below
   the guaranteed number go.  In long lists each set is paired with the one
   that stands in most long lists, its leader.
3. Every pair that is left is verified: sizes and parities first (bounds that
   no similar pair fails), then whole shingle sets.
4. Sets that met the same leader and that these links leave in different
   components are compared in blocks of parities, where they lie; what passes
   is verified too.  So no link between components is lost, and no group is
   turned into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearby
from . import words as W
from .common import bit_filter, components, lean, mark, modest, passing, quoted, release, sorted_lists, written

#: Lists up to PAIRED long are paired, longer ones by leaders.
PAIRED = 16
#: Shingles of the smallest set of level 1 (each next level doubles them), and the first level that is sampled.
SMALLEST, SAMPLED = 24, 4
#: Positions that a pair must share, of sets of COUNTED shingles or more (smaller ones: 1).
LEAST, COUNTED = 3, 96
#: Most bits of a set's parities; sets in a block of a group.
PARITIES, TILE = 1 << 15, 512
#: Texts whose hashes may be broadcast (8 bytes each).
FEW = 100_000
_LITTLE = 1e-9


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's lower-cased ``k``-word shingles, row after row, and where rows begin.

    A row of fewer words has its whole sequence; a row without words the empty one.
    """
    w = W.split(data, offsets)
    h = W.hashes(w, lower=True)
    rows = len(offsets) - 1
    long = w.counts >= k
    n = np.where(long, w.counts - k + 1, 1)
    row = np.repeat(np.arange(rows), n)
    out = np.zeros(len(row), W.U64)
    at = np.cumsum(n) - n
    if long.any():
        run = W.windows(h, k, two=False)[0]
        starts = W.ranges(w.first[:-1][long], n[long])
        out[long[row]] = run[starts]
    with np.errstate(over="ignore"):
        for r in np.flatnonzero(~long):
            own = h[w.first[r] : w.first[r + 1]]
            out[at[r]] = W.mix(np.array([(own * W.powers(W._P, max(len(own), 1))[: len(own)]).sum(dtype=W.U64) + W.U64(len(own))], W.U64))[0]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[new], np.searchsorted(row[new], np.arange(rows + 1))


def _sets(batches: Iterator[pa.RecordBatch], k: int, column: int = 0):
    """(batch, i, j, hashes, first, node) of slices of the batches' texts; equal sets have equal nodes."""
    for batch in batches:
        data, off = W.utf8(batch.column(column))
        for i, j in W.slices(off, 1 << 18):
            h, first = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
            with np.errstate(over="ignore"):
                mixed = np.append(W.mix(h), W.U64(0))
                node = W.mix(np.add.reduceat(mixed, first[:-1]) + np.diff(first).astype(W.U64)).view(np.int64)
            yield batch, i, j, h, first, node


def level(n: np.ndarray) -> np.ndarray:
    """The size level of sets of ``n`` shingles: 0 below SMALLEST, then one for each doubling."""
    return np.where(n < SMALLEST, 0, np.frexp(np.maximum(n, 1) / SMALLEST)[1]).astype(np.int64)


def least(n):
    """Positions that a set of ``n`` shingles shares with any that is similar."""
    return np.where(np.asarray(n) < COUNTED, 1, LEAST)


def differing(n: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """Positions of level ``at`` in which a set of ``n`` shingles can differ from one that is similar."""
    most = n * (1 / similarity - 1)
    seen = most / 2.0 ** np.maximum(at - SAMPLED, 0)
    return np.floor(np.where(at > SAMPLED, seen + 6 * np.sqrt(seen) + 4, most) + _LITTLE).astype(np.int64)


def positions(at: np.ndarray, similarity: float) -> np.ndarray:
    """Positions of a level's fingerprints: so many that its largest sets fill enough of them."""
    return np.ceil(1.8 * (differing(SMALLEST * 2.0**at, at, similarity) + LEAST)).astype(np.int64) + 8


def posted(h: np.ndarray, first: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the indexed positions of each set; the key's lowest five bits are its level.

    A set stands in its own level, and in the next if a similar one can.
    """
    n = np.diff(first)
    own = level(n)
    up = n >= similarity * SMALLEST * 2.0**own - _LITTLE
    row = np.append(np.arange(len(n)), np.flatnonzero(up))
    at = np.append(own, own[up] + 1)
    rows, keys = [], []
    tiny = row[at == 0]  # each shingle is a position of its own
    take = n[tiny] - np.ceil(similarity * n[tiny] - _LITTLE).astype(np.int64) + 1
    rows.append(np.repeat(tiny, take))
    keys.append(W.mix(h[W.ranges(first[:-1][tiny], take)]) & ~W.U64(31))
    row, at = row[at > 0], at[at > 0]
    if len(row):
        entry = np.repeat(np.arange(len(row)), n[row])
        own = h[W.ranges(first[:-1][row], n[row])]
        shift = np.maximum(at - SAMPLED, 0).astype(W.U64)
        seen = own <= (~W.U64(0) >> shift)[entry]
        entry, own = entry[seen], own[seen]
        with np.errstate(over="ignore"):
            place = (((own << shift[entry]) >> W.U64(32)) * positions(at, similarity).astype(W.U64)[entry]) >> W.U64(32)
            heads = np.flatnonzero(np.append(True, (entry[1:] != entry[:-1]) | (place[1:] != place[:-1])))
            value = np.add.reduceat(W.mix(own), heads) if len(own) else own
            entry, place = entry[heads], place[heads]
            rank = np.arange(len(entry)) - np.searchsorted(entry, entry)
            ok = rank < (differing(n[row], at, similarity) + least(n[row]))[entry]
            entry = entry[ok]
            key = W.mix(value[ok] + W.mix(place[ok] << W.U64(5) | at[entry].astype(W.U64)))
        rows.append(row[entry])
        keys.append(key & ~W.U64(31) | at[entry].astype(W.U64))
    return np.concatenate(rows), np.concatenate(keys)


def parities(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set the parities of its members by the lowest bits of their hashes, 2.7 to 5.3 bits a member."""
    n = np.diff(first)
    bits = np.minimum(64 << level(n), PARITIES)
    start = np.cumsum(bits) - bits
    row = np.repeat(np.arange(len(n)), n)
    out = np.zeros(int(bits.sum()) // 8, np.uint8)
    place = start[row] + (h & (bits[row] - 1).astype(W.U64)).astype(np.int64)
    np.bitwise_xor.at(out, place >> 3, (1 << (place & 7)).astype(np.uint8))
    raw = out.tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(start.tolist(), (start + bits).tolist())]


def folded(raw: bytes, size: int) -> bytes:
    """Parities by fewer bits of the hashes."""
    return raw if len(raw) == size else np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8).reshape(-1, size)).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], k: int, column: int = 0):
    """(batch, i, j, hashes, first, node) of slices of the batches' texts; equal sets have equal nodes."""
    for batch in batches:
        data, off = W.utf8(batch.column(column))
        for i, j in W.slices(off, 1 << 18):
            h, first = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
            with np.errstate(over="ignore"):
                node = W.mix(np.add.reduceat(W.mix(h), first[:-1]) + np.diff(first).astype(W.U64)).view(np.int64)
            yield batch, i, j, h, first, node


def _described(k: int, similarity: float):
    """(ident, text hash, text) to SimHash fingerprints, sizes, parities and index keys, these at the first place where a
    task meets a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch, i, j, h, first, node in _sets(batches, k, 2):
            own = _unseen(node, seen)
            n = np.diff(first)
            row, key = posted(h[W.ranges(first[:-1][own], n[own])], np.append(0, np.cumsum(n[own])), similarity)
            many = np.zeros(len(node), np.int32)
            many[own] = np.bincount(row, minlength=len(own))
            key = pa.array(key[np.argsort(row, kind="stable")].view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), key)
            data, off = W.utf8(batch.column(2))
            fp = pa.array(nearby.fingerprints(data[off[i] : off[j]], off[i : j + 1] - off[i], k).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(node), pa.array(n), fp, pa.array(parities(h, first), pa.binary()), keys],
                names=["ident", "source", "node", "n", "fp", "parities", "keys"],
            )

    return run


def _unseen(node: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose node this task has not met yet, as far as it remembers."""
    if len(seen) > 1 << 20:
        seen.clear()
    out = []
    for r, x in enumerate(node.tolist()):
        if x not in seen:
            seen.add(x)
            out.append(r)
    return np.array(out, np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, the smaller node first, and how often each is there."""
    ab, n = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0, return_counts=True)
    return ab[:, 0].copy(), ab[:, 1].copy(), n


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by key and node: the pairs of short lists with their tally, and the rows of long lists (tally 0).

    A long list passes through as it comes; no list is held whole.
    """

    def made(key, a, b, tally) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(tally.astype(np.int32))], names=["key", "a", "b", "tally"])

    for key, node, long in sorted_lists(batches, PAIRED):
        if long:
            yield made(key, node, node, np.zeros(len(key)))
            continue
        x, y = [], []
        for d in range(1, PAIRED):
            same = np.flatnonzero(key[d:] == key[:-d])
            x.append(same)
            y.append(same + d)
        a, b, n = _pairs(node[np.concatenate(x)], node[np.concatenate(y)])
        yield made(np.zeros(len(a), np.int64), a, b, n)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long lists, each with its leader first, to (leader, node)."""
    key0 = leader0 = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        first = node[heads]
        if key[0] == key0:
            first[0] = leader0
        leader = np.repeat(first, np.diff(np.append(heads, len(key))))
        key0, leader0 = key[-1], leader[-1]
        pairs = np.unique(np.stack([leader, node], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["leader", "node"])


def _allowed(n_a, n_b, similarity: float):
    """Shingles in which similar sets of these sizes differ at most; -1 if the sizes alone forbid it."""
    most = (1 - similarity) / (1 + similarity) * (n_a + n_b) + _LITTLE
    return np.where(np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) - _LITTLE, most, -1)


def _apart(similarity: float, nearest: bool):
    """Blocks of groups (leader, i, j, block, node, root, n, parities) to the pairs across components that may be similar.

    Block i meets block j; parities differ in no more places than the sets.
    With ``nearest`` only the pair that looks closest goes out for each set.
    """

    def tile(block, node, root, n, raw, apart: bool) -> tuple[np.ndarray, np.ndarray]:
        size = max(8, min(map(len, raw)))
        bits = np.frombuffer(b"".join([folded(x, size) for x in raw]), np.uint64).reshape(len(node), -1)
        # The largest component last: its members need no comparison with each other.
        _, at, many = np.unique(root, return_inverse=True, return_counts=True)
        order = np.argsort(at == many.argmax() if not apart else block, kind="stable")
        node, root, n, bits = node[order], root[order], n[order], bits[order]
        ends = int((block == block.min()).sum()) if apart else len(node) - int(many.max())
        x, y, step = [], [], max(1, (1 << 21) // bits.size)
        for lo in range(0, ends, step):
            own = np.arange(lo, min(lo + step, ends))
            start = ends if apart else lo + 1
            gap = np.bitwise_count(bits[own, None] ^ bits[None, start:]).sum(2, dtype=np.int64)
            room = _allowed(n[own, None], n[None, start:], similarity)
            ok = (gap <= room) & (root[own, None] != root[None, start:])
            if not apart:
                ok &= own[:, None] < np.arange(start, len(node))[None]
            if nearest:
                score = np.where(ok, gap / np.maximum(room, _LITTLE), np.inf)
                best = score.argmin(1) if score.shape[1] else np.zeros(0, int)
                found = np.flatnonzero(np.isfinite(score[np.arange(len(best)), best]))
                x.append(node[own[found]])
                y.append(node[start + best[found]])
            else:
                a, b = np.nonzero(ok)
                x.append(node[own[a]])
                y.append(node[start + b])
        return (np.concatenate(x), np.concatenate(y)) if x else (node[:0], node[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            _, i, j, block, node, root, n = (rows.column(c).to_numpy() for c in range(7))
            if (root == root[0]).all():
                continue
            apart = bool(i[0] != j[0])
            if apart and len(np.unique(block)) < 2:
                continue
            a, b, _ = _pairs(*tile(block, node, root, n, rows.column(7).to_pylist(), apart))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows, a table for each value of the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy() for c in range(keys)])
        heads = np.append(0, np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1)
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(heads, np.append(heads[1:], batch.num_rows)):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _near(similarity: float):
    """Of pairs with tallies, sizes and parities those that may be so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = [batch.column(f"n_{x}").to_numpy() for x in "ab"]
            raw = [batch.column(f"parities_{x}").to_pylist() for x in "ab"]
            size = [min(len(a), len(b)) for a, b in zip(*raw)]
            a, b = (np.frombuffer(b"".join([folded(x, m) for x, m in zip(side, size)]), np.uint8) for side in raw)
            gap = np.add.reduceat(np.bitwise_count(a ^ b), np.cumsum(size) - size, dtype=np.int64)
            ok = (gap <= _allowed(*n, similarity)) & (batch.column("tally").to_numpy() >= np.minimum(least(n[0]), least(n[1])))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _alike(similarity: float):
    """Of pairs with their whole sets those that are so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("hashes_a"), batch.column("hashes_b")):
                a, b = (np.frombuffer(x.as_buffer(), W.U64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= similarity * (len(a) + len(b) - both) - _LITTLE)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _whole(k: int, needed=None):
    """Of (text hash, text), all of them or those whose hash passes the filter, (node, hashes) of the sets."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            source = batch.column(0).to_numpy()
            own = np.arange(len(source)) if needed is None else passing(source, needed.value)
            own = own[_unseen(source[own], seen)]
            if len(own):
                yield batch.take(pa.array(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, h, first, node in _sets(passed(batches), k, 1):
            hashes = pa.array([h[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node), hashes], names=["node", "hashes"])

    return run


def _sides(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``nodes`` for both."""
    for x in "ab":
        side = nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in nodes.columns if c != "node"])
        pairs = pairs.join(side.hint("merge"), x)
    return pairs


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of the distinct pairs (a, b, tally) those whose sets are as similar as ``similarity`` or more."""
    pairs = written(pairs.groupBy("a", "b").agg(F.sum("tally").alias("tally")))
    near = written(_sides(pairs, nodes.select("node", "n", "parities")).mapInArrow(lean(_near(similarity)), "a long, b long"))
    # Only sets of pairs that are left are made from their texts again.  A few texts are told by a join that broadcasts
    # their hashes, many by a filter, which may pass others: these the next join drops.
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    ends = written(nodes.select("node", "source").join(ends, "node", "left_semi").select("source"))
    if ends.count() <= FEW:
        sets = texts.join(F.broadcast(ends), "source", "left_semi").mapInArrow(lean(_whole(k)), "node long, hashes binary")
    else:
        needed = nodes.sparkSession.sparkContext.broadcast(bit_filter(ends))  # 16 MB at most
        sets = texts.mapInArrow(lean(_whole(k, needed)), "node long, hashes binary")
    sets = written(sets.groupBy("node").agg(F.min("hashes").alias("hashes")))
    return written(_sides(near, sets).mapInArrow(lean(_alike(similarity)), "a long, b long"))


def _hashed_alike(nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b, tally) of sets whose SimHash fingerprints differ in ``bits`` bits or fewer: links that connect all of
    these, by the near-dedup operator's index of distinct fingerprints; those of equal ones lead to one of them."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("one")))
    equal = nodes.select("fp", F.col("node").alias("b")).join(prints, "fp").filter("one <> b").select(F.col("one").alias("a"), "b")
    near = nearby.links(prints.select("fp"), bits)
    for x in "ab":
        near = near.join(prints.select(F.col("fp").alias(x), F.col("one").alias(f"one_{x}")), x)
    return equal.union(near.select(F.least("one_a", "one_b"), F.greatest("one_a", "one_b"))).withColumn("tally", F.lit(LEAST))


def _across(led: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs of sets that met one leader, lie in different components and may be similar."""
    rooted = led.join(roots, "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root"))
    # A group's largest component is compared with the others, never with itself: its blocks come after theirs.
    sizes = rooted.groupBy("leader", "root").agg(F.count("*").alias("size"))
    split = sizes.groupBy("leader").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("main")).filter(F.col("size") > F.col("main.size"))
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    # Written, so that the join that follows is one that can be broadcast by its size or split by skew.
    split = written(split.select("leader", F.col("main.root").alias("main"), blocks(F.col("size") - F.col("main.size")).alias("others"), blocks(F.col("main.size")).alias("mains")))
    live = rooted.join(split, "leader")
    own, dealt = F.col("root") == F.col("main"), F.xxhash64("node")
    live = live.withColumn("block", F.when(own, F.col("others") + F.pmod(dealt, F.col("mains"))).otherwise(F.pmod(dealt, F.col("others"))).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(own, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    live = live.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
    live = live.join(nodes.select("node", "n", "parities").hint("merge"), "node")
    live = live.select("leader", "i", "j", "block", "node", "root", "n", "parities")
    live = live.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    found = live.mapInArrow(lean(_apart(similarity, nearest)), "a long, b long")
    return written(found.distinct().withColumn("tally", F.lit(LEAST)))


def similar_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, bits: int = 3) -> DataFrame:
    """``(ident, component_id)`` for every row: the smallest id reachable over links of ``similarity`` or more.

    Two texts are alike by the Jaccard similarity of their sets of lower-cased
    ``shingle``-word runs (fewer words: the whole sequence), compared by 64-bit
    hashes.  Null and empty texts are alike.  Equal sets are one node before
    anything is paired, so copies and repeated rows cost nothing; ties need no
    rule, as a class is named by its smallest id; rows without an id link
    others and share one row of a null ``ident``; a text of any length is one
    set, held by one task; an empty table gives no rows; other columns are not
    looked at.  ``similarity`` must be 0.7 to 1.  Pairs are found by SimHash at
    ``bits`` differing bits and by the wide index, and all are verified.
    """
    return _classed(docs, text, doc_id, shingle, similarity, bits).groupBy("ident").agg(F.min("component_id").alias("component_id"))


def _classed(docs: DataFrame, text: str, doc_id: str, shingle: int = 5, similarity: float = 0.8, bits: int = 3) -> DataFrame:
    """``(ident, source, component_id)`` of every row; ``source`` is its text's xxhash64."""
    if not 0.7 <= similarity <= 1:
        raise ValueError("similarity must be 0.7 to 1: below, a fingerprint's positions guarantee nothing")
    kept = modest(docs).select(F.col(quoted(doc_id)).alias("ident"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    kept = kept.select("ident", F.xxhash64("text").alias("source"), "text")
    texts = kept.select("source", "text")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = written(kept.mapInArrow(lean(_described(shingle, similarity)), f"ident {kind}, source long, node long, n long, fp long, parities binary, keys array<long>"))
    ids = rows.groupBy("node").agg(F.min("ident").alias("least"), F.min(F.struct("source", "n", "parities", "fp")).alias("p"))
    nodes = written(ids.select("node", "least", "p.*"))
    hashed = written(_hashed_alike(nodes, bits))
    listed = rows.select(F.explode("keys").alias("key"), "node")
    rows = rows.select("ident", "source", "node")
    met = written(listed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lean(_met), "key long, a long, b long, tally int"))
    long = met.filter("tally = 0").select("key", F.col("a").alias("node"))
    long = long.join(long.groupBy("node").count(), "node").repartition("key").sortWithinPartitions("key", F.desc("count"), "node")
    led = written(long.select("key", "node").mapInArrow(lean(_led), "leader long, node long").distinct())
    pairs = led.filter("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"), F.lit(LEAST).alias("tally"))
    edges = _verified(hashed.union(met.filter("tally > 0").select("a", "b", "tally")).union(pairs), nodes, texts, shingle, similarity)
    roots = components(edges)
    for nearest in (True, False):
        across = _across(led, roots, nodes, similarity, nearest)
        if across.isEmpty():
            break
        more = _verified(across, nodes, texts, shingle, similarity)
        if not more.isEmpty():
            edges = edges.union(more)
            roots = components(edges)
    named = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = written(named)
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(first, "root").select("node", "component_id"))
    return rows.join(named, "node").select("ident", "source", "component_id")


def without_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with one left of each group of similar texts: the one with the smallest id.

    Rows without an id are kept.  Of rows that repeat an id and a text one
    stays; where texts of several groups share an id, one of each group.  Null
    and empty texts are one group; every other column stays as it is; an empty
    table gives no rows.
    """
    since = mark()
    rows = _classed(docs, text, doc_id, **options).filter("ident is not null")
    kept = written(rows.groupBy("component_id", "ident").agg(F.min("source").alias("source")).filter("ident = component_id").select("ident", "source"))
    release(docs.sparkSession, since, kept)
    return one_of_each(docs, kept, text, doc_id)


def one_of_each(docs: DataFrame, kept: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``kept(ident, source)``, each once, and those without an id.

    The ids meet the texts by the same sort-merge join at every size.
    """
    ident, source = F.col(quoted(doc_id)), F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit("")))
    kept = kept.toDF("ident_kept", "source_kept")
    single = docs.join(kept.hint("merge"), (ident == F.col("ident_kept")) & (source == F.col("source_kept")), "left_semi")
    repeated = docs.filter(ident.isNotNull()).groupBy(ident).count().filter("count > 1")
    if not repeated.isEmpty():
        single = single.dropDuplicates([doc_id, text])
    return single.unionByName(docs.filter(ident.isNull()))
