"""Session helpers of this subpackage: filters, names, lists, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import forget_written, mark, release, written

#: The word pattern of every contract: runs of anything but space and tab..CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the Arrow batches in which texts go to Python, unless the session asks for others than Spark's 64 MB.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def modest(df: DataFrame) -> DataFrame:
    """``df``, whose texts are to go to Python: makes the session's Arrow batches smaller, where it has Spark's own size.

    A task holds a batch several times over, in the JVM and in Python.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, "64m").lower() in ("64m", "64mb", "67108864", "67108864b"):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df


def lean(run):
    """An Arrow function that gives back, when its task ends, what memory its worker holds free.

    Workers outlive their tasks; an idle one would keep the most that any of
    them took.
    """

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ended


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever its letters' case."""
    have, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def held_out(column, modulus: int, remainder: int):
    """Whether crc32 of an id's decimal text leaves ``remainder``; false for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled(labels: DataFrame, label: str, modulus: int, remainder: int, doc_id: str = "doc_id") -> DataFrame:
    """``(ident, y)``: the rows to learn from, one for each id whose labels agree and are 0 or 1.

    Ids whose crc32 leaves ``remainder`` are held out; null ids and labels teach nothing.
    """
    rows = labels.select(F.col(quoted(doc_id)).alias("ident"), F.col(quoted(label)).cast("int").alias("y"))
    rows = rows.filter("ident is not null and y in (0, 1)").filter(~held_out(F.col("ident"), modulus, remainder))
    return rows.groupBy("ident").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("ident", "y")


def bounded(rows: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` of ``(ident, y)``, a seeded share of them: small enough to broadcast.

    The share is drawn where the rows lie, so no task and no driver meets more than it takes.
    """
    share = min(1.0, 0.95 * most / max(rows.count(), 1))
    draw = F.pmod(F.xxhash64(F.col("ident").cast("string"), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    return written(rows.filter(draw).limit(most))


#: Bits in a block of a filter, and in a whole one at most.
BLOCK, FILTER_BITS = 1 << 16, 1 << 27


def _marked(bits: int):
    """Hashes to the blocks of a filter of ``bits`` bits, by their lowest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(bits, bool)
        for batch in batches:
            mark[batch.column(0).to_numpy() & (bits - 1)] = True
        for b in np.flatnonzero(mark.reshape(-1, BLOCK).any(1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(mark[b * BLOCK : (b + 1) * BLOCK]).tobytes()], pa.binary())})

    return run


def _any(group: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in group.column("bits")])
    return pa.table({"block": group.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def bit_filter(hashes: DataFrame) -> bytes:
    """A filter that every hash of a one-column table passes, and the less other hashes the larger it is.

    It has 32 bits a row as far as FILTER_BITS allow (16 MB): a table beyond
    that is filtered worse, never wrongly, so a join must follow.
    """
    bits, many = BLOCK, hashes.count()
    while bits < FILTER_BITS and bits < 32 * many:
        bits *= 2
    merged = bytearray(bits // 8)
    for block, part in hashes.mapInArrow(_marked(bits), "block int, bits binary").groupBy("block").applyInArrow(_any, "block int, bits binary").toLocalIterator():
        merged[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = part
    return bytes(merged)


def passing(hashes: np.ndarray, needed: bytes) -> np.ndarray:
    """Places of the hashes that a filter passes."""
    mark = np.frombuffer(needed, np.uint8)
    at = hashes & (8 * len(mark) - 1)
    return np.flatnonzero(mark[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)


def sorted_lists(batches: Iterator[pa.RecordBatch], most: int, held_rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows (key, value) in their order, repeats left out: (keys, values, whether these are of long lists).

    Lists of up to ``most`` values come whole, many at a time; longer ones pass
    through as their rows come, so that no list is held.
    """

    def whole(key: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(heads, len(key)))
        long = np.repeat(size > most, size)
        for kind in (False, True):
            if (own := long == kind).any():
                yield key[own], value[own], kind

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in parts) >= held_rows:
                rest = yield (*(np.concatenate(x) for x in zip(*parts)), False)
                parts = [rest] if rest is not None else []
        if parts:
            yield (*(np.concatenate(x) for x in zip(*parts)), True)

    open_key = last = None
    source, rest = chunks(), None
    while True:
        try:
            key, value, end = source.send(rest)
        except StopIteration:
            return
        rest = None
        new = np.append((key[0], value[0]) != last, (key[1:] != key[:-1]) | (value[1:] != value[:-1]))
        key, value = key[new], value[new]
        more = 0 if open_key is None else int((key == open_key).sum())
        if more:
            yield key[:more], value[:more], True
            last = key[more - 1], value[more - 1]
            key, value = key[more:], value[more:]
        if not len(key):
            continue
        cut = len(key) if end else int((key != key[-1]).sum())
        if cut:
            yield from whole(key[:cut], value[:cut])
        open_key = last = None
        if len(key) - cut > most:
            yield key[cut:], value[cut:], True
            open_key, last = key[-1], (key[-1], value[-1])
        elif cut < len(key):
            rest = key[cut:], value[cut:]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of non-null longs.

    Returns one row ``(node, root)`` for each node in an edge, ``root`` being
    the smallest node of its component.  Each round, every node points to its
    smallest neighbour (or itself), pointers are followed to their ends by
    doubling, edges are renamed to those ends, and loops and repeats go: every
    node that is not an end goes, so the nodes at least halve.  Every join
    is an equi-join that AQE may split, every aggregation combines map-side,
    and each round's edges and names are written to the shared folder, so a
    lost executor costs at most one round.  An empty edge list gives no rows.
    """
    spark, since = edges.sparkSession, mark()
    live = written(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    )
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        step = _settled(written(step.select("node", F.least("node", "m").alias("to"))))
        steps.append(step)
        live = written(
            live.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .filter("a <> b")
            .distinct()
        )
    if not steps:
        return edges.sparkSession.createDataFrame(
            [], T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
        )
    names = None
    for step in reversed(steps):
        if names is not None:
            step = step.join(
                names.select(F.col("node").alias("to"), "root"), "to", "left"
            ).select("node", F.coalesce("root", "to").alias("to"))
        names = written(step.select("node", F.col("to").alias("root")))
    release(spark, since, names)
    return names


def _settled(step: DataFrame) -> DataFrame:
    """Follows the pointers ``node -> to`` to their ends, doubling the stride."""
    while True:
        far = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = written(
            step.join(far, "to").select("node", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved"))
        )
        moved = not step.filter("moved").isEmpty()
        step = step.select("node", "to")
        if not moved:
            return step
