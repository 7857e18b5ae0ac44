"""Operator 10: approximate nearest neighbours by an adaptive dimension scan.

Vectors are extended by one component so that the largest inner product is the
smallest distance, rotated by a seeded orthogonal matrix, and dealt out to
inverted lists around centres fitted on a bounded sample; every vector is
indexed.  A query probes its nearest lists.  Within a list, distances grow over
blocks of rotated columns, and a candidate goes as soon as a hypothesis test on
its partial distance says that the whole would exceed the query's threshold.
Those that remain are scored exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, table, written

#: Vectors and queries of one tile; a list of more has more tiles.
TILE_VECTORS, TILE_QUERIES = 512, 256
#: Rows to fit centres on and their bytes in double precision, lists and Lloyd rounds, all at most.
SAMPLE, SAMPLE_BYTES, LISTS, ROUNDS = 100_000, 64 << 20, 2048, 8
COLUMNS, EPSILON = 16, 1.5
#: Sample rows whose neighbours decide the probes, and those whose scores bound a query's k-th.
TRIED, HEAD = 256, 4096


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; an empty list takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * (x @ c.T)
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.flatnonzero(n == 0)
        c = total / np.maximum(n, 1)[:, None]
        if len(empty):
            far = np.argsort(-(d[np.arange(len(x)), near] + (x * x).sum(1)), kind="stable")[: len(empty)]
            c[empty] = x[far]
    return c


class Index:
    """The fitted part of an index: rotation, largest norm, centres, probes; small enough to send along.

    ``probes`` is the fewest lists that hold ``recall`` of the nearest sample
    rows of some sample rows: clustered vectors need few, structureless many.
    ``head`` are some of the sample's rows, HEAD at most: the k-th score of a
    query among them is a threshold that what the scan finds must reach.
    """

    def __init__(self, ids: np.ndarray, sample: np.ndarray, top_norm2: float, k: int, neighbours: int, recall: float, seed: int) -> None:
        self.turn = rotation(sample.shape[1] + 1, seed)
        self.top = top_norm2
        n = min(HEAD, max(2 * neighbours, len(sample) // 12))
        one = np.unique(ids, return_index=True)[1][:n]  # an id counts once
        self.head_ids, self.head = ids[one], sample[one]
        turned = self.rotated(sample)
        self.centres = centres(turned, min(k, len(turned)), ROUNDS, seed)
        self.half = (self.centres**2).sum(1)
        own = self.nearest(turned, 1)[:, 0]
        tried = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
        score = tried @ sample.T
        most = min(neighbours + 1, len(sample))  # a tried row finds itself too
        near = own[np.argpartition(-score, most - 1, axis=1)[:, :most]]
        order = self.nearest(self.rotated(tried, True), len(self.centres))
        place = np.argsort(order, axis=1)
        need = np.sort(np.take_along_axis(place, near, 1).ravel())
        self.probes = int(need[min(len(need) - 1, math.ceil(recall * len(need)))]) + 1

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.concatenate([x, more[:, None]], 1) @ self.turn

    def nearest(self, turned: np.ndarray, n: int) -> np.ndarray:
        d = self.half - 2 * (turned @ self.centres.T)
        n = min(n, d.shape[1])
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)

    def threshold(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """A score that each query's k-th neighbour reaches at least (minus infinity where the head is too short)."""
        score = q @ self.head.T
        score[ids[:, None] == self.head_ids[None, :]] = -np.inf
        if score.shape[1] < k:
            return np.full(len(q), -np.inf)
        return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - 1e-9


def usable(rows: DataFrame, ident: str, vector: str, d: int | None = None) -> DataFrame:
    """``(id, v)`` of the rows that take part: a non-null id and ``d`` finite components, not all zero.

    Without ``d`` the table's commonest dimension is taken (of equally common
    ones the larger); vectors of another dimension have no inner product with
    these and take no part.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.col(quoted(ident)).cast("long").alias("id"), F.col(quoted(vector)).alias("v")).filter("id is not null and v is not null")
    found = found.filter(good & F.exists("v", lambda x: x != 0))
    if d is None:
        d = found.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).select("m.d").first()[0] or 0
    return found.filter(F.size("v") == d)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _listed(index):
    """(id, v) to (id, v, list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = index.value.nearest(index.value.rotated(_matrix(batch.column(1))), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["id", "v", "list"])

    return run


def _probing(index, probes: int, k: int):
    """(id, v) to (id, v, bound, list), one row for each probed list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own = batch.slice(i, 256)
                q = _matrix(own.column(1))
                lists = index.value.nearest(index.value.rotated(q, True), probes)
                bound = index.value.threshold(own.column(0).to_numpy(), q, k)
                at = np.repeat(np.arange(own.num_rows), lists.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(at)), own.column(1).take(pa.array(at)), pa.array(bound[at]), pa.array(lists.ravel().astype(np.int32))],
                    names=["id", "v", "bound", "list"],
                )

    return run


def scan(q: np.ndarray, q_turned: np.ndarray, q_ids: np.ndarray, limit: np.ndarray, x: np.ndarray, x_turned: np.ndarray,
         ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The adaptive scan of some queries over some vectors: query rows, vector rows and exact scores, the best ``k`` of each query.

    ``limit`` is a distance that each query's k-th neighbour does not exceed.
    Partial distances grow by blocks of columns, as matrix products while many
    pairs are alive, then pair by pair.
    """
    d = x_turned.shape[1]
    alive = q_ids[:, None] != ids[None, :]
    partial = np.zeros(alive.shape)
    pairs = None
    for a in range(0, d, COLUMNS):
        b = min(a + COLUMNS, d)
        xb, qb = x_turned[:, a:b], q_turned[:, a:b]
        if pairs is None:
            partial += (qb * qb).sum(1)[:, None] + (xb * xb).sum(1)[None, :] - 2 * (qb @ xb.T)
        else:
            gap = xb[pairs[1]] - qb[pairs[0]]
            rest += np.einsum("ij,ij->i", gap, gap)
        if not a and len(ids) > k:
            # The k nearest by the first columns, measured in full, bound the k-th distance too.
            first = np.argpartition(np.where(alive, partial, np.inf), k - 1, axis=1)[:, :k]
            whole = ((x_turned[first] - q_turned[:, None]) ** 2).sum(2)
            whole[~np.take_along_axis(alive, first, 1)] = np.inf
            limit = np.minimum(limit, whole.max(1))
        if b == d:
            break
        # Under rotation, partial * d / b estimates the distance with deviation falling as 1 / sqrt(b).
        most = (limit * (1 + EPSILON / math.sqrt(b)) ** 2 + 1e-9) * (b / d)
        if pairs is None:
            alive &= partial <= most[:, None]
            if alive.mean() < 0.1:
                pairs = np.nonzero(alive)
                rest = partial[pairs]
        else:
            keep = rest <= most[pairs[0]]
            pairs, rest = (pairs[0][keep], pairs[1][keep]), rest[keep]
    if pairs is None:
        pairs = np.nonzero(alive & (partial <= (limit + 1e-9)[:, None]))
    else:
        keep = rest <= limit[pairs[0]] + 1e-9
        pairs = (pairs[0][keep], pairs[1][keep])
    score = (x[pairs[1]] * q[pairs[0]]).sum(1)
    order = np.lexsort((ids[pairs[1]], -score, pairs[0]))
    row = pairs[0][order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    order = order[rank < k]
    return pairs[0][order], pairs[1][order], score[order]


def _tile(index, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            x = _matrix(left.column("v").combine_chunks())
            x_turned = index.value.rotated(x)
            for i in range(0, right.num_rows, 128):
                own = right.slice(i, 128)
                q, q_ids = _matrix(own.column("v").combine_chunks()), own.column("id").to_numpy()
                limit = (q * q).sum(1) + index.value.top - 2 * own.column("bound").to_numpy()
                a, b, score = scan(q, index.value.rotated(q, True), q_ids, limit, x, x_turned, ids, k)
                out.append((q_ids[a], ids[b], score))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return run


def search(rows: DataFrame, queries: DataFrame, k: int = 20, ident: str = "vec_id", vector: str = "embedding",
           lists: int | None = None, probes: int | None = None, recall: float = 0.96, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query, nearest first.

    Nearness is the largest inner product in double precision, ties to the
    smaller id; a query's own id is no candidate.  Rows and queries that are
    null, zero or hold null or non-finite components take no part, nor do rows
    without an id or of another dimension than the commonest.  Ids of ``rows``
    and ``queries`` are longs; rows that repeat an id and vector count once.
    Empty tables give no rows; other columns are not looked at.  Centres are
    fitted on ``sample`` rows at most, of SAMPLE_BYTES at most.  ``lists`` is half the root of the rows' number
    unless given; ``probes`` as many as find ``recall`` on the sample.
    """
    spark = rows.sparkSession
    base = written(usable(rows, ident, vector).dropDuplicates(["id", "v"]))
    wide = F.transform("v", lambda x: x.cast("double"))
    norm = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)
    facts = base.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("d")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries, ident, vector, facts.d).dropDuplicates(["id", "v"])
    lists = min(lists or math.isqrt(facts.n) // 2 + 1, LISTS, facts.n)
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * facts.d)))
    share = min(1.0, 0.9 * sample / facts.n)
    drawn = base.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(sample)
    drawn = drawn.toArrow()  # ``sample`` rows at most
    drawn = (drawn if drawn.num_rows else base.limit(1).toArrow()).sort_by("id")
    fitted = Index(drawn.column("id").to_numpy(), _matrix(drawn.column("v").combine_chunks()), facts.top, lists, k, recall, seed)
    index = spark.sparkContext.broadcast(fitted)
    kind = base.schema["v"].dataType.simpleString()
    listed = written(base.mapInArrow(_listed(index), f"id long, v {kind}, list int"))
    probing = written(asked.mapInArrow(_probing(index, min(probes or fitted.probes, lists), k), f"id long, v {kind}, bound double, list int"))
    # How many tiles each list has, one small row a list: vectors and queries of a hot list are split both ways.
    tiles = (
        listed.groupBy("list").agg(F.ceil(F.count("*") / TILE_VECTORS).cast("int").alias("nx"))
        .join(probing.groupBy("list").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("nq")), "list")
    )
    tiles = F.broadcast(written(tiles))  # LISTS rows at most
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    x = listed.join(tiles, "list").select("id", "v", "list", spread("nx").alias("tx"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("tq"))
    q = probing.join(tiles, "list").select("id", "v", "bound", "list", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("tx"), spread("nq").alias("tq"))
    found = x.groupBy("list", "tx", "tq").cogroup(q.groupBy("list", "tx", "tq")).applyInArrow(_tile(index, k), "query_id long, vec_id long, score double")
    # A vector of one id may stand in several rows only if its vectors differ; the best counts.
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter("vec_id % 20 = 0"))
