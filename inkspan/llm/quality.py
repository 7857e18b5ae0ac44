"""Operator 1: quality by a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (:data:`NAMES`).  Each
class's covariance is shrunk to the pooled one and to its diagonal, factored
once (Cholesky), and a text's score is the difference of the two Mahalanobis
log densities, put on a probability scale by a logistic line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import bit_filter, held_out, labelled, lean, mark, modest, passing, quoted, release, table, written

#: The statistics, in the order of the vector.
NAMES = (
    "words", "mean_word", "sd_word", "upper", "digits", "marks", "stops", "bangs", "bars", "other_ascii",
    "beyond_ascii", "lines", "distinct_words", "distinct_pairs", "distinct_triples", "distinct_lines",
    "ended_marks", "ended_stops", "capital_words", "short_words", "long_words", "top_byte",
)

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 marks, 4 stops, 5 '!', 6 '|', 7 other ASCII, 8 beyond
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in "#$%&*@^~+=_/\\<>"]] = 3
_CLASS[[ord(c) for c in ".,?;:'\"-()"]] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
_CLASS[[ord(c) for c in "{}[]`"]] = 7
_CLASS[128:] = 8


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; an empty text has zero counts."""
    n = len(offsets) - 1
    w = W.split(data, offsets)
    count = w.counts
    size = w.ends - w.starts
    full = np.maximum(np.diff(offsets), 1)
    some = np.maximum(count, 1)
    kind = _CLASS[data]
    share = [W.per_row(kind == k, offsets) / full for k in range(1, 9)]
    h = W.hashes(w)

    def distinct(k: int) -> np.ndarray:
        runs = np.maximum(count - k + 1, 0)
        at = W.ranges(w.first[:-1], runs)
        g = W.windows(h, k, two=False)[0][at] if len(at) else np.zeros(0, W.U64)
        return np.where(runs > 0, W.distinct_per_row(g, np.append(0, np.cumsum(runs))) / np.maximum(runs, 1), 1.0)

    line = np.zeros(256, bool)
    line[0x0A] = True
    lines = W.split(data, offsets, line)
    n_lines = np.maximum(lines.counts, 1)
    mean = W.per_row(size, w.first) / some
    sd = np.sqrt(np.maximum(W.per_row(size.astype(np.float64) ** 2, w.first) / some - mean**2, 0))
    last = kind[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    first = kind[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    letters = np.flatnonzero((data >= 97) & (data <= 122))
    top = np.zeros(n)
    if n:
        hist = np.bincount(row[letters] * 26 + (data[letters] - 97), minlength=26 * n).reshape(n, 26)
        top = hist.max(1) / np.maximum(hist.sum(1), 1)
    log = lambda x: np.log(x + 1e-3)
    return np.stack(
        [
            np.log1p(count), np.log1p(mean), np.log1p(sd), *[log(x) for x in share[:8]],
            log(lines.counts / some), *[log(1.001 - np.minimum(distinct(k), 1)) for k in (1, 2, 3)],
            log(1.001 - W.distinct_per_row(W.hashes(lines), lines.first) / n_lines),
            log(W.per_row((last == 3) | (last == 5), w.first) / some), log(W.per_row(last == 4, w.first) / some),
            log(W.per_row(first == 1, w.first) / some), log(W.per_row(size <= 2, w.first) / some),
            log(W.per_row(size >= 14, w.first) / some), top,
        ],
        1,
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = W.utf8(batch.column(batch.num_columns - 1))
        for i, j in W.slices(off):
            x = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            rest = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, flat], names=[*batch.schema.names[:-1], "x"])


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the vector ``x`` of each whole text (null as empty)."""
    rows = modest(docs).select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    kinds = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = rows.mapInArrow(lean(_measured), kinds + "x array<double>")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "x")


def measure_labelled(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``doc_id`` and ``x`` of the rows that have a label to learn from, and by chance of some others.

    Ids are told by a filter where the texts lie, so no text is shuffled.
    """
    name = lambda c: F.xxhash64(c.cast("string"))
    ids = written(labelled(labels, label, modulus, remainder, doc_id).select(name(F.col("ident")).alias("h")))
    needed = docs.sparkSession.sparkContext.broadcast(bit_filter(ids))  # 16 MB at most
    ident = F.col(quoted(doc_id))
    rows = modest(docs).filter(ident.isNotNull()).select(name(ident).alias("h"), ident.alias("ident"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (batch.take(pa.array(passing(batch.column(0).to_numpy(), needed.value))) for batch in batches)
        yield from _measured(pa.RecordBatch.from_arrays(batch.columns[1:], names=["ident", "text"]) for batch in own if batch.num_rows)

    return rows.mapInArrow(lean(run), f"ident {docs.schema[doc_id].dataType.simpleString()}, x array<double>").withColumnRenamed("ident", doc_id)


def _matrix(col: pa.Array, k: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _moments(k: int):
    """Each partition's counts, sums and cross products by class, as (y, cell, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + k, 1 + k))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.concatenate([np.ones((len(y), 1)), _matrix(batch.column(1), k)], 1)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        m = (1 + k) ** 2
        yield pa.RecordBatch.from_pydict({
            "y": pa.array(np.repeat([0, 1], m), pa.int32()), "cell": pa.array(np.tile(np.arange(m), 2), pa.int32()), "v": pa.array(total.ravel()),
        })

    return run


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and priors of both classes; the logistic line."""

    mean: np.ndarray
    factor: np.ndarray
    offset: np.ndarray
    slope: float = 1.0
    bias: float = 0.0

    @classmethod
    def fit(cls, total: np.ndarray, to_pooled: float = 0.2, to_diagonal: float = 0.05) -> Discriminant:
        """From ``total[c]``, the sums of (1, x) (1, x)' of class c.

        A class without rows takes the other's mean, so that every score is
        the prior's; without any rows at all every score is one half.
        """
        n = total[:, 0, 0]
        k = total.shape[1] - 1
        mean = total[:, 0, 1:] / np.maximum(n, 1)[:, None]
        for c in (0, 1):
            if n[c] == 0:
                mean[c] = mean[1 - c]
        scatter = total[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / max(n.sum() - 2, 1)
        factor, offset = [], []
        for c in (0, 1):
            cov = (1 - to_pooled) * (scatter[c] / max(n[c] - 1, 1) if n[c] > 1 else pooled) + to_pooled * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(k)
            low = np.linalg.cholesky(cov)
            factor.append(np.linalg.inv(low))
            offset.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(low)).sum())
        return cls(mean, np.stack(factor), np.array(offset))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        d = [((x - self.mean[c]) @ self.factor[c].T) ** 2 for c in (0, 1)]
        return (self.offset[1] - 0.5 * d[1].sum(1)) - (self.offset[0] - 0.5 * d[0].sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * np.clip(self.margin(x), -60, 60) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (constant last) of a ridge logistic regression, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    beta = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(beta)) * max(len(x), 1)
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(measured: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id",
          modulus: int = 4, remainder: int = 2, line_rows: int = 20_000) -> Discriminant:
    """Fits on all labelled rows that are not held out; the logistic line on ``line_rows`` of them at most."""
    k = len(NAMES)
    rows = written(
        measured.select(F.col(quoted(doc_id)).alias("ident"), "x")
        .join(labelled(labels, label, modulus, remainder, doc_id), "ident").select("ident", "y", "x")
    )
    total = np.zeros((2, 1 + k, 1 + k))
    cells = rows.select("y", "x").mapInArrow(_moments(k), "y int, cell int, v double").groupBy("y", "cell").agg(F.sum("v").alias("v"))
    for y, cell, v in cells.collect():  # 2 (k + 1)^2 rows
        total[y].flat[cell] = v
    model = Discriminant.fit(total)
    # A seeded share of the rows, reduced to class and margin where they lie: 16 bytes a row come to the driver.
    share = min(1.0, 0.95 * line_rows / max(total[:, 0, 0].sum(), 1))
    draw = F.pmod(F.xxhash64(F.col("ident").cast("string"), F.lit(42)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    some = rows.filter(draw).select("y", "x").mapInArrow(lean(_margins(model)), "y int, m double").limit(line_rows).collect()
    if len({r.y for r in some}) == 2:
        beta = logistic(np.array([[r.m / 10] for r in some]), np.array([r.y for r in some], float))
        model.slope, model.bias = max(beta[0], 0.0) / 10, beta[1]
    return model


def _margins(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.clip(model.margin(_matrix(batch.column(1), len(NAMES))), -60, 60)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m)], names=["y", "m"])

    return run


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(batch.num_columns - 1), len(NAMES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, score)`` of every row.  Null and empty texts score as a text without words;
    repeated rows score alike; a null id scores but teaches nothing; an empty table gives no rows."""
    measured = written(measure(docs, [doc_id], text))
    model = train(measured, labels, label, doc_id)
    kind = docs.schema[doc_id].dataType.simpleString()
    return measured.withColumnRenamed(doc_id, "ident").mapInArrow(lean(_scored(model)), f"ident {kind}, score double").withColumnRenamed("ident", doc_id)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, every column as it was.

    Null and empty texts are judged as texts without words, repeated rows
    alike; a row without an id is judged like any other; an empty table gives
    no rows.
    """
    since = mark()
    model = train(measure_labelled(docs, labels, "quality", text, doc_id), labels, "quality", doc_id)
    release(docs.sparkSession, since)
    rest = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*rest, F.coalesce(F.col(quoted(text)), F.lit("")).alias("text_in"))
    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(docs.columns))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column(batch.num_columns - 1))
            ok = [model.score(statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])) >= threshold for i, j in W.slices(off)]
            if ok:
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(np.concatenate(ok)))

    return rows.mapInArrow(lean(keep), kinds).select([F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
