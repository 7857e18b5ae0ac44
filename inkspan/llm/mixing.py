"""Operator 6: mixing sources to target weights, by capped water-filling.

Everything is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, quoted, table, written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """Water-filling over one row ``(source, source_size)`` per source.

    Sources in code-point order, null last, weigh ``weights`` in turn.  The
    total is ``share`` times all sizes; no target exceeds ``epochs`` times its
    source's size.  Taken by cap per weight, a source is clamped if its cap is
    at most its part of what the clamped ones before it leave; the others
    divide the rest by weight.  The windows hold one row per source, never
    documents.  A source of size 0 has the target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    picks = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(picks, ((F.row_number().over(order) - 1) % len(weights) + 1)))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(every) * F.lit(float(share)),
            "weights": F.sum("weight").over(every),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    s = s.withColumn("clamped", F.col("cap") <= F.col("weight") * level)
    s = s.withColumns(
        {
            "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0)),
            "open": F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every),
        }
    )
    return s.select(
        "source",
        "source_size",
        F.when(F.col("clamped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * (F.col("rest") / F.col("open")))
        .alias("target"),
    )


def sized(docs: DataFrame, seed: int, text: str, source: str, doc_id: str, keep: Sequence[str]) -> tuple[DataFrame, dict]:
    """``keep`` columns, and each document's size, source and place in the seeded order."""
    names = {x: fresh(docs, x) for x in ("size", "source", "key")}
    ident = F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))
    return docs.select(
        *[F.col(quoted(c)) for c in keep],
        word_count(F.col(quoted(text))).alias(names["size"]),
        F.col(quoted(source)).alias(names["source"]),
        F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias(names["key"]),
    ), names


def mixing_plan(
    rows: DataFrame, names: dict, weights: Sequence[int], share: float, epochs: int
) -> DataFrame:
    """One row per source: its target, whole repetitions, and where the last, partial one ends.

    ``rows`` are read twice, so pass a written table.  Sums per source and
    range of the seeded order (its first three hex digits) find the range in
    which a source's rest ends; only that range's documents are then ordered,
    so a hot source meets no single task.
    """
    part = F.conv(F.substring(F.col(names["key"]), 1, 3), 16, 10).cast("int")
    ranged = rows.select(
        F.col(names["source"]).alias("source"), part.alias("part"), F.col(names["key"]).alias("key"), F.col(names["size"]).alias("size")
    )
    sums = written(ranged.groupBy("source", "part").agg(F.sum("size").alias("size")))
    plan = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(
        plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .select(F.col("source").alias("s2"), "part", "before", "size")
        .join(plan, F.col("s2").eqNullSafe(F.col("source")))
        .filter(F.col("before") + F.col("size") > F.col("rest"))
        .groupBy("s2")
        .agg(F.min(F.struct("part", "before", "rest")).alias("last"))
        .select("s2", F.col("last.part").alias("p2"), "last.before", "last.rest")
    )
    last = written(last)
    peers = Window.partitionBy("source").orderBy("key", "size")
    cuts = (
        ranged.join(last, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
        .groupBy("source", "key", "size", "before", "rest")
        .agg(F.sum("size").alias("own"))
        .withColumn("until", F.col("before") + F.sum("own").over(peers))
        .filter(2 * F.col("until") - F.col("own") <= 2 * F.col("rest"))
        .groupBy(F.col("source").alias("s3"))
        .agg(F.max(F.struct("key", "size")).alias("cut"))
    )
    # With no document of its last range taken, a source's order ends before it.
    return (
        plan.join(last.select("s2", "p2"), F.col("source").eqNullSafe(F.col("s2")), "left")
        .join(cuts, F.col("source").eqNullSafe(F.col("s3")), "left")
        .select("source", "source_size", "target", "whole", F.col("p2").alias("last_part"), "cut")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    epochs: int = 2,
    seed: int = 42,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``mix_size, mix_source_size, mix_target, mix_repeats`` to every document.

    A source whose target is e times its size takes every document floor(e)
    times, and once more those first in a seeded order (md5 of seed and id,
    then size) whose midpoint in the running size lies within the rest: a
    source misses its target by half its boundary document at most.

    ``keep`` names the columns to return besides (default: all).  With the
    texts left out, they are read once; else once for the sizes and once more
    for the rows.  Null text has size 0; a null source is a source; a null id
    is ordered as the empty text; rows with one id and size share their fate;
    an empty table gives no rows.  Columns of the four added names are replaced.
    """
    added = ("mix_size", "mix_source_size", "mix_target", "mix_repeats")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    narrow = [c for c in keep if c != text]
    rows, names = sized(docs, seed, text, source, doc_id, narrow)
    rows = written(rows)
    plan = written(mixing_plan(rows, names, weights, share, epochs))
    own = {c: fresh(docs, f"plan_{c}") for c in plan.columns}
    plan = plan.select([F.col(c).alias(own[c]) for c in plan.columns])
    if text in keep:
        rows, names = sized(docs, seed, text, source, doc_id, keep)
    part = F.conv(F.substring(F.col(names["key"]), 1, 3), 16, 10).cast("int")
    last = F.col(own["last_part"])
    here = F.struct(F.col(names["key"]).alias("key"), F.col(names["size"]).alias("size"))
    extra = F.when(last.isNull() | (part < last), 1).when(part > last, 0).otherwise(
        F.coalesce(here <= F.col(own["cut"]), F.lit(False)).cast("int")
    )
    joined = rows.join(plan, F.col(names["source"]).eqNullSafe(F.col(own["source"])), "left")
    return joined.select(
        *[F.col(quoted(c)) for c in keep],
        F.col(names["size"]).alias("mix_size"),
        F.col(own["source_size"]).alias("mix_source_size"),
        F.col(own["target"]).alias("mix_target"),
        F.when(F.col(own["source_size"]) == 0, 0).otherwise(F.col(own["whole"]) + extra).cast("long").alias("mix_repeats"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as the mix repeats it, with the columns of ``docs``.

    Null and empty texts weigh nothing and are taken as often as their source;
    a null source is a source; a null id is ordered as the empty text; rows
    that repeat id and size share their fate; an empty table gives no rows; a
    text of any length is one document.
    """
    rows = mix(docs, **options)
    n = fresh(rows, "copy")
    # sequence(1, 0) would count down.
    return rows.filter("mix_repeats > 0").withColumn(n, F.explode(F.expr("sequence(1L, mix_repeats)"))).select(
        [F.col(quoted(c)) for c in docs.columns]
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_repeats") * F.col("mix_size")).alias("taken"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         list_element([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)) AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, cap / w AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5 AS total, (SELECT sum(w) FROM s) AS ws FROM s),
g AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM f WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, cap <= w * ((total - cap_before) / (ws - w_before)) AS clamped FROM g),
r AS (
  SELECT (max(total) - coalesce(sum(cap) FILTER (clamped), 0)) / sum(w) FILTER (NOT clamped) AS level FROM h),
t AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE w * level END AS target FROM h, r),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
v AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size) AS until,
         sum(d.size) OVER (PARTITION BY d.source, d.key, d.size) AS own
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * until - own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM v
"""
