"""The link graph: edges are ``(src, target, dst_key)``, nodes are paths without ``.md``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.link import canonical, canonical_target
from ..functions.path import bare
from ..shared import written


def at(edges: DataFrame, side: str, node: str) -> Column:
    """Whether an edge's ``side`` (``src`` or ``dst``) is ``node``: by folder and number where the edges have them."""
    if f"{side}_id" not in edges.columns:
        return bare(F.col("src")) == node if side == "src" else F.col("dst_key") == node
    folder, _, name = node.rpartition("/")
    if not re.fullmatch(r"-?[1-9]\d{0,17}|0", name):
        return F.lit(False)
    return (F.col(f"{side}_folder") == folder + "/") & (F.col(f"{side}_id") == int(name))


#: Nodes of a level that may be broadcast (some 10 MB).
SMALL = 100_000


def edge_pairs(edges: DataFrame) -> DataFrame:
    """Distinct ``(src, target, dst_key)``, sources bare, loops left out."""
    src = bare(F.col("src"))
    return edges.select(src.alias("src"), canonical_target(F.col("target")).alias("target"), "dst_key").filter("src <> dst_key").distinct()


def backlinks(edges: DataFrame, target: str, among: DataFrame | None = None) -> DataFrame:
    """``src`` of every file that links to ``target``, each once, in order; ``among`` restricts to its paths."""
    key = canonical(target)
    out = edges.filter(at(edges, "dst", key)).select(bare(F.col("src")).alias("src")).filter(F.col("src") != key)
    if among is not None:
        out = out.join(among.select(bare(F.col("path")).alias("src")), "src", "left_semi")
    return out.distinct().orderBy(F.split("src", "/"))


def linkers_of_any(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``src`` of every file that links to any of ``targets(path)``: one scan for all of them."""
    keys = targets.select(canonical_target(F.col("path")).alias("dst_key"))
    return edges.join(keys, "dst_key", "left_semi").select(bare(F.col("src")).alias("src")).distinct()


def forwardlinks(edges: DataFrame, source: str, among: DataFrame | None = None) -> DataFrame:
    """Distinct targets of one file, dangling ones too; parent references and the file itself left out."""
    key = canonical(source)
    out = edges.filter(at(edges, "src", key)).select(canonical_target(F.col("target")).alias("target"))
    out = out.filter((F.col("target") != key) & ~F.array_contains(F.split("target", "/"), ".."))
    if among is not None:
        out = out.join(among.select(bare(F.col("path")).alias("target")), "target", "left_semi")
    return out.distinct().orderBy(F.split("target", "/"))


def live(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges whose target exists, as it is written or with ``.md``."""
    there = paths.select(F.explode(F.array("path", bare(F.col("path")))).alias("dst_key")).distinct()
    return edges.join(there, "dst_key", "left_semi")


def orphans(files: DataFrame, edges: DataFrame, layer: str | None = None) -> DataFrame:
    """Files without a live outgoing link and without an incoming one; incoming links count store-wide."""
    nodes = files.select("path", bare(F.col("path")).alias("node"), "layer")
    pairs = edge_pairs(edges)
    out = live(pairs, files).select(F.col("src").alias("node"))
    inward = pairs.select(F.col("dst_key").alias("node"))
    left = nodes.join(out, "node", "left_anti").join(inward, "node", "left_anti")
    if layer:
        left = left.filter(F.col("layer") == layer)
    return left.select("path").orderBy(F.split("path", "/"))


def broken(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Every occurrence of a link whose target does not exist."""
    there = paths.select(F.explode(F.array("path", bare(F.col("path")))).alias("dst_key")).distinct()
    return edges.join(there, "dst_key", "left_anti")


def neighborhood(edges: DataFrame, start: str, hops: int, *, nodes: DataFrame | None = None, type: str | None = None,
                 direction: str = "both", max_nodes: int | None = 200) -> DataFrame:
    """``(path, summary, type, hops, via, direction)`` of what is reached in at most ``hops`` steps.

    Breadth first: of a level's nodes in discovery order, each one's outgoing
    neighbours in order come before its incoming ones; the first ``max_nodes``
    discovered count.  A node has its least hop and the node that led there.
    ``type`` narrows the output, not the walk; targets that do not exist are
    nodes with an empty summary.  Without a cap (``max_nodes=None``) each level
    is written as a table in the shared folder; a capped one
    is a few rows on the driver.  Levels of at most SMALL nodes, counted, are
    broadcast, so that links are scanned and not shuffled.
    """
    spark = edges.sparkSession
    kinds = "path string, hops int, place long, via string, side int"
    target = canonical_target(F.col("target"))

    def steps(level: DataFrame | None) -> DataFrame:
        """(node, next, side, place) of the links at a level's nodes; of the start's alone, by the scan's own filter.

        Links are not made distinct: what is reached is aggregated anyway.
        """
        src = bare(F.col("src"))
        loops = edges.filter(src != F.col("dst_key"))
        out = loops if level is not None else loops.filter(at(edges, "src", start))
        back = loops if level is not None else loops.filter(at(edges, "dst", start))
        out = out.select(src.alias("node"), target.alias("next"), F.lit(0).alias("side"))
        back = back.select(F.col("dst_key").alias("node"), src.alias("next"), F.lit(1).alias("side"))
        found = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
        return found.withColumn("place", F.lit(0).cast("long")) if level is None else found.join(level.select(F.col("path").alias("node"), "place"), "node")

    seen = spark.createDataFrame([(start, 0, 0, None, None)], kinds)
    level = None
    found = 0
    for hop in range(1, hops + 1):
        known = F.broadcast(seen) if found <= SMALL else seen
        reached = (
            steps(level).groupBy("next").agg(F.min(F.struct("place", "side", "node")).alias("by"))
            .join(known.select(F.col("path").alias("next")), "next", "left_anti")
        )
        order: list[Column] = [F.col("by.place"), F.col("by.side"), F.split("next", "/")]
        shown = [F.col("next").alias("path"), F.lit(hop).alias("hops"), F.col("by.node").alias("via"), F.col("by.side").alias("side")]
        if max_nodes is None:
            # Without a cap no global order is needed: the place is the discovering node's name.
            level = written(reached.select(*shown, F.xxhash64("next").alias("place")))
            n = level.count()
        else:
            rows = reached.orderBy(*order).limit(max(max_nodes - found, 0)).select(*shown).collect()  # ``max_nodes`` at most
            n = len(rows)
            level = spark.createDataFrame([(r.path, r.hops, k, r.via, r.side) for k, r in enumerate(rows)], kinds)
        found += n
        seen = seen.unionByName(level)
        level = F.broadcast(level) if n <= SMALL else level
        if not n or max_nodes is not None and found >= max_nodes:
            break
    rows = seen.filter("hops > 0").select("path", "hops", "via", F.when(F.col("side") == 0, "out").otherwise("in").alias("direction"))
    if nodes is None:
        return rows.orderBy("hops", F.split("path", "/"))
    known = nodes.select(bare(F.col("path")).alias("path"), F.col("summary"), F.col("type"))
    rows = rows.join(known, "path", "left").select("path", F.coalesce("summary", F.lit("")).alias("summary"), "type", "hops", "via", "direction")
    if type is not None:
        rows = rows.filter(F.col("type") == type)
    return rows.orderBy("hops", F.split("path", "/"))
