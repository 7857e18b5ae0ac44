"""Store statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .graph import broken, orphans

TOP = 10


def totals(files: DataFrame) -> DataFrame:
    """``(total_files, total_size_bytes)``"""
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes"))


def files_per_layer(files: DataFrame) -> DataFrame:
    return files.groupBy("layer").agg(F.count("*").alias("n"))


def type_distribution(records: DataFrame) -> DataFrame:
    """``(type, n)`` of non-blank types, trimmed."""
    kind = F.trim("type")
    return records.select(kind.alias("type")).filter("type <> ''").groupBy("type").agg(F.count("*").alias("n"))


def top_types(records: DataFrame, most: int = TOP) -> DataFrame:
    return type_distribution(records).orderBy(F.desc("n"), "type").limit(most)


def stats(files: DataFrame, records: DataFrame, edges: DataFrame, paths: DataFrame) -> dict:
    """Everything at once, as one small mapping; files are parsed once for types and once for links."""
    total = totals(files).first()
    types = written(records.select("type"))
    edges, paths = written(edges.select("src", "target", "dst_key")), paths.select("path")
    return {
        "total_files": total.total_files, "total_size_bytes": total.total_size_bytes,
        "files_per_layer": {r.layer: r.n for r in files_per_layer(files).collect()},
        "type_distribution": {r.type: r.n for r in type_distribution(types).orderBy("type").collect()},
        "top_types": [(r.type, r.n) for r in top_types(types).collect()],
        "orphan_count": orphans(files, edges).count(),
        "broken_link_count": broken(edges, paths).count(),
    }
