"""Assets: binary files that records declare, and their manifest."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lazy import pandas
from ..functions.path import is_safe, media_type
from ..schema import ASSETS
from ..sources import frontmatter as fm
from .catalog import write_if_changed

_DECLARED = "array<struct<path:string,required:boolean>>"


def declared_in(front: dict) -> list[dict]:
    """``asset: path``, ``asset: {path, required}`` or a list of either under ``assets``."""
    out = []
    for value in (front.get("asset"), front.get("assets")):
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, dict) and isinstance(item.get("path"), str):
                out.append({"path": item["path"].strip(), "required": item.get("required") is not False})
            elif isinstance(item, str) and item.strip():
                out.append({"path": item.strip(), "required": True})
    return out


@pandas(_DECLARED)
def _declared(states: pd.Series, yamls: pd.Series) -> pd.Series:
    return pd.Series([declared_in(fm.load(y) or {}) if s == fm.OK else [] for s, y in zip(states, yamls)])


def declarations(files: DataFrame) -> DataFrame:
    """``(wrapper, path, required)``: each declaration of a safe path."""
    rows = files.filter("utf8_ok").select(F.col("path").alias("wrapper"), F.explode(_declared("fm_state", "fm_yaml")).alias("d"))
    return rows.select("wrapper", "d.path", "d.required").filter(is_safe(F.col("path")))


def rolled_up(declared: DataFrame) -> DataFrame:
    """``(path, wrappers, required)``: sorted distinct wrappers; required if any of them says so."""
    return declared.groupBy("path").agg(F.array_sort(F.collect_set("wrapper")).alias("wrappers"), F.bool_or("required").alias("required"))


def hashed(paths: DataFrame, root: str) -> DataFrame:
    """``(path, sha256, bytes)`` of files under ``root``, streamed on the executors; missing ones have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch["path"]:
                own = os.path.join(root, p)
                if not os.path.isfile(own):
                    out.append((p, None, None))
                    continue
                h = hashlib.sha256()
                with open(own, "rb") as f:
                    while part := f.read(1 << 16):
                        h.update(part)
                out.append((p, h.hexdigest(), os.path.getsize(own)))
            yield pd.DataFrame(out, columns=["path", "sha256", "bytes"]).astype({"bytes": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, sha256 string, bytes long")


def scan(declared: DataFrame, manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """The new manifest: what is declared, with hashes of what is there; what is not there keeps its former row's."""
    old = manifest.select("path", F.col("sha256").alias("old_sha"), F.col("bytes").alias("old_bytes"))
    rows = rolled_up(declared).join(actual, "path", "left").join(old, "path", "left")
    rows = rows.withColumns({"sha256": F.coalesce("sha256", "old_sha"), "bytes": F.coalesce("bytes", "old_bytes"), "media_type": media_type(F.col("path"))})
    return rows.filter("sha256 is not null").select("path", "sha256", "bytes", "media_type", "wrappers", "required").orderBy("path")


def verify(manifest: DataFrame, actual: DataFrame, include_optional: bool = False, quick: bool = False) -> DataFrame:
    """``(path, state)``: ok, missing or corrupt; ``quick`` compares sizes only."""
    rows = manifest if include_optional else manifest.filter("required")
    now = actual.select("path", F.col("sha256").alias("now_sha"), F.col("bytes").alias("now_bytes"))
    same = F.col("bytes") == F.col("now_bytes")
    if not quick:
        same = same & (F.col("sha256") == F.col("now_sha"))
    state = F.when(F.col("now_bytes").isNull(), "missing").when(same, "ok").otherwise("corrupt")
    return rows.join(now, "path", "left").select("path", state.alias("state")).orderBy("path")


def status(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Counts and bytes by state in one row; sums stop at the largest long."""
    states = verify(manifest, actual, include_optional=True, quick=True).join(manifest.select("path", "bytes", "required"), "path")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = lambda c: F.coalesce(F.least(F.sum(F.when(c, F.col("bytes").cast("decimal(38,0)"))), most), F.lit(0)).cast("long")
    return states.agg(
        F.count("*").alias("assets"), F.count_if("required").alias("required"), F.count_if(F.col("state") == "ok").alias("present"),
        F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "corrupt").alias("corrupt"),
        total(F.lit(True)).alias("bytes"), total(F.col("state") == "missing").alias("missing_bytes"),
    )


def paths(manifest: DataFrame, required_only: bool = False) -> DataFrame:
    rows = manifest.filter("required") if required_only else manifest
    return rows.filter(is_safe(F.col("path"))).select("path").orderBy("path")


def untracked(listing: DataFrame, declared: DataFrame) -> DataFrame:
    """Files that are no markdown or catalogue and that no record declares."""
    rows = listing.filter("not is_dir and path not like '%.md' and path not like '%.jsonl'").select("path")
    return rows.join(declared.select("path"), "path", "left_anti").orderBy("path")


def write_manifest(rows: DataFrame, root: str) -> bool:
    """Writes the manifest's lines in path order, if they differ; an empty manifest is no file."""
    own = os.path.join(root, "assets.jsonl")
    keys = [c.split()[0] for c in ASSETS.replace("array<string>", "array").split(", ")]
    lines = [json.dumps({k: r[k] for k in keys}, ensure_ascii=False, separators=(",", ":")) for r in rows.orderBy("path").toLocalIterator()]
    if not lines:
        existed = os.path.exists(own)
        if existed:
            os.remove(own)
        return existed
    return write_if_changed(own, "\n".join(lines) + "\n")


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ASSETS)
