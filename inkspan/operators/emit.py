"""Whole-store projections: the wide dump, the tree, one file's outline."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import frontmatter as fm
from ..sources.config import Config

_EMIT = (
    "frontmatter string, type string, meta_type string, id string, title string, summary string, links array<string>, "
    "link_spans array<struct<target:string,raw:string,alias:string,start:int,end:int>>, created string, updated string"
)


def _emitted(paths: pd.Series, texts: pd.Series) -> pd.DataFrame:
    out = []
    for path, text in zip(paths, texts):
        text = text or ""
        state, raw, body, _ = fm.split(text)
        front = (fm.load(raw) or {}) if state == fm.OK else {}
        found = fm.edges(text)
        meta = fm.scalar(front.get("meta-type"))
        out.append({
            "frontmatter": json.dumps({k: v for k, v in front.items() if isinstance(k, str)}, ensure_ascii=False, sort_keys=True, default=str),
            "type": fm.scalar(front.get("type")), "meta_type": meta or ("fact" if path.startswith("records/") else None),
            "id": fm.scalar(front.get("id")) or path.split("/")[-1].removesuffix(".md"), "title": fm.first_h1(text), "summary": fm.scalar(front.get("summary")),
            "links": list(dict.fromkeys(e["target"] for e in found)),
            "link_spans": [{k: e[k] for k in ("target", "raw", "alias", "start", "end")} for e in found if e["region"] == "body"],
            "created": fm.scalar(front.get("created")), "updated": fm.scalar(front.get("updated")),
        })
    return pd.DataFrame(out, columns=[c.split()[0] for c in ("frontmatter type meta_type id title summary links link_spans created updated").split()])


def emit(files: DataFrame) -> DataFrame:
    """A row for each file with everything it says, in path order; malformed frontmatter counts as none.

    Files are put in order first: a sort runs twice what lies below it.
    """
    kind = "struct<" + _EMIT.replace(" string", ":string").replace(" array", ":array") + ">"
    rows = files.select("path", "layer", "text", "body", F.sha2("content", 256).alias("sha256")).orderBy(F.split("path", "/"))
    return rows.withColumn("e", F.pandas_udf(_emitted, kind)("path", "text")).select("path", "layer", "e.*", "body", "sha256")


def emit_tally(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.count_if(F.col("layer") == "sources").alias("sources"), F.count_if(F.col("layer") == "records").alias("records"))


def tree(records: DataFrame, layer: str | None = None, type: str | None = None) -> DataFrame:
    """``(layer, type_folder, paths)``: files of each type-folder in order; loose files are not in the tree."""
    rows = records.filter("type_folder is not null")
    if layer:
        rows = rows.filter(F.col("layer") == layer)
    if type:
        rows = rows.filter(F.col("type") == type)
    return rows.groupBy("layer", "type_folder").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("parts", "path"))), lambda x: x["path"]).alias("paths")
    ).orderBy("layer", F.split("type_folder", "/"))


def tree_rows(records: DataFrame, layer: str | None = None, type: str | None = None) -> DataFrame:
    """``(layer, type_folder, path)``: the tree as rows in its order, for folders too large for a cell."""
    rows = records.filter("type_folder is not null")
    if layer:
        rows = rows.filter(F.col("layer") == layer)
    if type:
        rows = rows.filter(F.col("type") == type)
    return rows.orderBy("layer", F.split("type_folder", "/"), "parts").select("layer", "type_folder", "path")


def outline(files: DataFrame) -> DataFrame:
    """``(path, level, heading, line)`` of every heading outside code fences."""
    kind = "array<struct<level:int,heading:string,line:int>>"

    @F.pandas_udf(kind)
    def found(bodies: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([[{"level": a, "heading": b, "line": c} for a, b, c in fm.headings(x or "", int(n))] for x, n in zip(bodies, first)])

    return files.select("path", F.explode(found("body", "body_line")).alias("h")).select("path", "h.*").orderBy(F.split("path", "/"), "line")


def formatted(files: DataFrame) -> DataFrame:
    """``(path, text)``: every file in canonical form; files without well-formed frontmatter as they are."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            state, raw, body, _ = fm.split(text or "")
            front = fm.load(raw) if state == fm.OK else None
            out.append(fm.render(front, body) if front else text)
        return pd.Series(out)

    return files.select("path", run("text").alias("text"))


def initialised(files: DataFrame, config: Config, now: datetime, types: dict[str, str] | None = None) -> DataFrame:
    """``(path, text)``: every file with what its frontmatter lacks filled in, as a single write would; malformed ones as they are."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, texts: pd.Series) -> pd.Series:
        from .write import completed

        out = []
        for path, text in zip(paths, texts):
            state, raw, body, _ = fm.split(text or "")
            front = fm.load(raw) if state == fm.OK else {} if state == fm.NONE else None
            out.append(text if front is None else fm.render(completed(path, front, body, config, now, types), body))
        return pd.Series(out)

    return files.select("path", run("path", "text").alias("text"))


def relinked(files: DataFrame, old: str, new: str) -> DataFrame:
    """``(path, text)`` of the files that change when links to ``old`` point to ``new``."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fm.rewrite_links(t or "", old, new))

    return files.select("path", "text", run("text").alias("now")).filter("text <> now").select("path", F.col("now").alias("text"))
