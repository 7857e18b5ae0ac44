"""The catalogue: roll-ups, newest-first browse views and their rendered text."""

from __future__ import annotations

import filecmp
import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StoreError, usage
from ..functions import text as T
from ..functions.path import bare
from ..schema import INDEX_TITLE, LAYERS
from ..sources.config import Config

BROWSED = 500


def recency() -> list[Column]:
    """Newest ``updated`` first, none last, then path order."""
    return [F.desc_nulls_last("updated"), F.col("parts")]


def browse(records: DataFrame, most: int | None = BROWSED) -> DataFrame:
    """The ``most`` newest records (None: all) of each type-folder with their ``place`` (from 1)."""
    w = Window.partitionBy("type_folder").orderBy(*recency())
    rows = records.filter("type_folder is not null").withColumn("place", F.row_number().over(w))
    return rows if most is None else rows.filter(F.col("place") <= most)


def counts(records: DataFrame) -> DataFrame:
    """``(layer, type_folder, n)``: every folder, every layer (null folder) and the store (both null)."""
    foldered = records.filter("type_folder is not null")
    return foldered.rollup("layer", "type_folder").agg(F.count("*").alias("n"))


def newest(records: DataFrame) -> DataFrame:
    """``(type_folder, path, updated_raw)``: each folder's newest record, by one aggregation without a sort."""
    order = F.struct(F.col("updated").isNull().alias("a"), (-F.unix_micros("updated")).alias("b"), F.col("parts").alias("c"))
    best = records.filter("type_folder is not null").groupBy("type_folder").agg(F.min_by(F.struct("path", "updated_raw", "updated"), order).alias("r"))
    return best.select("type_folder", "r.*")


def last_write_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key by ``order``: an aggregation, so it combines map-side and needs no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def entry_line() -> Column:
    """``- [[path]] — summary  ·  #tag #tag`` of a record."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("  ·  "), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " "))).otherwise("")
    return F.concat(F.lit("- [["), bare(F.col("path")), F.lit("]] — "), T.collapse_whitespace(F.col("summary")), tags)


def folder_index(records: DataFrame, most: int | None = BROWSED) -> DataFrame:
    """``(type_folder, text)``: the browse page of each type-folder, or with ``most`` None a page that lists all its records."""
    shown = browse(records, most).select("type_folder", "place", "layer", "type", "updated_raw", entry_line().alias("line"))
    pages = shown.groupBy("type_folder").agg(
        F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"),  # ``most`` at most, where it is given
        F.min_by(F.struct("updated_raw", "layer", "type"), "place").alias("top"),
    )
    total = records.filter("type_folder is not null").groupBy("type_folder").agg(F.count("*").alias("n"))
    stamp = F.when(F.col("top.updated_raw").isNotNull(), F.concat(F.lit("updated: "), F.col("top.updated_raw"), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("---\ntype: index\nscope: type-folder\nfolder: "), F.col("type_folder"), F.lit("\n"), stamp, F.lit("---\n\n# "), F.col("type_folder"), F.lit("\n\n"))
    body = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    more = F.lit("") if most is None else F.when(F.col("n") > most, F.format_string(
        f"\n## More\n\nThis folder has %d files. The {most} most recent are listed above.\nQuery type %s in %s for the complete catalog.\n",
        F.col("n"), F.col("top.type"), F.col("top.layer"))).otherwise("")
    return pages.join(total, "type_folder").select("type_folder", F.concat(head, body, more).alias("text"))


def rollup_entries(records: DataFrame, config: Config | None = None) -> DataFrame:
    """``(layer, type_folder, n, updated_raw, updated, line)``: what root and layer pages list."""
    labels = (config or Config()).folders
    rows = records.filter("type_folder is not null").groupBy("layer", "type_folder").agg(
        F.count("*").alias("n"), F.max_by("updated_raw", "updated").alias("updated_raw"), F.max("updated").alias("updated"))
    name, remark = T.display_name(F.col("type_folder")), F.lit("")
    for folder, (display, description) in labels.items():
        if display:
            name = F.when(F.col("type_folder") == folder, F.lit(display)).otherwise(name)
        if description:
            remark = F.when(F.col("type_folder") == folder, F.lit(" — " + description)).otherwise(remark)
    line = F.concat(F.lit("- [["), F.col("type_folder"), F.lit("/index|"), name, F.lit("]] ("), F.col("n").cast("string"), F.lit(")"), remark)
    return rows.withColumn("line", line)


def upper_indexes(records: DataFrame, config: Config | None = None, title: str = INDEX_TITLE) -> dict[str, str]:
    """Root and layer pages (paths to texts), from one row a folder."""
    entries = rollup_entries(records, config).orderBy(F.split("type_folder", "/")).collect()  # folders, not files
    out = {}

    def page(head: str, rows) -> str:
        stamped = [r for r in rows if r.updated]
        top = max(stamped, key=lambda r: r.updated, default=None)
        return f"---\ntype: index\n{head}" + (f"updated: {top.updated_raw}\n" if top else "") + "---\n\n"

    root = page("scope: root\n", entries) + f"# {title}\n"
    for layer in LAYERS:
        own = [r for r in entries if r.layer == layer]
        if own:
            lines = "".join(r.line + "\n" for r in own)
            out[f"{layer}/index.md"] = page(f"scope: layer\nfolder: {layer}\n", own) + f"# {layer}\n\n" + lines
            root += f"\n## {layer.capitalize()} ({sum(r.n for r in own)})\n" + lines
    if entries:
        out["index.md"] = root
    return out


def json_line(r) -> str:
    """A record's catalogue line: declared keys, then the others sorted."""
    head = {"path": r["path"], "type": r["type"], "summary": r["summary"], "tags": list(r["tags"]), "links": list(r["links"]), "created": r["created_raw"], "updated": r["updated_raw"]}
    head = {k: v for k, v in head.items() if v is not None}
    return json.dumps(head | json.loads(r["fields_json"]), ensure_ascii=False, separators=(",", ":"))


def json_lines(records: DataFrame) -> DataFrame:
    """``(folder, path, updated, parts, json)``: the complete catalogue lines of each type-folder, and of loose
    files by layer; :func:`recency` is their order in a folder's file."""
    @F.pandas_udf("string")
    def line(r: pd.DataFrame) -> pd.Series:
        return pd.Series([json_line(x) for x in r.to_dict("records")])

    folder = F.coalesce("type_folder", "layer")
    fields = F.struct("path", "type", "summary", "tags", "links", "created_raw", "updated_raw", "fields_json")
    return records.select(folder.alias("folder"), "path", "updated", "parts", line(fields).alias("json"))


def _write_lines(root: str):
    """Sorted lines to each folder's catalogue file, streamed; the names that were written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = out = None

        def close() -> str:
            out.close()
            _keep_if_equal(out.name, os.path.join(root, name))
            return name

        for batch in batches:
            for folder, own in batch.groupby("folder", sort=False):
                if f"{folder}/index.jsonl" != name:
                    if out:
                        yield pd.DataFrame({"name": [close()]})
                    name = f"{folder}/index.jsonl"
                    os.makedirs(os.path.join(root, folder), exist_ok=True)
                    out = open(os.path.join(root, f"{name}.{uuid.uuid4().hex}.tmp"), "w", encoding="utf-8", newline="")
                out.writelines(x + "\n" for x in own["json"])
        if out:
            yield pd.DataFrame({"name": [close()]})

    return run


def _write_pages(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                write_if_changed(os.path.join(root, name), text)
            yield batch[["name"]]

    return run


def rebuild(records: DataFrame, root: str, config: Config | None = None, dry_run: bool = False) -> dict[str, str | None]:
    """Writes every index page and catalogue file; deletes generated ones of folders that are no more.

    Type-folder pages and catalogue lines are written by the tasks that make
    them, a folder's lines as a stream; the store's folder must be one that all
    executors see.  The driver gets names (a row a folder) and writes the few
    pages above.  Returns those names, with texts for the pages above only;
    ``dry_run`` writes nothing and returns every text, which is for small stores.
    """
    pages = folder_index(records).select(F.concat("type_folder", F.lit("/index.md")).alias("name"), "text")
    lines = json_lines(records)
    if dry_run:
        out: dict[str, str | None] = {r.name: r.text for r in pages.toLocalIterator()} | upper_indexes(records, config)
        own: dict[str, list[str]] = {}
        for r in lines.orderBy("folder", *recency()).toLocalIterator():
            own.setdefault(f"{r.folder}/index.jsonl", []).append(r.json)
        return out | {name: "\n".join(x) + "\n" for name, x in own.items()}
    made = pages.mapInPandas(_write_pages(root), "name string").collect()
    made += lines.repartition("folder").sortWithinPartitions("folder", *recency()).select("folder", "json").mapInPandas(_write_lines(root), "name string").collect()
    out = {r.name: None for r in made} | upper_indexes(records, config)
    for layer in LAYERS:
        for here, _, names in os.walk(os.path.join(root, layer)):
            for n in names:
                own_name = os.path.relpath(os.path.join(here, n), root)
                if n in ("index.md", "index.jsonl") and own_name not in out and _generated(os.path.join(root, own_name)):
                    os.remove(os.path.join(root, own_name))
    for name, text in out.items():
        if text is not None:
            write_if_changed(os.path.join(root, name), text)
    return out


def rebuild_folder(records: DataFrame, root: str, folder: str) -> dict[str, str | None]:
    """:func:`rebuild` of one type-folder's page and catalogue file; pages above it stay as they are."""
    rows = records.filter(F.col("type_folder") == folder)
    made = folder_index(rows).select(F.concat("type_folder", F.lit("/index.md")).alias("name"), "text").mapInPandas(_write_pages(root), "name string").collect()
    made += json_lines(rows).repartition("folder").sortWithinPartitions("folder", *recency()).select("folder", "json").mapInPandas(_write_lines(root), "name string").collect()
    return {r.name: None for r in made}


def show(root: str, scope: str = "") -> str:
    """The page of a scope on disk: the store's (none), a layer's or a type-folder's."""
    parts = [p for p in scope.split("/") if p]
    if len(parts) > 2 or parts and parts[0] not in LAYERS or any(p.startswith(".") for p in parts):
        raise usage("BAD_SCOPE", f"{scope!r} is no layer and no type-folder")
    path = os.path.join(root, *parts, "index.md")
    if not os.path.isfile(path):
        raise StoreError("INDEX_MISSING", f"{scope or 'the store'} has no index")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _generated(path: str) -> bool:
    """Whether a page is ours: a user's own file named index.md is kept."""
    if path.endswith(".jsonl"):
        return True
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read(64).startswith("---\ntype: index\n")


def _keep_if_equal(new: str, path: str) -> bool:
    """Puts a written file in its place unless the same stands there; whether it did."""
    if os.path.exists(path) and filecmp.cmp(new, path, shallow=False):
        os.remove(new)
        return False
    os.replace(new, path)
    return True


def write_if_changed(path: str, text: str) -> bool:
    data = text.encode()
    if os.path.exists(path):
        with open(path, "rb") as f:
            if f.read() == data:
                return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, path)
    return True


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, state, changed)``: rows gone, added or changed between two projections, by one full join."""
    a, b = old.select(key, F.struct(*columns).alias("a")), new.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col("a")[c].eqNullSafe(F.col("b")[c]), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    state = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "stale").when(F.size(changed) > 0, "desync")
    return both.select(key, state.alias("state"), F.when(state == "desync", changed).otherwise(F.array().cast("array<string>")).alias("changed")).filter("state is not null")
