"""Scans of a store: folders and contents are listed, read and parsed in tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lazy import pandas
from ..errors import NOT_A_STORE, StoreError
from ..functions import path as P
from ..schema import ASSETS, CONFIG_FILE, CONFIG_TYPE, LAYERS, LOG, RECORDS
from . import config as C
from . import frontmatter as fm

CONTENT_MOST, LOG_MOST = 64 << 20, 256 << 20


def walk(root: str, top: str = "", config_name: str = CONFIG_FILE, hidden: bool = False, deep: bool = True) -> Iterator[tuple[str, bool, int]]:
    """(path, is a folder, size) of all below ``top``, or of its own entries only; nested stores and links out of
    the store are not entered.

    Names with a leading underscore are kept: Spark's own file sources would drop them.
    """
    stack = [top]
    while stack:
        here = stack.pop()
        with os.scandir(os.path.join(root, here)) as found:
            for e in sorted(found, key=lambda e: e.name):
                own = f"{here}/{e.name}" if here else e.name
                if e.name.startswith(".") and not hidden:
                    continue
                if e.is_symlink() and not os.path.realpath(e.path).startswith(root + os.sep):
                    continue
                if e.is_dir():
                    yield own, True, 0
                    if deep and not os.path.exists(os.path.join(e.path, config_name)):
                        stack.append(own)
                elif e.is_file():
                    yield own, False, e.stat().st_size


@dataclass
class Store:
    """An opened store: its root, its configuration and the name of the file that holds it."""

    root: str
    config: C.Config
    config_name: str = CONFIG_FILE

    @classmethod
    def open(cls, root: str, config_name: str = CONFIG_FILE, config_type: str = CONFIG_TYPE) -> Store:
        names = os.listdir(root) if os.path.isdir(root) else []
        if config_name not in names:  # the exact case, also where file names have none
            raise StoreError("NOT_A_STORE", f"{root} has no {config_name}", NOT_A_STORE)
        with open(os.path.join(root, config_name), encoding="utf-8", errors="replace") as f:
            return cls(os.path.abspath(root), C.parse(f.read(), config_type), config_name)

    def has(self, path: str, folder: bool = False) -> bool:
        """Whether a file (or folder) is there in exactly this spelling, also where file names have no case."""
        here = self.root
        for part in path.split("/"):
            if not os.path.isdir(here) or part not in os.listdir(here):
                return False
            here = os.path.join(here, part)
        return os.path.isdir(here) if folder else os.path.isfile(here)

    def paths(self, top: str = "", hidden: bool = False) -> Iterator[tuple[str, bool, int]]:
        """:func:`walk` from the driver, for single records and small stores."""
        return walk(self.root, top, self.config_name, hidden)

    def nested(self) -> list[str]:
        """Stores inside this store."""
        return sorted(p for p, is_dir, _ in self.paths() if is_dir and os.path.exists(os.path.join(self.root, p, self.config_name)))


_LISTED = "path string, is_dir boolean, size long"
#: Folders to have before the rest is listed in tasks, and levels that the driver lists itself at most.
SPREAD, LEVELS = 256, 4


def listing(spark: SparkSession, store: Store, tops: list[str] | None = None) -> DataFrame:
    """``paths(path, is_dir, size)``: what existence checks join against, instead of a probe a row.

    The driver lists the uppermost levels only; what is below is listed in
    tasks, one folder a row, so neither names nor sizes of all files pass
    through the driver.
    """
    root, name = store.root, store.config_name
    known: list[tuple[str, bool, int]] = []
    open_folders = [t for t in (tops or [""]) if os.path.isdir(os.path.join(root, t))]
    for _ in range(LEVELS):
        if not open_folders or len(open_folders) >= SPREAD:
            break
        found = [x for top in open_folders for x in walk(root, top, name, deep=False)]
        known += found
        open_folders = [p for p, is_dir, _ in found if is_dir and not os.path.exists(os.path.join(root, p, name))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top in batch["path"]:
                own = walk(root, top, name)
                while rows := list(islice(own, 10_000)):
                    yield pd.DataFrame(rows, columns=["path", "is_dir", "size"])

    out = spark.createDataFrame(known, _LISTED)
    if not open_folders:
        return out
    folders = spark.createDataFrame([(p,) for p in open_folders], "path string").repartition(min(len(open_folders), SPREAD))
    return out.unionByName(folders.mapInPandas(run, _LISTED))


def _read(root: str, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, size in zip(batch["path"], batch["size"]):
                if size > most:
                    raise StoreError("IO_ERROR", f"{p} is larger than {most} bytes")
                with open(os.path.join(root, p), "rb") as f:
                    yield pd.DataFrame({"path": [p], "size": [size], "content": [f.read()]})

    return run


def _contents(spark: SparkSession, store: Store, rows: DataFrame, most: int) -> DataFrame:
    """``(path, size, content)`` of listed files, read in as many tasks as a shuffle has."""
    return rows.select("path", "size").repartition("path").mapInPandas(_read(store.root, most), "path string, size long, content binary")


def files(spark: SparkSession, store: Store, layer: str | None = None, folder: str | None = None, content_only: bool = True) -> DataFrame:
    """The markdown files of the store, one layer or one type-folder, with contents and split frontmatter.

    Files are listed and read in tasks, in ``spark.sql.shuffle.partitions`` of
    them.  The store's folder must be one that all executors see.  A file of
    more than CONTENT_MOST bytes is an error.
    """
    if layer is not None and layer not in LAYERS:
        raise StoreError("BAD_LAYER", f"{layer!r} is neither sources nor records", 2)
    rows = listing(spark, store, [folder] if folder else [layer] if layer else list(LAYERS) if content_only else [""])
    path = F.col("path")
    rows = rows.filter(~F.col("is_dir") & path.endswith(".md") & ~path.startswith("log/"))
    if content_only:
        rows = rows.filter(P.is_content(path) & (F.element_at(P.parts(path), -1) != store.config_name))
    return described(_contents(spark, store, rows, CONTENT_MOST))


@pandas("struct<fm_state:string,fm_yaml:string,body:string,body_line:int>")
def _split(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fm.split(t or "") for t in text], columns=["fm_state", "fm_yaml", "body", "body_line"])


def described(rows: DataFrame) -> DataFrame:
    """``(path, size, content)`` as the relation of files."""
    path, text = F.col("path"), F.make_valid_utf8(F.col("content").cast("string"))
    rows = rows.withColumns({
        "parts": P.parts(path), "layer": P.layer(path), "type_folder": P.type_folder(path), "is_loose": F.size(P.parts(path)) == 2,
        "text": text, "utf8_ok": F.is_valid_utf8(F.col("content").cast("string")),
    })
    rows = rows.withColumn("split", _split("text"))
    return rows.select("path", "parts", "layer", "type_folder", "is_loose", "size", "content", "text", "utf8_ok", "split.*")


_FIELDS = RECORDS.split("type_folder string, ", 1)[1]


def _projected(strict: bool):
    names = ["type", "summary", "tags", "links", "created_raw", "created", "updated_raw", "updated", "fields_json", "tokens"]

    def run(paths: pd.Series, states: pd.Series, yamls: pd.Series) -> pd.DataFrame:
        out = []
        for path, state, raw in zip(paths, states, yamls):
            front = fm.load(raw) if state == fm.OK else {}
            if front is None:
                if strict:
                    raise StoreError("FM_MALFORMED_YAML", f"{path}: the frontmatter is no YAML mapping")
                front = {}
            out.append(fm.record(path, front))
        return pd.DataFrame(out, columns=names)

    return run


def records(rows: DataFrame, strict: bool = True) -> DataFrame:
    """The catalogue relation.  ``strict`` fails on malformed frontmatter (catalogue), else it is empty (dump, statistics)."""
    kind = "struct<" + ", ".join(f"{a}:{b}" for a, b in (x.strip().split(" ", 1) for x in _cut(_FIELDS))) + ">"
    project = F.pandas_udf(_projected(strict), kind)
    return rows.withColumn("r", project("path", "fm_state", "fm_yaml")).select("path", "parts", "layer", "type_folder", "r.*")


def _cut(schema: str) -> list[str]:
    """Fields of a schema text, commas inside angle brackets left alone."""
    out, depth, own = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(own)
            own = ""
        else:
            own += c
    return [*out, own]


_EDGE = "array<struct<target:string,dst_key:string,region:string,line:int,start:int,end:int,raw:string,alias:string,key:string>>"


@pandas(_EDGE)
def _edges(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fm.edges(t or ""))


def edges(rows: DataFrame) -> DataFrame:
    """Every link of every file: one row an occurrence."""
    return rows.select(F.col("path").alias("src"), F.explode(_edges("text")).alias("e")).select("src", "e.*")


_WIKI = "array<struct<target:string,display:string,line:int,column:int,is_full_path:boolean,has_extension:boolean>>"


@pandas(_WIKI)
def _wiki(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fm.wiki_links(t or ""))


def wiki_links(rows: DataFrame, path: str = "path", text: str = "body") -> DataFrame:
    """``(path, target, display, line, column, is_full_path, has_extension)``: every link of a text, as written."""
    return rows.select(F.col(path).alias("path"), F.explode(_wiki(F.col(text))).alias("w")).select("path", "w.*")


_FIELD_LINK = "array<struct<key:string,target:string,display:string>>"


@pandas(_FIELD_LINK)
def _field_links(states: pd.Series, yamls: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("key", "target", "display"), x)) for x in fm.link_fields(y)] if s == fm.OK else [] for s, y in zip(states, yamls)])


def link_fields(rows: DataFrame) -> DataFrame:
    """``(path, key, target, display)``: every frontmatter field that is a link or a list of links."""
    return rows.select("path", F.explode(_field_links("fm_state", "fm_yaml")).alias("f")).select("path", "f.*")


_HEADLINE = "struct<title:string,paragraph:string,summary:string>"


def headlines(rows: DataFrame, template: str | None = None) -> DataFrame:
    """``(path, title, paragraph, summary)``: the first heading of the first level, the first paragraph, and the
    summary that a file without one would get."""

    @F.pandas_udf(_HEADLINE)
    def run(texts: pd.Series, bodies: pd.Series, states: pd.Series, yamls: pd.Series) -> pd.DataFrame:
        out = []
        for text, body, state, raw in zip(texts, bodies, states, yamls):
            front = (fm.load(raw) or {}) if state == fm.OK else {}
            out.append((fm.first_h1(text or ""), fm.first_paragraph(body or ""), fm.default_summary(template, front, body or "")))
        return pd.DataFrame(out, columns=["title", "paragraph", "summary"])

    return rows.select("path", run("text", "body", "fm_state", "fm_yaml").alias("h")).select("path", "h.*")


_SECTION = "array<struct<heading:string,level:int,line:int,body:string>>"


@pandas(_SECTION)
def _sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fm.sections(t or ""))


def sections(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.explode(_sections("text")).alias("s")).select("path", "s.*")


def _line_rows(root: str):
    """Files to their lines that are not blank, in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with open(os.path.join(root, name), encoding="utf-8") as f:
                    lines = ((name, n, line.rstrip("\r\n")) for n, line in enumerate(f, 1) if line.strip())
                    while rows := list(islice(lines, 10_000)):
                        yield pd.DataFrame(rows, columns=["file", "n", "raw"])

    return run


def _jsonl(spark: SparkSession, store: Store, names: DataFrame, schema: str, corrupt: str) -> DataFrame:
    """JSON lines of the files ``names(path)``, the last line of each path in each file; a bad line is an error.

    Lines are read where they are parsed; the last one of a path is found by
    an aggregation, which combines map-side.
    """
    rows = names.select("path").repartition("path").mapInPandas(_line_rows(store.root), "file string, n long, raw string")
    rows = rows.withColumn("j", F.from_json("raw", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.concat_ws("", F.lit(f"{corrupt}: "), "file", F.lit(", line "), F.col("n").cast("string"), F.lit(" is no JSON object with a path"))
    wrong = F.col("j").isNull() | F.col("j._bad").isNotNull() | F.col("j.path").isNull()
    if found := rows.filter(wrong).select(bad.alias("text")).first():
        raise StoreError(corrupt, found.text.removeprefix(f"{corrupt}: "))
    last = rows.groupBy("file", F.col("j.path").alias("path")).agg(F.max_by(F.struct("j", "raw"), "n").alias("r"))
    return last.select("r.j.*", "file", "r.raw").drop("_bad")


def sidecar(spark: SparkSession, store: Store, layer: str | None = None) -> DataFrame:
    """The rows of every ``index.jsonl`` (of one layer), last write first kept, blank lines passed over."""
    names = listing(spark, store, [layer] if layer else list(LAYERS)).filter(~F.col("is_dir") & F.col("path").endswith("/index.jsonl"))
    return _jsonl(spark, store, names, "path string, type string, summary string, tags array<string>, links array<string>, created string, updated string", "INDEX_JSONL_DESYNC")


def manifest(spark: SparkSession, store: Store) -> DataFrame:
    """The asset manifest in path order (plain text order), last line of a path kept."""
    names = ["assets.jsonl"] if os.path.exists(os.path.join(store.root, "assets.jsonl")) else []
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    return _jsonl(spark, store, rows, ASSETS, "ASSET_MANIFEST_MALFORMED").drop("file", "raw").orderBy("path")


def _log_rows(root: str):
    from .timeline import parse_log

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, place, size in zip(batch["path"], batch["place"], batch["size"]):
                if size > LOG_MOST:
                    raise StoreError("IO_ERROR", f"{name} is larger than {LOG_MOST} bytes")
                with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
                    rows = [(t, t.strftime("%Y-%m") if t else None, k, o, note, name, (int(place) << 32) + i) for i, (t, k, o, note, _) in enumerate(parse_log(f.read()))]
                out = pd.DataFrame(rows, columns=["ts", "ym", "kind", "object", "note", "file", "ordinal"])
                yield out.assign(ts=pd.to_datetime(out["ts"], utc=True))

    return run


def log(spark: SparkSession, store: Store) -> DataFrame:
    """The timeline: archives by month, then the active file; ``ordinal`` is physical order (the file's place in
    the upper half, the entry's in the lower).  Files are parsed in tasks; one that is too long is an error."""
    top = os.path.join(store.root, "log")
    names = sorted(f"log/{n}" for n in os.listdir(top) if n.endswith(".md")) if os.path.isdir(top) else []
    names += ["log.md"] if os.path.exists(os.path.join(store.root, "log.md")) else []
    sized = [(n, k, os.path.getsize(os.path.join(store.root, n))) for k, n in enumerate(names)]  # a file a month
    rows = spark.createDataFrame(sized, "path string, place int, size long").repartition(max(1, len(names)))
    return rows.mapInPandas(_log_rows(store.root), LOG)
