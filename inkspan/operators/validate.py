"""Data-quality rules: each is a DataFrame of issues, united and ordered at the end."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lazy import pandas
from ..functions import text as T
from ..functions.link import canonical_target
from ..functions.path import bare, is_content, matches_globs
from ..functions.shape import SHAPES
from ..functions.time import rfc3339
from ..schema import ISSUES, LAYERS, META_TYPES
from ..shared import written
from ..sources import frontmatter as fm
from ..sources.config import Config, Schema
from ..sources.store import Store
from .catalog import BROWSED
from .timeline import out_of_order, unknown_kinds

ERROR, WARNING, INFO = "error", "warning", "info"


def _said(severity: str, code: str, file: Column, message: Column | str, line: Column | None = None, key: Column | str | None = None,
          related: Column | None = None, suggestion: Column | str | None = None) -> list[Column]:
    text = lambda c: F.lit(c) if c is None or isinstance(c, str) else c
    return [
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), file.cast("string").alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"),
        text(key).cast("string").alias("key"), text(message).cast("string").alias("message"), text(suggestion).cast("string").alias("suggestion"),
        (F.array() if related is None else related).cast("array<string>").alias("related"),
    ]


def issue(rows: DataFrame, severity: str, code: str, file: Column, message: Column | str, line: Column | None = None, key: Column | str | None = None,
          related: Column | None = None, suggestion: Column | str | None = None) -> DataFrame:
    return rows.select(*_said(severity, code, file, message, line, key, related, suggestion))


def rule(cond: Column, severity: str, code: str, message: Column | str, key: str | None = None, line: Column | None = None) -> Column:
    """An issue of a row's file where ``cond`` holds, else null."""
    return F.when(cond, F.struct(*_said(severity, code, F.col("path"), message, line, key)))


def flagged(rows: DataFrame, rules: list[Column], more: Column | None = None) -> DataFrame:
    """The issues of many rules over one relation, and those of the array ``more``, found in one pass."""
    if not rules:
        return rows.sparkSession.createDataFrame([], ISSUES)
    found = F.array_compact(F.array(*rules))
    if more is not None:
        found = F.concat(found, F.coalesce(more, F.slice(found, 1, 0)))
    return rows.select(F.explode(found).alias("i")).select("i.*")


def either(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def united(parts: list[DataFrame]) -> DataFrame:
    """All issues by file path, line (none first), code and key."""
    return ordered(either(parts))


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy(F.split("file", "/"), F.asc_nulls_first("line"), "code", F.asc_nulls_first("key"))


def tally(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


# One row per file, with what its frontmatter says of each field.
_FACTS = (
    "struct<malformed:boolean,fields:map<string,struct<kind:string,text:string,items:array<string>,flat:boolean>>,keys:array<string>,flow:array<string>>"
)


def _fact(value) -> dict:
    kind = ("null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float)
            else "string" if isinstance(value, str) else "list" if isinstance(value, list) else "map")
    flat = isinstance(value, list) and all(fm.scalar(v) is not None for v in value)
    return {"kind": kind, "text": fm.scalar(value), "items": fm.listed(value) if value is not None else [], "flat": flat}


@pandas(_FACTS)
def _facts(states: pd.Series, yamls: pd.Series) -> pd.DataFrame:
    out = []
    for state, raw in zip(states, yamls):
        front = fm.load(raw) if state == fm.OK else {}
        fields = front or {}
        flow = re.findall(r"^([\w-]+):\s*\[\s*\[\[", raw or "", re.M)
        out.append({"malformed": front is None or state == fm.OPEN, "fields": {str(k): _fact(v) for k, v in fields.items()}, "keys": [str(k) for k in fields], "flow": flow})
    return pd.DataFrame(out)


def facts(files: DataFrame) -> DataFrame:
    """Files with ``fields``: per key its kind, text, items."""
    return files.withColumn("f", _facts("fm_state", "fm_yaml")).select(*files.columns, "f.*")


def value(key: str) -> Column:
    return F.try_element_at("fields", F.lit(key))


def text(key: str) -> Column:
    return value(key)["text"]


def file_rules(rows: DataFrame, config: Config) -> list[DataFrame]:
    """Rules over one file's frontmatter, in one pass; malformed files get no field rules."""
    readable = F.col("utf8_ok")
    good = readable & ~F.col("malformed")
    out = [
        rule(~readable, ERROR, "FM_UNREADABLE", "the file is no UTF-8"),
        rule(readable & F.col("malformed"), ERROR, "FM_MALFORMED_YAML", "the frontmatter is no YAML mapping", line=F.lit(1)),
    ]

    def check(cond: Column, severity: str, code: str, message: Column | str, key: str | None = None) -> None:
        out.append(rule(good & cond, severity, code, message, key))

    blank = lambda k: F.coalesce(F.trim(text(k)) == "", F.lit(True))
    check(blank("type"), ERROR, "FM_MISSING_TYPE", "no type", "type")
    for k in ("created", "updated"):
        missing = value(k).isNull() | (value(k)["kind"] == "null")
        check(missing, ERROR, f"FM_MISSING_{k.upper()}", f"no {k}", k)
        check(~missing & ((value(k)["kind"] != "string") | rfc3339(text(k)).isNull()), ERROR, "FM_BAD_TIMESTAMP", f"{k} is no RFC 3339 time", k)
    meta = value("meta-type")
    check(meta.isNotNull() & (meta["text"].isNull() | ~meta["text"].isin(*META_TYPES)), ERROR, "FM_BAD_META_TYPE", "meta-type is none of fact, operational, conclusion", "meta-type")
    ident = value("id")
    check(ident.isNotNull() & (ident["text"].isNull() | (ident["text"] == "") | ident["text"].rlike(r"\s")), WARNING, "FM_BAD_ID", "id is no token", "id")
    check(F.col("body").rlike(r"^\s*---[ \t]*\r?\n(?:[\w-]+:.*\r?\n)+---"), WARNING, "FM_IN_BODY", "the body begins with a second frontmatter block")
    summary = text("summary")
    missing = value("summary").isNull() | (value("summary")["kind"] == "null")
    check(missing, ERROR, "SUMMARY_MISSING", "no summary", "summary")
    check(~missing & (F.trim(F.coalesce(summary, F.lit(""))) == ""), ERROR, "SUMMARY_EMPTY", "the summary is empty", "summary")
    check(F.contains(F.rtrim(summary), F.lit("\n")) & (F.trim(summary) != ""), ERROR, "SUMMARY_MULTILINE", "the summary has several lines", "summary")
    check(~F.contains(summary, F.lit("\n")) & (F.char_length(summary) > T.SUMMARY_MOST), WARNING, "SUMMARY_TOO_LONG", f"the summary has more than {T.SUMMARY_MOST} characters", "summary")
    tags = value("tags")
    check(tags.isNotNull() & (tags["kind"] != "null") & ~F.coalesce(tags["flat"], F.lit(False)), WARNING, "TAGS_MALFORMED", "tags is no flat list", "tags")
    if config.ignored:
        check(text("type").isin(*config.ignored), INFO, "POLICY_IGNORED_TYPE_PRESENT", "the type is ignored by policy", "type")
    for kind, schema in config.schemas.items():
        out += [F.when(good & (text("type") == kind), c) for c in schema_columns(schema)]
    flow = lambda k: F.struct(*_said(ERROR, "WIKI_LINK_FLOW_FORM_LIST", F.col("path"), "a list of links in flow form reads as nested lists", key=k))
    return [flagged(rows, out, F.when(good, F.transform("flow", flow)))]


def schema_columns(schema: Schema) -> list[Column]:
    """A type's required fields, shapes, link prefixes and enumerations, as :func:`rule` columns."""
    out = []
    for spec in schema.fields:
        v = value(spec.name)
        empty = v.isNull() | (v["kind"] == "null") | F.when(v["kind"] == "list", F.size(v["items"]) == 0).otherwise(F.coalesce(F.trim(v["text"]) == "", v["kind"] != "map"))
        there = ~F.coalesce(empty, F.lit(True))
        if spec.required:
            out.append(rule(empty, ERROR, "SCHEMA_MISSING_REQUIRED", f"{spec.name} is required", spec.name))
        if spec.shape:
            ok = F.coalesce(F.forall(v["items"], SHAPES[spec.shape]) & (v["kind"] != "map"), F.lit(False))
            out.append(rule(there & ~ok, ERROR, "SCHEMA_SHAPE_MISMATCH", f"{spec.name} is no {spec.shape}", spec.name))
        if spec.enum:
            out.append(rule(there & ~F.forall(v["items"], lambda x: x.isin(*spec.enum)), ERROR, "SCHEMA_ENUM_VIOLATION", f"{spec.name} is none of {', '.join(spec.enum)}", spec.name))
        if spec.link_prefix:
            link = lambda x: F.regexp_extract(x, r"^\s*\[\[([^\]|]*)", 1)
            ok = F.forall(v["items"], lambda x: canonical_target(link(x)).startswith(spec.link_prefix))
            out.append(rule(there & ~F.coalesce(ok, F.lit(False)), ERROR, "SCHEMA_LINK_PREFIX_MISMATCH", f"{spec.name} is no link to {spec.link_prefix}", spec.name))
    return out


def schema_rules(rows: DataFrame, schema: Schema) -> list[DataFrame]:
    """A type's rules over its own rows, in one pass."""
    return [flagged(rows, schema_columns(schema))]


def link_rules(edges: DataFrame, paths: DataFrame, everything: bool = True) -> list[DataFrame]:
    """Links: short form (ambiguous, where several files have the name), extension, missing target."""
    target = canonical_target(F.col("target"))
    rows = edges.withColumn("t", target)
    file, line = F.col("src"), F.col("line")
    short = rows.filter(~F.contains("t", F.lit("/")))
    out = []
    if everything:
        stems = paths.filter(is_content(F.col("path"))).groupBy(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("t")).agg(
            F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("all")).filter("n > 1")
        out.append(issue(short.join(stems, "t"), ERROR, "WIKI_LINK_AMBIGUOUS", file, F.concat(F.lit("several files are named "), F.col("t")), line, F.col("target"), F.col("all")))
        short = short.join(stems, "t", "left_anti")
    out.append(issue(short, ERROR, "WIKI_LINK_SHORT_FORM", file, "a link needs its folder", line, F.col("target")))
    full = rows.filter(F.contains("t", F.lit("/")))
    out.append(issue(full.filter(F.col("target").endswith(".md")), WARNING, "WIKI_LINK_HAS_EXTENSION", file, "a link has no extension", line, F.col("target")))
    there = paths.select(F.explode(F.array("path", bare(F.col("path")))).alias("dst_key")).distinct()
    out.append(issue(full.join(there, "dst_key", "left_anti"), ERROR, "WIKI_LINK_BROKEN", file, F.concat(F.lit("no file "), F.col("t")), line, F.col("target")))
    return out


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """One issue a group of equal explicit ids, at its smallest path."""
    groups = rows.filter(text("id").isNotNull() & (text("id") != "")).groupBy(text("id").alias("id")).agg(F.array_sort(F.collect_list("path")).alias("all"), F.count("*").alias("n"))
    return issue(groups.filter("n > 1"), ERROR, "DUP_ID", F.element_at("all", 1), F.concat(F.lit("several files have the id "), F.col("id")), key="id", related=F.slice("all", F.lit(2), F.size("all")))


def duplicate_keys(rows: DataFrame, config: Config) -> list[DataFrame]:
    """Issues of each unique constraint; a record without a key field never collides."""
    out = []
    for kind, schema in config.schemas.items():
        for key in schema.unique:
            def token(k: str) -> Column:
                items = F.transform(value(k)["items"], lambda x: F.when(x.rlike(r"^\s*\[\["), canonical_target(F.regexp_extract(x, r"^\s*\[\[([^\]|]*)", 1))).otherwise(F.trim(x)))
                return F.when(F.size(items) > 0, T.sorted_set_token(items))

            parts = [token(k) for k in key]
            own = rows.filter(text("type") == kind).select("path", F.array(*parts).alias("key"))
            own = own.filter(F.forall("key", lambda x: x.isNotNull() & (x != "")))
            groups = own.groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("all"), F.count("*").alias("n")).filter("n > 1")
            out.append(issue(groups, WARNING, "DUP_UNIQUE_KEY", F.element_at("all", 1), f"several files of type {kind} share {', '.join(key)}", key=",".join(key), related=F.slice("all", F.lit(2), F.size("all"))))
    return out


def derived_rules(rows: DataFrame, records: DataFrame, config: Config) -> list[DataFrame]:
    """Conclusions that are derived from records of ignored types."""
    if not config.ignored:
        return []
    links = rows.select("path", F.explode(value("derived_from")["items"]).alias("x")).select("path", canonical_target(F.regexp_extract("x", r"\[\[([^\]|]*)", 1)).alias("t"))
    bad = records.filter(F.col("type").isin(*config.ignored)).select(bare(F.col("path")).alias("t"))
    return [issue(links.join(bad, "t", "left_semi"), WARNING, "POLICY_IGNORED_TYPE_DERIVED", F.col("path"), F.concat(F.lit("derived from ignored "), F.col("t")), key="derived_from")]


def log_rules(log: DataFrame) -> list[DataFrame]:
    file = F.col("file")
    return [
        issue(log.filter("ts is null"), ERROR, "LOG_BAD_TIMESTAMP", file, F.concat(F.lit("no such time in entry "), F.col("ordinal").cast("string"))),
        issue(unknown_kinds(log), WARNING, "LOG_UNKNOWN_KIND", file, F.concat(F.lit("unknown kind "), F.col("kind"))),
        issue(out_of_order(log), WARNING, "LOG_OUT_OF_ORDER", file, F.concat(F.lit("entry "), F.col("ordinal").cast("string"), F.lit(" is older than the one before it"))),
    ]


def index_rules(records: DataFrame, pages: DataFrame, sidecar: DataFrame, most: int | None = BROWSED) -> list[DataFrame]:
    """Browse pages and catalogue lines against the records.

    The page of a folder of more than ``most`` files need not list them all; with None every page must.

    ``pages`` is ``(folder, path, scope, says, line, entry, summary)``: a row for each entry of each
    type-folder page, one with a null entry for a page without any.  A folder
    without a page gets one issue and no entry checks.
    """
    folders = records.filter("type_folder is not null").groupBy("type_folder").agg(F.count("*").alias("n"))
    have = pages.groupBy(F.col("folder").alias("type_folder")).agg(F.max("path").alias("page"), F.max("says").alias("says"), F.max("scope").alias("scope"))
    out = [issue(folders.join(have, "type_folder", "left_anti"), ERROR, "INDEX_MISSING", F.concat(F.col("type_folder"), F.lit("/index.md")), "the folder has no index")]
    out.append(issue(have.join(folders, "type_folder", "left_anti"), WARNING, "INDEX_ORPHAN", F.col("page"), "the index lists a folder without files"))
    out.append(issue(have.filter("says <> type_folder or scope <> 'type-folder'"), WARNING, "INDEX_WRONG_SCOPE", F.col("page"), "the index names another folder or scope"))
    entries = pages.filter("entry is not null").select(F.col("folder").alias("type_folder"), F.col("path").alias("page"), "line", F.col("entry").alias("node"), F.col("summary").alias("shown"))
    members = records.filter("type_folder is not null").select("type_folder", bare(F.col("path")).alias("node"), T.collapse_whitespace(F.col("summary")).alias("summary"))
    both = entries.join(members, ["type_folder", "node"], "full_outer").join(folders, "type_folder", "left").join(have.select("type_folder", F.col("page").alias("own")), "type_folder")
    out.append(issue(both.filter("summary is null"), ERROR, "INDEX_STALE_ENTRY", F.col("own"), F.concat(F.lit("no file "), F.col("node")), F.col("line"), F.col("node")))
    whole = F.lit(True) if most is None else F.col("n") <= most
    out.append(issue(both.filter(F.col("shown").isNull() & whole), ERROR, "INDEX_MISSING_ENTRY", F.col("own"), F.concat(F.lit("not listed: "), F.col("node")), key=F.col("node")))
    out.append(issue(both.filter("shown <> summary"), ERROR, "INDEX_SUMMARY_MISMATCH", F.col("own"), F.concat(F.lit("another summary than "), F.col("node"), F.lit("'s")), F.col("line"), F.col("node")))
    # The machine-readable twin: folders (or layers, for loose files) without one, rows gone, rows that differ.
    folder = F.coalesce("type_folder", "layer")
    lined = sidecar.select(F.regexp_replace("file", r"/index\.jsonl$", "").alias("folder"), "path", F.struct("type", "summary", "tags", "links", "created", "updated").alias("a"))
    fresh = records.select(folder.alias("folder"), "path", F.struct("type", "summary", "tags", "links", F.col("created_raw").alias("created"), F.col("updated_raw").alias("updated")).alias("b"))
    missing = fresh.select("folder").distinct().join(lined.select("folder").distinct(), "folder", "left_anti")
    twin = F.concat(F.col("folder"), F.lit("/index.jsonl"))
    out.append(issue(missing, ERROR, "INDEX_JSONL_MISSING", twin, "the folder has no catalogue file"))
    joined = lined.join(fresh, ["folder", "path"], "full_outer").join(lined.select("folder").distinct(), "folder", "left_semi")
    out.append(issue(joined.filter("a is null"), ERROR, "INDEX_JSONL_DESYNC", twin, F.concat(F.lit("not catalogued: "), F.col("path")), key=F.col("path")))
    out.append(issue(joined.filter("b is null"), ERROR, "INDEX_JSONL_DESYNC", twin, F.concat(F.lit("no file "), F.col("path")), key=F.col("path")))
    out.append(issue(joined.filter("a is not null and b is not null and not (a <=> b)"), ERROR, "INDEX_JSONL_STALE", twin, F.concat(F.lit("another row than "), F.col("path"), F.lit("'s")), key=F.col("path")))
    return out


def asset_rules(declared: DataFrame, manifest: DataFrame, paths: DataFrame) -> list[DataFrame]:
    """``declared`` is ``(wrapper, path, required)``, a row for each declaration of an asset."""
    out = []
    rest = declared.join(manifest.select("path"), "path", "left_anti")
    out.append(issue(rest, ERROR, "ASSET_UNDECLARED", F.col("wrapper"), F.concat(F.lit("not in the manifest: "), F.col("path")), key=F.col("path")))
    out.append(issue(declared.filter(is_content(F.col("path"))), WARNING, "ASSET_PATH_IS_CONTENT", F.col("wrapper"), "an asset is no content file", key=F.col("path")))
    wrappers = manifest.select("path", F.explode("wrappers").alias("wrapper"))
    gone = wrappers.join(paths.select(F.col("path").alias("wrapper")), "wrapper", "left_anti")
    out.append(issue(gone, ERROR, "ASSET_WRAPPER_BROKEN", F.lit("assets.jsonl"), F.concat(F.lit("no wrapper "), F.col("wrapper")), key=F.col("path")))
    orphan = manifest.join(declared.select("path"), "path", "left_anti")
    out.append(issue(orphan, WARNING, "ASSET_MANIFEST_ORPHAN", F.lit("assets.jsonl"), "no file declares the asset", key=F.col("path")))
    return out


def config_rules(spark: SparkSession, store: Store) -> DataFrame:
    rows = [(s, c, store.config_name, n, None, m, None, []) for s, c, n, m in store.config.problems]
    rows += [(ERROR, "NESTED_STORE", p, None, None, "a store inside the store", None, []) for p in store.nested()]
    return spark.createDataFrame(rows, ISSUES)


_PAGES = "folder string, path string, scope string, says string, line int, entry string, summary string"


def _page_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.strip().split(" ")[0] for x in _PAGES.split(",")]
    for batch in batches:
        for own, raw in zip(batch["path"], batch["content"]):
            _, head, body, line = fm.split(raw.decode("utf-8", "replace"))
            front = fm.load(head) or {}
            if fm.scalar(front.get("type")) != "index":
                continue
            base = (own.rsplit("/", 1)[0], own, fm.scalar(front.get("scope")), fm.scalar(front.get("folder")))
            found = [(n, m) for n, x in enumerate(body.splitlines(), line) if (m := re.match(r"^- \[\[([^\]|]+)(?:\|[^\]]*)?\]\](?: — (.*))?$", x))]
            rows = [(*base, n, m[1], re.sub(r"  ·  #.*$", "", m[2] or "")) for n, m in found] or [(*base, None, None, None)]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(line=out["line"].astype("Int32"))


def index_pages(spark: SparkSession, store: Store) -> DataFrame:
    """Entries of the type-folder pages on disk, read in tasks."""
    from ..sources import store as S

    rows = S.listing(spark, store, list(LAYERS)).filter(~F.col("is_dir") & F.col("path").rlike("^[^/]+/[^/]+/index\\.md$"))
    return S._contents(spark, store, rows, S.CONTENT_MOST).mapInPandas(_page_rows, _PAGES)


def frozen(path: Column, config: Config) -> Column:
    """Whether a write to ``path`` is refused by policy."""
    return matches_globs(path, config.frozen)


def scoped(issues: DataFrame) -> DataFrame:
    """Issues of a store that shows only part of another: what a broken link says of a file that may not be seen is left out."""
    hidden = F.col("code") == "WIKI_LINK_BROKEN"
    return issues.withColumns({
        "severity": F.when(hidden, F.lit(INFO)).otherwise(F.col("severity")), "code": F.when(hidden, F.lit("WIKI_LINK_SCOPED_UNRESOLVED")).otherwise(F.col("code")),
        "message": F.when(hidden, F.lit("the link leaves what this view of the store shows")).otherwise(F.col("message")),
        "suggestion": F.when(hidden, F.lit("ask for a wider view, or look from the whole store")).otherwise(F.col("suggestion")),
        "related": F.when(hidden, F.array().cast("array<string>")).otherwise(F.col("related")),
    })


def validate_all(spark: SparkSession, store: Store) -> DataFrame:
    """Every rule over the whole store.

    Files are read and parsed once and kept while rules share them; the issues
    are then written to the shared folder and the files let go.
    """
    from ..sources import store as S
    from .assets import declarations
    files = S.files(spark, store)
    rows = facts(files).persist()
    edges = S.edges(files.filter("utf8_ok")).persist()
    paths = S.listing(spark, store).persist()
    records = S.records(rows.filter("utf8_ok and not malformed").select(*files.columns)).persist()
    config = store.config
    parts = [config_rules(spark, store), *file_rules(rows, config), *link_rules(edges, paths.filter("not is_dir")), duplicate_ids(rows.filter("not malformed")),
             *duplicate_keys(rows.filter("not malformed"), config), *derived_rules(rows.filter("not malformed"), records, config), *log_rules(S.log(spark, store)),
             *index_rules(records, index_pages(spark, store), S.sidecar(spark, store))]
    try:
        manifest = S.manifest(spark, store)
        parts += asset_rules(declarations(rows.filter("not malformed")), manifest, paths)
    except Exception as e:
        if getattr(e, "code", "") != "ASSET_MANIFEST_MALFORMED":
            raise
        parts.append(spark.createDataFrame([(ERROR, e.code, "assets.jsonl", None, None, e.message, None, [])], ISSUES))
    found = ordered(written(either(parts)))
    for kept in (rows, edges, paths, records):
        kept.unpersist()
    return found


def validate_working_set(spark: SparkSession, store: Store, changed: DataFrame | None) -> DataFrame:
    """Rules over ``changed(path)`` files and what links to them; None or no rows means every content file."""
    from ..sources import store as S
    from .graph import linkers_of_any

    files = S.files(spark, store).persist()
    edges = S.edges(files.filter("utf8_ok")).persist()
    links, own = edges, files
    if changed is not None and not changed.isEmpty():
        nodes = changed.select(bare(F.col("path")).alias("node")).union(linkers_of_any(edges, changed)).distinct()
        own = files.join(nodes, bare(F.col("path")) == F.col("node"), "left_semi")
        links = edges.join(nodes, bare(F.col("src")) == F.col("node"), "left_semi")
    paths = S.listing(spark, store).filter("not is_dir")
    found = ordered(written(either([config_rules(spark, store).filter("code = 'NESTED_STORE'"), *file_rules(facts(own), store.config), *link_rules(links, paths, everything=False)])))
    files.unpersist()
    edges.unpersist()
    return found
