"""Scans, writers and rules on a store in a folder, which the nations and regions are written to, and the same in SQL."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets, catalog, graph, timeline, validate, write
from ..shared import shared_dir
from ..sources import store as S
from ..sources import tables as tb
from .files import ranked
from .queries import stated

CONFIG = """---
type: store
scope: atlas
owner: Ada
---

## Policies

### Frozen pages
- `records/regions/*`

### Ignored types
- `sketch`

## Schemas

### nation
- summary (required)
- region (link to records/regions/)
- code (int)
- motto (default none yet)
- unique: code

## Folders
- records/nations|Countries — where people live
"""
_DAY = "'2026-02-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') || 'T00:00:00Z'"


def _page(kind: str, summary: str, day: int, body: str = "", **fields) -> str:
    head = {"type": kind, "created": "2026-01-02T03:04:05Z", "updated": f"2026-02-{day:02d}T00:00:00Z", "summary": summary} | fields
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + "---\n" + body


def build(spark, sf) -> S.Store:
    """A fresh store: a file for each nation and region (thirty of them) and a note, a log without entries."""
    root = os.path.join(shared_dir(spark).removeprefix("file://"), f"store-{uuid.uuid4().hex}")
    files = {"STORE.md": CONFIG, "log.md": "---\ntype: log\n---\n\n# Log\n\n", "sources/notes/2026/01/tour.md": _page("note", "A tour", 1, "From [[records/nations/0]] to [[records/nations/1]].\n")}
    for r in tb.read(spark, sf, "region").collect():
        files[f"records/regions/{r.r_regionkey}.md"] = _page("region", r.r_name, 1)
    for n in tb.read(spark, sf, "nation").collect():
        files[f"records/nations/{n.n_nationkey}.md"] = _page("nation", n.n_name, n.n_nationkey + 1, f"# {n.n_name}\n", region=f'"[[records/regions/{n.n_regionkey}]]"', code=n.n_nationkey // 2)
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w", encoding="utf-8") as f:
            f.write(text)
    os.makedirs(os.path.join(root, ".hidden"))
    return S.Store.open(root)


_ALL = ("SELECT 'records/nations/' || n_nationkey || '.md' AS path FROM nation UNION ALL SELECT 'records/regions/' || r_regionkey || '.md' FROM region UNION ALL SELECT 'sources/notes/2026/01/tour.md'")


@stated(f"SELECT path, false AS is_dir FROM ({_ALL}) UNION ALL SELECT 'STORE.md', false UNION ALL SELECT 'log.md', false "
        "UNION ALL SELECT unnest(['records', 'records/nations', 'records/regions', 'sources', 'sources/notes', 'sources/notes/2026', 'sources/notes/2026/01']), true")
def store_listing(spark, sf):
    """Every file and folder; hidden ones are left out."""
    return S.listing(spark, build(spark, sf)).select("path", "is_dir")


@stated(f"SELECT path, split_part(path, '/', 1) AS layer, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS type_folder, 'all' AS scan FROM ({_ALL}) "
        f"UNION ALL SELECT path, 'records', 'records/' || split_part(path, '/', 2), 'layer' FROM ({_ALL}) WHERE path LIKE 'records/%' "
        f"UNION ALL SELECT path, 'records', 'records/regions', 'folder' FROM ({_ALL}) WHERE path LIKE 'records/regions/%'")
def store_scans(spark, sf):
    """The whole store, one layer and one type-folder."""
    store = build(spark, sf)
    parts = {"all": S.files(spark, store), "layer": S.files(spark, store, layer="records"), "folder": S.files(spark, store, folder="records/regions")}
    out = None
    for name, rows in parts.items():
        rows = rows.select("path", "layer", "type_folder", F.lit(name).alias("scan"))
        out = rows if out is None else out.unionByName(rows)
    return out


@stated("SELECT 'frozen' AS what, 'records/regions/*' AS name, NULL AS detail UNION ALL SELECT 'ignored', 'sketch', NULL UNION ALL SELECT 'folder', 'records/nations', 'Countries: where people live' "
        "UNION ALL SELECT 'field', unnest(['summary', 'region', 'code', 'motto']), unnest(['required', 'records/regions/', 'int', 'none yet']) UNION ALL SELECT 'unique', 'code', 'nation' "
        "UNION ALL SELECT 'problem', 'CONFIG_SCHEMA_FIELD', 'warning'")
def store_config(spark, sf):
    c = build(spark, sf).config
    rows = [("frozen", x, None) for x in c.frozen] + [("ignored", x, None) for x in c.ignored]
    rows += [("folder", k, f"{a}: {b}") for k, (a, b) in c.folders.items()]
    rows += [("field", f.name, "required" if f.required else f.link_prefix or f.shape or f.default) for f in c.schemas["nation"].fields]
    rows += [("unique", k, "nation") for key in c.schemas["nation"].unique for k in key] + [("problem", code, severity) for severity, code, *_ in c.problems]
    return spark.createDataFrame(rows, "what string, name string, detail string")


def _rebuilt(spark, sf) -> S.Store:
    store = build(spark, sf)
    catalog.rebuild(S.records(S.files(spark, store)), store.root, store.config)
    return store


@stated(f"SELECT 'records/nations/' || n_nationkey || '.md' AS path, 'nation' AS type, n_name AS summary, {_DAY} AS updated, 'records/nations/index.jsonl' AS file FROM nation "
        "UNION ALL SELECT 'records/regions/' || r_regionkey || '.md', 'region', r_name, '2026-02-01T00:00:00Z', 'records/regions/index.jsonl' FROM region "
        "UNION ALL SELECT 'sources/notes/2026/01/tour.md', 'note', 'A tour', '2026-02-01T00:00:00Z', 'sources/notes/index.jsonl'")
def store_sidecar(spark, sf):
    """The rebuilt catalogue files, read again."""
    return S.sidecar(spark, _rebuilt(spark, sf)).select("path", "type", "summary", "updated", "file")


@stated("SELECT 'records/nations/index.md' AS path, 'records/nations' AS says, 'type-folder' AS scope, (9 + row_number() OVER (ORDER BY n_nationkey DESC))::INT AS line, 'records/nations/' || n_nationkey AS entry, n_name AS summary FROM nation "
        "UNION ALL SELECT 'records/regions/index.md', 'records/regions', 'type-folder', (9 + row_number() OVER (ORDER BY r_regionkey))::INT, 'records/regions/' || r_regionkey, r_name FROM region "
        "UNION ALL SELECT 'sources/notes/index.md', 'sources/notes', 'type-folder', 10, 'sources/notes/2026/01/tour', 'A tour'")
def store_pages(spark, sf):
    """The rebuilt browse pages, read entry by entry: newest first, then in path order."""
    return validate.index_pages(spark, _rebuilt(spark, sf)).select("path", "says", "scope", "line", "entry", "summary")


@stated("SELECT 'records/nations/' || n_nationkey || '.md' AS path, unnest(['the rest', 'folder']) AS how FROM nation WHERE n_nationkey = 3")
def store_rebuild_keeps_it(spark, sf):
    """A catalogue that is rebuilt by writes, and one folder rebuilt alone, both equal a rebuild: what differs is listed, and
    the one file that is changed by hand."""
    store = _rebuilt(spark, sf)
    rows = S.records(S.files(spark, store))
    twin = f"{store.root}/records/nations/index.jsonl"
    want = open(twin, "rb").read()
    found = []
    for how, again in (("the rest", lambda: catalog.rebuild(rows, store.root, store.config)), ("folder", lambda: catalog.rebuild_folder(rows, store.root, "records/nations"))):
        with open(twin, "w") as f:
            f.write("stale\n")
        again()
        if open(twin, "rb").read() == want:
            found.append(("records/nations/3.md", how))
    return spark.createDataFrame(found, "path string, how string")


@stated("SELECT 'create' AS kind, 'records/nations/' || n_nationkey AS object, '2026-' || lpad((n_nationkey // 10 + 1)::VARCHAR, 2, '0') AS ym, '## [' || n_name AS note, "
        "CASE WHEN n_nationkey < 20 THEN 'log/2026-' || lpad((n_nationkey // 10 + 1)::VARCHAR, 2, '0') || '.md' ELSE 'log.md' END AS file, row_number() OVER (ORDER BY n_nationkey) AS rank FROM nation")
def store_log(spark, sf):
    """Entries appended over three months: earlier months move to their archives; notes that look like headers come back."""
    store = build(spark, sf)
    for n in tb.read(spark, sf, "nation").orderBy("n_nationkey").collect():
        timeline.append(store.root, "create", f"records/nations/{n.n_nationkey}", f"## [{n.n_name}", datetime(2026, n.n_nationkey // 10 + 1, 1 + n.n_nationkey % 10, 8, 0))
    log = ranked(S.log(spark, store).orderBy("ordinal"))
    return log.select("kind", "object", "ym", "note", "file", F.col("rank").cast("long").alias("rank"))


@stated("SELECT 'records/nations/' || n_nationkey AS path FROM nation WHERE n_nationkey < 2 UNION ALL SELECT 'sources/notes/2026/01/tour'")
def store_working_set(spark, sf):
    """What the log says has changed, and the files that link to it."""
    store = build(spark, sf)
    for k in (0, 1):
        timeline.append(store.root, "update", f"records/nations/{k}", "", datetime(2026, 3, 1, 8, 0))
    edges = S.edges(S.files(spark, store))
    return timeline.working_set(S.log(spark, store), edges, F.lit("2026-03-01 00:00:00").cast("timestamp"))


@stated("SELECT 'CONFIG_SCHEMA_FIELD' AS code, 1 AS n UNION ALL SELECT 'DUP_UNIQUE_KEY', count(*) FROM (SELECT n_nationkey // 2 FROM nation GROUP BY 1 HAVING count(*) > 1) "
        "UNION ALL SELECT 'LOG_UNKNOWN_KIND', 1 UNION ALL SELECT 'INDEX_JSONL_STALE', 1 UNION ALL SELECT 'INDEX_SUMMARY_MISMATCH', 1")
def store_validate(spark, sf):
    """Every rule over a store whose catalogue is out of date by one record."""
    store = _rebuilt(spark, sf)
    timeline.append(store.root, "dance", "records/nations/0", "", datetime(2026, 3, 1, 8, 0))
    path = f"{store.root}/records/nations/3.md"
    text = open(path, encoding="utf-8").read()
    with open(path, "w", encoding="utf-8") as f:
        f.write(text.replace("\nsummary: ", "\nsummary: Old "))
    return validate.validate_all(spark, store).groupBy("code").agg(F.count("*").alias("n"))


@stated("SELECT 'records/nations/' || CASE WHEN n_nationkey = 4 THEN 'four' ELSE n_nationkey::VARCHAR END || '.md' AS path, n_name AS summary, CASE WHEN n_nationkey = 5 THEN 'ahead' END AS motto, "
        "CASE WHEN n_nationkey = 6 THEN 1 ELSE 0 END::BIGINT AS n_links FROM nation UNION ALL SELECT 'records/nations/new.md', 'New land', 'none yet', 0")
def store_writes(spark, sf):
    """A record written with its defaults, a field set, a record moved with the links to it, a link appended; the catalogue
    that the writes keep is read."""
    store = _rebuilt(spark, sf)
    write.write(store, "nation", "new", {"summary": "New land"}, "Hills.\n", path="records/nations/new.md")
    write.set_field(store, "records/nations/5.md", "motto", "ahead")
    write.link(store, "records/nations/6.md", "records/nations/4")
    linkers = [f"{r.src}.md" for r in graph.backlinks(S.edges(S.files(spark, store)), "records/nations/4").collect()]
    write.rename(store, "records/nations/4.md", "records/nations/four.md", linkers)
    rows = S.sidecar(spark, store, "records").filter("type = 'nation'")
    edges = S.edges(S.files(spark, store)).filter("dst_key = 'records/nations/four'").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_links"))
    return rows.join(edges, "path", "left").select("path", "summary", F.get_json_object("raw", "$.motto").alias("motto"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@stated("SELECT 'assets/' || r_regionkey || '.pdf' AS path, sha256(r_name) AS sha256, octet_length(encode(r_name))::BIGINT AS bytes, 'records/regions/' || r_regionkey || '.md' AS wrappers, r_regionkey % 2 = 0 AS required, "
        "CASE WHEN r_regionkey = 1 THEN 'missing' WHEN r_regionkey = 2 THEN 'corrupt' ELSE 'ok' END AS state FROM region")
def store_manifest(spark, sf):
    """Declared files hashed, written as a manifest and read again, then verified after one is gone and one is changed."""
    store = build(spark, sf)
    os.makedirs(f"{store.root}/assets")
    for r in tb.read(spark, sf, "region").collect():
        with open(f"{store.root}/assets/{r.r_regionkey}.pdf", "w") as f:
            f.write(r.r_name)
        path = f"{store.root}/records/regions/{r.r_regionkey}.md"
        text = open(path, encoding="utf-8").read()
        with open(path, "w", encoding="utf-8") as f:
            f.write(text.replace("\nsummary: ", f"\nasset: {{path: assets/{r.r_regionkey}.pdf, required: {'true' if r.r_regionkey % 2 == 0 else 'false'}}}\nsummary: "))
    declared = assets.declarations(S.files(spark, store))
    assets.write_manifest(assets.scan(declared, S.manifest(spark, store), assets.hashed(declared.select("path").distinct(), store.root)), store.root)
    os.remove(f"{store.root}/assets/1.pdf")
    with open(f"{store.root}/assets/2.pdf", "w") as f:
        f.write("other")
    manifest = S.manifest(spark, store)
    states = assets.verify(manifest, assets.hashed(manifest, store.root), include_optional=True)
    return manifest.join(states, "path").select("path", "sha256", "bytes", F.array_join("wrappers", ",").alias("wrappers"), "required", "state")


@stated("SELECT unnest(['PATH_COLLISION', 'POLICY_FROZEN_PAGE', 'SUMMARY_REQUIRED', 'BAD_PATH', 'WIKI_LINK_SHORT_FORM', 'INDEX_MISSING', 'BAD_SCOPE', 'BAD_LAYER', 'BAD_WHERE', 'BAD_TIMESTAMP', 'BAD_QUERY_REGEX', 'FM_KEY_NOT_FOUND', 'NOT_A_STORE']) AS code, "
        "unnest([5, 4, 2, 2, 2, 1, 2, 2, 2, 2, 2, 1, 3])::BIGINT AS exit_code")
def store_refusals(spark, sf):
    """What is refused, with the code and the exit code of each."""
    from ..errors import StoreError
    from ..functions import match, time
    from ..operators import query

    store = build(spark, sf)
    rows = tb.customers(spark, sf)
    tries = [
        lambda: write.write(store, "nation", "0", {"summary": "x"}, path="records/nations/0.md"), lambda: write.set_field(store, "records/regions/0.md", "a", "b"),
        lambda: write.write(store, "odd", "x", {}, ""), lambda: write.set_field(store, "elsewhere/x.md", "a", "b"), lambda: write.link(store, "records/nations/0.md", "short"),
        lambda: catalog.show(store.root, "records/nations"), lambda: catalog.show(store.root, "else"), lambda: query.query(rows, layer="else"), lambda: query.query(rows, wheres=["no sign"]),
        lambda: time.bound("May"), lambda: match.check_regex("(?=x)"), lambda: query.field_of(rows, "records/customers/0", "none"), lambda: S.Store.open(os.path.join(store.root, "records")),
    ]
    found = []
    for one in tries:
        try:
            one()
        except StoreError as e:
            found.append((e.code, e.exit_code))
    return spark.createDataFrame(found, "code string, exit_code long")


@stated("SELECT 'records/inner' AS path, 'listed' AS what UNION ALL SELECT 'records/inner', 'NESTED_STORE' UNION ALL SELECT 'records/link.md', 'left out'")
def store_boundary(spark, sf):
    """A store inside the store is named but not entered; a link out of the store is passed over."""
    store = build(spark, sf)
    os.makedirs(f"{store.root}/records/inner")
    for name in ("STORE.md", "x.md"):
        with open(f"{store.root}/records/inner/{name}", "w") as f:
            f.write(_page("note", "inner", 1))
    os.symlink("/etc/hostname", f"{store.root}/records/link.md")
    listed = [(r.path, "listed") for r in S.listing(spark, store).filter("path like 'records/inner%' or path like 'records/link%'").collect()]
    issues = [(r.file, r.code) for r in validate.config_rules(spark, store).filter("code = 'NESTED_STORE'").collect()]
    out = [("records/link.md", "left out")] if "records/link.md" not in dict(listed) else []
    return spark.createDataFrame(listed + issues + out, "path string, what string")


@stated("SELECT 'records/customers/' || c_custkey AS path, sha256(encode('leaf') || '\\x00'::BLOB || unhex(lpad(hex(length('records/customers/' || c_custkey)), 16, '0')) || encode('records/customers/' || c_custkey) "
        "|| unhex('0000000000000020') || unhex(sha256(c_name))) AS entry, c_custkey % 2 = 0 AS reused FROM customer")
def content_entries(spark, sf):
    """Leaf hashes of a content tree, half of them taken over from a former one."""
    from ..operators import merkle

    rows = tb.read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("records/customers/"), F.col("c_custkey").cast("string")).alias("path"), F.sha2("c_name", 256).alias("sha256"))
    former = merkle.entries(rows.filter("c_custkey % 2 = 0"))
    return merkle.entries(rows, former).select("path", "entry", "reused")


@stated("SELECT path, row_number() OVER (ORDER BY path) AS rank FROM (SELECT DISTINCT 'assets/' || p_brand || '.pdf' AS path FROM part WHERE p_brand NOT LIKE '%3')")
def assets_paths(spark, sf):
    """Safe paths of the manifest's required files, in plain text order."""
    name = F.when(F.col("p_brand").like("%3"), F.lit("../")).otherwise(F.lit("assets/"))
    rows = tb.read(spark, sf, "part").select(F.concat(name, F.col("p_brand"), F.lit(".pdf")).alias("path"), F.lit(True).alias("required")).distinct()
    return ranked(assets.paths(rows.unionByName(rows.withColumn("required", F.lit(False)).withColumn("path", F.concat("path", F.lit("x")))), required_only=True)).select("path", F.col("rank").cast("long").alias("rank"))
