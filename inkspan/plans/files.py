"""Operators over markdown files, applied to files that the tables are rendered into, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import link, text as T, time as TM
from ..operators import assets, catalog, emit, extract, graph, merkle, query, search, stats, validate
from ..shared import written
from ..sources import store as S
from ..sources import tables as tb
from .queries import stated

#: One file for each customer, in words that both SQL dialects have: parts that are named below, put together.
_SQL_PARTS = """SELECT *, 'records/customers/' || k || '.md' AS path, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS m, '[[records/nations/' || n || '|Nation]]' AS raw1,
  '[[./records/customers/' || k || '.md]]' AS raw2, '2026-02-' || lpad(CAST(n + 1 AS VARCHAR(2)), 2, '0') || 'T00:00:00Z' AS updated
FROM (SELECT CAST(c_custkey AS VARCHAR(20)) AS ks, c_custkey AS k, c_nationkey AS n, c_name AS name, c_mktsegment AS seg, lower(c_mktsegment) AS type,
  CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)"""
_SQL_HEAD = """'---' || L || 'type: ' || type || L || 'id: c' || k || L || CASE WHEN m = 1 THEN 'meta-type: conclusion' || L ELSE '' END || 'created: 2026-01-02T03:04:05Z' || L || 'updated: ' || updated || L
  || 'summary: ' || name || L || 'nation: "[[records/nations/' || n || '|Nation ' || n || ']]"' || L || 'peers:' || L || '  - "[[records/customers/' || (k + 1) || ']]"' || L
  || '  - "[[records/customers/' || (k + 2) || '.md]]"' || L || 'cents: ' || cents || L || 'tags: [' || seg || ', n' || n || ']' || L || '---' || L"""
_SQL_BODY = """'# ' || name || L || L || 'Lives in ' || raw1 || ', é ' || raw2 || '.' || L || L || '```' || L || '[[records/nations/999]]' || L || '```' || L || L
  || '## Part ' || (k % 5) || L || 'first line' || L || '### Deep' || L || 'more' || L || '## Last ##' || L || 'end' || L"""
_TEXTS = f"SELECT *, {_SQL_HEAD} AS head, {_SQL_BODY} AS body FROM (SELECT *, chr(10) AS L FROM ({_SQL_PARTS}))"
_FILES = f"WITH f AS (SELECT *, head || body AS text FROM ({_TEXTS})) "


def markdown(spark, sf) -> DataFrame:
    """The files, described as a store's files are."""
    rows = spark.sql(f"SELECT path, head || body AS text FROM ({_TEXTS.replace('customer)', '{customer})')})", customer=tb.read(spark, sf, "customer").repartition("c_custkey"))  # files are parsed in as many tasks as a shuffle has, as a store's are
    return S.described(rows.select("path", F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content")))


def records(spark, sf) -> DataFrame:
    return S.records(markdown(spark, sf))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their rank in the order in which they come: for operators whose order is the point.

    The rows are written with their partition and their place in it; what ranks
    a partition begins with follows from one row a partition.
    """
    kept = written(rows.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    sizes = kept.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + place + 1).drop("at", "part", "before")


@stated(_FILES + "SELECT path, 'records' AS layer, 'records/customers' AS type_folder, type, name AS summary, seg || ',n' || n AS tags, '2026-01-02T03:04:05Z' AS created_raw, updated AS updated_raw, "
        "strftime(strptime(updated, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M') AS updated, cents::VARCHAR AS cents, CASE m WHEN 1 THEN 'conclusion' ELSE 'fact' END AS meta, 'int' AS kind FROM f")
def files_records(spark, sf):
    return records(spark, sf).select(
        "path", "layer", "type_folder", "type", "summary", F.array_join("tags", ",").alias("tags"), "created_raw", "updated_raw", F.date_format("updated", "yyyy-MM-dd HH:mm").alias("updated"),
        F.get_json_object("fields_json", "$.cents").alias("cents"), F.get_json_object("fields_json", "$['meta-type']").alias("meta"), F.element_at("tokens", "cents")[0]["kind"].alias("kind"))


@stated(_FILES + "SELECT path, k AS size, length(head) AS head, 14 + m AS body_line, body FROM f")
def files_split(spark, sf):
    """The head is found, and the body begins where it ends."""
    return markdown(spark, sf).select(
        "path", F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("size"), (F.char_length("text") - F.char_length("body")).cast("long").alias("head"), "body_line", "body")


_EDGES = (
    "SELECT path AS src, 'records/nations/' || n AS target, 'records/nations/' || n AS dst_key, 'fm' AS region, 7 + m AS line, NULL::INT AS \"start\", NULL::INT AS \"end\", '[[records/nations/' || n || '|Nation ' || n || ']]' AS raw, 'Nation ' || n AS alias, 'nation' AS key FROM f "
    "UNION ALL SELECT path, 'records/customers/' || (k + 1), 'records/customers/' || (k + 1), 'fm', 9 + m, NULL, NULL, '[[records/customers/' || (k + 1) || ']]', NULL, 'peers' FROM f "
    "UNION ALL SELECT path, 'records/customers/' || (k + 2) || '.md', 'records/customers/' || (k + 2), 'fm', 10 + m, NULL, NULL, '[[records/customers/' || (k + 2) || '.md]]', NULL, 'peers' FROM f "
    "UNION ALL SELECT path, 'records/nations/' || n, 'records/nations/' || n, 'body', 16 + m, (length(name) + 13)::INT, (length(name) + 13 + length(raw1))::INT, raw1, 'Nation', NULL FROM f "
    "UNION ALL SELECT path, './records/customers/' || k || '.md', 'records/customers/' || k, 'body', 16 + m, (length(name) + 18 + length(raw1))::INT, (length(name) + 18 + length(raw1) + length(raw2))::INT, raw2, NULL, NULL FROM f")


@stated(_FILES + _EDGES)
def files_edges(spark, sf):
    """Links of frontmatter and body with their places; the one in the code fence is none."""
    return S.edges(markdown(spark, sf))


@stated(_FILES + "SELECT path, 'records/nations/' || n AS target, 'Nation' AS display, 3 AS line, 10 AS \"column\", true AS is_full_path, false AS has_extension FROM f "
        "UNION ALL SELECT path, './records/customers/' || k || '.md', NULL, 3, (14 + length(raw1))::INT, false, true FROM f UNION ALL SELECT path, 'records/nations/999', NULL, 6, 1, true, false FROM f")
def files_wiki_links(spark, sf):
    return S.wiki_links(markdown(spark, sf))


@stated(_FILES + "SELECT path, 'nation' AS key, 'records/nations/' || n AS target, 'Nation ' || n AS display FROM f UNION ALL SELECT path, 'peers', 'records/customers/' || (k + 1), NULL FROM f "
        "UNION ALL SELECT path, 'peers', 'records/customers/' || (k + 2) || '.md', NULL FROM f")
def files_link_fields(spark, sf):
    return S.link_fields(markdown(spark, sf))


@stated(_FILES + "SELECT path, 'Part ' || (k % 5) AS heading, 2 AS level, 22 + m AS line, 'first line' || L || '### Deep' || L || 'more' AS body FROM f UNION ALL SELECT path, 'Deep', 3, 24 + m, 'more' FROM f "
        "UNION ALL SELECT path, 'Last', 2, 26 + m, 'end' FROM f")
def files_sections(spark, sf):
    return S.sections(markdown(spark, sf))


@stated(_FILES + "SELECT path, 1 AS level, name AS heading, 14 + m AS line FROM f UNION ALL SELECT path, 2, 'Part ' || (k % 5), 22 + m FROM f UNION ALL SELECT path, 3, 'Deep', 24 + m FROM f UNION ALL SELECT path, 2, 'Last', 26 + m FROM f")
def files_outline(spark, sf):
    return emit.outline(markdown(spark, sf))


@stated(_FILES + "SELECT path, name AS title, 'Lives in ' || raw1 || ', é ' || raw2 || '.' AS paragraph, name || ' of Nation ' || n AS summary FROM f")
def files_headlines(spark, sf):
    rows = markdown(spark, sf)
    return S.headlines(rows, "{summary} of {nation}")


@stated(_FILES + "SELECT path, left('Lives in ' || raw1 || ', é ' || raw2 || '.', 200) AS summary FROM f")
def files_default_summary(spark, sf):
    return S.headlines(markdown(spark, sf)).select("path", "summary")


@stated(_FILES + "SELECT path, 'records' AS layer, type, CASE m WHEN 1 THEN 'conclusion' ELSE 'fact' END AS meta_type, 'c' || k AS id, name AS title, name AS summary, "
        "'records/nations/' || n || ' records/customers/' || (k + 1) || ' records/customers/' || (k + 2) || '.md ./records/customers/' || k || '.md' AS links, "
        "raw1 || raw2 AS spans, '2026-01-02T03:04:05Z' AS created, updated, sha256(text) AS sha256, body, row_number() OVER (ORDER BY k::VARCHAR || '.md') AS rank FROM f")
def files_emit(spark, sf):
    """The wide dump, in path order."""
    rows = ranked(emit.emit(markdown(spark, sf)))
    return rows.select("path", "layer", "type", "meta_type", "id", "title", "summary", F.array_join("links", " ").alias("links"),
                       F.array_join(F.transform("link_spans", lambda x: x["raw"]), "").alias("spans"), "created", "updated", "sha256", "body", F.col("rank").cast("long").alias("rank"))


@stated(_FILES + "SELECT path, '---' || L || 'type: ' || type || L || CASE WHEN m = 1 THEN 'meta-type: conclusion' || L ELSE '' END || 'id: c' || k || L || 'created: \"2026-01-02T03:04:05Z\"' || L || 'updated: \"' || updated || '\"' || L "
        "|| 'summary: \"' || name || '\"' || L || 'cents: ' || cents || L || 'nation: \"[[records/nations/' || n || '|Nation ' || n || ']]\"' || L || 'peers:' || L || '  - \"[[records/customers/' || (k + 1) || ']]\"' || L "
        "|| '  - \"[[records/customers/' || (k + 2) || '.md]]\"' || L || 'tags: [' || seg || ', n' || n || ']' || L || '---' || L || body AS text FROM f")
def files_formatted(spark, sf):
    return emit.formatted(markdown(spark, sf))


@stated(_FILES + "SELECT path, replace(text, '[[records/nations/7|', '[[records/lands/seven|') AS text FROM f WHERE n = 7")
def files_relinked(spark, sf):
    return emit.relinked(markdown(spark, sf), "./records/nations/7.md", "records/lands/seven")


_JSON = ("'{\"path\":\"' || path || '\",\"type\":\"' || type || '\",\"summary\":\"' || name || '\",\"tags\":[\"' || seg || '\",\"n' || n || '\"],\"links\":[],\"created\":\"2026-01-02T03:04:05Z\",\"updated\":\"' || updated "
         "|| '\",\"cents\":' || cents || ',\"id\":\"c' || k || '\",\"meta-type\":\"' || CASE m WHEN 1 THEN 'conclusion' ELSE 'fact' END || '\",\"nation\":\"[[records/nations/' || n || '|Nation ' || n || ']]\",\"peers\":[\"[[records/customers/' || (k + 1) "
         "|| ']]\",\"[[records/customers/' || (k + 2) || '.md]]\"]}'")


@stated(_FILES + f"SELECT 'records/customers' AS folder, path, {_JSON} AS json, row_number() OVER (ORDER BY updated DESC, k::VARCHAR || '.md') AS rank FROM f")
def files_json_lines(spark, sf):
    """Catalogue lines in the order in which a folder's file has them."""
    return ranked(catalog.json_lines(records(spark, sf)).orderBy("folder", *catalog.recency())).select("folder", "path", "json", F.col("rank").cast("long").alias("rank"))


@stated(_FILES + ", t AS (SELECT count(*) AS c, max(updated) AS u, any_value(L) AS L FROM f) "
        "SELECT 'records/index.md' AS name, '---' || L || 'type: index' || L || 'scope: layer' || L || 'folder: records' || L || 'updated: ' || u || L || '---' || L || L || '# records' || L || L || '- [[records/customers/index|Customers]] (' || c || ')' || L AS text FROM t "
        "UNION ALL SELECT 'index.md', '---' || L || 'type: index' || L || 'scope: root' || L || 'updated: ' || u || L || '---' || L || L || '# Pages' || L || L || '## Records (' || c || ')' || L || '- [[records/customers/index|Customers]] (' || c || ')' || L FROM t")
def files_upper_pages(spark, sf):
    pages = catalog.upper_indexes(records(spark, sf), title="Pages")
    return spark.createDataFrame(list(pages.items()), "name string, text string")


@stated(_FILES + f", e AS ({_EDGES}) SELECT count(*) AS total_files, (SELECT sum(octet_length(encode(text)))::BIGINT FROM f) AS total_size_bytes, "
        "(SELECT count(*) FROM e WHERE dst_key || '.md' NOT IN (SELECT path FROM f))::BIGINT AS broken_link_count, 0::BIGINT AS orphan_count FROM f")
def files_stats(spark, sf):
    files = markdown(spark, sf)
    got = stats.stats(files, S.records(files, strict=False), S.edges(files), files.select("path"))
    names = ("total_files", "total_size_bytes", "broken_link_count", "orphan_count")
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


@stated(_FILES + "SELECT path, code, key FROM (SELECT path, m, n, unnest(['SCHEMA_MISSING_REQUIRED', 'SCHEMA_ENUM_VIOLATION', 'SCHEMA_LINK_PREFIX_MISMATCH']) AS code, unnest(['email', 'meta-type', 'nation']) AS key FROM f) "
        "WHERE code <> 'SCHEMA_ENUM_VIOLATION' OR m = 1")
def files_schema_rules(spark, sf):
    """Rules over parsed files: a field that no file has, an enumeration that some break, a link prefix that all break."""
    from ..sources.config import Config, FieldSpec, Schema

    rows = validate.facts(markdown(spark, sf))
    kinds = ["automobile", "building", "furniture", "machinery", "household"]
    fields = [FieldSpec("email", required=True), FieldSpec("meta-type", enum=["fact"]), FieldSpec("nation", link_prefix="records/people/"), FieldSpec("cents", shape="int")]
    found = validate.united(validate.file_rules(rows, Config(schemas={k: Schema(fields=fields) for k in kinds})))
    return found.select(F.col("file").alias("path"), "code", "key")


@stated(_FILES + "SELECT row_number() OVER (ORDER BY k::VARCHAR || '.md', code, key) AS rank, path AS file, code, key FROM ("
        "SELECT path, k, unnest(['SCHEMA_MISSING_REQUIRED', 'SCHEMA_MISSING_REQUIRED', 'SCHEMA_LINK_PREFIX_MISMATCH']) AS code, unnest(['zz', 'aa', 'nation']) AS key FROM f WHERE seg = 'MACHINERY')")
def files_issue_order(spark, sf):
    """Issues by file, code and key."""
    from ..sources.config import Config, FieldSpec, Schema

    rows = validate.facts(markdown(spark, sf).filter(F.contains("text", F.lit("type: machinery"))))
    config = Config(schemas={"machinery": Schema(fields=[FieldSpec("zz", required=True), FieldSpec("nation", link_prefix="x/"), FieldSpec("aa", required=True)])})
    return ranked(validate.united(validate.file_rules(rows, config))).select(F.col("rank").cast("long").alias("rank"), "file", "code", "key")


@stated("SELECT 'records/customers/' || c_custkey AS path, row_number() OVER (ORDER BY c_custkey::VARCHAR) AS rank FROM customer WHERE c_mktsegment = 'BUILDING'")
def query_path_order(spark, sf):
    return ranked(query.query(tb.customers(spark, sf), type="building")).select("path", F.col("rank").cast("long").alias("rank"))


@stated("SELECT DISTINCT 'records/parts/' || l_partkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 7 AND p_size > 10")
def graph_forwardlinks_typed(spark, sf):
    edges = tb.edge(tb.read(spark, sf, "lineitem"), "records/orders/", "l_orderkey", "records/parts/", "l_partkey")
    parts = tb.read(spark, sf, "part").filter("p_size > 10").select(F.concat(F.lit("records/parts/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return graph.forwardlinks(edges, "records/orders/7", parts)


@stated("WITH e AS (SELECT 'records/regions/' || n_regionkey AS path, 0 AS side FROM nation WHERE n_nationkey = 7 UNION SELECT 'records/customers/' || c_custkey, 1 FROM customer WHERE c_nationkey = 7 "
        "UNION SELECT 'records/suppliers/' || s_suppkey, 1 FROM supplier WHERE s_nationkey = 7), t AS (SELECT * FROM e ORDER BY side, split(path, '/') LIMIT 5) "
        "SELECT path, coalesce(c_name, '') AS summary, lower(c_mktsegment) AS type, 1 AS hops, 'records/nations/7' AS via, CASE side WHEN 0 THEN 'out' ELSE 'in' END AS direction "
        "FROM t LEFT JOIN customer ON path = 'records/customers/' || c_custkey")
def graph_neighborhood_capped(spark, sf):
    """The first five that are discovered, hydrated: outgoing before incoming, each in path order."""
    return graph.neighborhood(tb.edges(spark, sf), "records/nations/7", 1, nodes=tb.customers(spark, sf), max_nodes=5)


_TWO = ("WITH e AS (SELECT 'records/customers/' || c_custkey AS a, 'records/nations/' || c_nationkey AS b FROM customer UNION SELECT 'records/nations/' || n_nationkey, 'records/regions/' || n_regionkey FROM nation), "
        "h1 AS (SELECT b AS path, 0 AS side FROM e WHERE a = 'records/nations/7' UNION SELECT a, 1 FROM e WHERE b = 'records/nations/7'), "
        "h2 AS (SELECT DISTINCT e.a AS path, h1.path AS via FROM e JOIN h1 ON e.b = h1.path WHERE h1.path LIKE 'records/regions/%' AND e.a <> 'records/nations/7') ")


@stated(_TWO + "SELECT path, 1 AS hops, 'records/nations/7' AS via, CASE side WHEN 0 THEN 'out' ELSE 'in' END AS direction FROM h1 UNION ALL SELECT path, 2, via, 'in' FROM h2")
def graph_neighborhood_via(spark, sf):
    """Two hops with the node and the direction that led to each."""
    t = lambda n: tb.read(spark, sf, n)
    edges = tb.edge(t("customer"), "records/customers/", "c_custkey", "records/nations/", "c_nationkey").unionByName(tb.edge(t("nation"), "records/nations/", "n_nationkey", "records/regions/", "n_regionkey"))
    return graph.neighborhood(edges, "records/nations/7", 2, max_nodes=100_000)


_LINES = ("SELECT doc_id, source, lang, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM ("
          "SELECT doc_id, source, lang, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents)")


@stated(f"SELECT 'sources/' || source || '/' || doc_id || '.md' AS path, line::INT AS line, text FROM ({_LINES}) WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3') "
        "AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND regexp_matches(text, 'th[ae]')")
def search_structured(spark, sf):
    """Lines of files that a type, a field and a link select together."""
    rows = tb.read(spark, sf, "documents").withColumn("group", (F.regexp_extract("source", r"(\d+)", 1).cast("int") / 4).cast("int"))
    path = F.concat(F.lit("sources/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    known = tb.as_records(rows, path=path, type=F.col("lang"), summary=F.col("source"), fields=["group"], layer="sources")
    labels = tb.read(spark, sf, "labels").join(rows.select("doc_id", "source"), "doc_id")
    edges = labels.select(F.concat(F.lit("sources/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("records/quality/"), F.col("quality").cast("string")).alias("target"))
    edges = edges.withColumn("dst_key", F.col("target"))
    return search.search(tb.files(spark, sf), known, edges, "th[ae]", layer="sources", type="en", wheres=["group=0"], links_to="records/quality/1.md", ordered=False)


@stated("WITH d AS (SELECT p_brand AS path, list_sort(array_agg(DISTINCT l_suppkey::VARCHAR)) AS w, bool_or(l_returnflag = 'R') AS required FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) "
        "SELECT path || '.pdf' AS path, CASE WHEN path LIKE '%1' THEN 'new' ELSE 'old' END AS sha256, CASE WHEN path LIKE '%1' THEN 1 ELSE 2 END::BIGINT AS bytes, 'application/pdf' AS media_type, "
        "array_to_string(w, ',') AS wrappers, required FROM d WHERE path LIKE '%1' OR path LIKE '%2'")
def assets_scan(spark, sf):
    """A new manifest: hashes of what is there, former rows of what is not, nothing of what never was."""
    rows = tb.read(spark, sf, "lineitem").join(tb.read(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    declared = rows.select(F.col("l_suppkey").cast("string").alias("wrapper"), F.concat("p_brand", F.lit(".pdf")).alias("path"), (F.col("l_returnflag") == "R").alias("required"))
    brands = tb.read(spark, sf, "part").select(F.concat("p_brand", F.lit(".pdf")).alias("path")).distinct()
    actual = brands.filter("path like '%1.pdf'").withColumns({"sha256": F.lit("new"), "bytes": F.lit(1).cast("long")})
    manifest = brands.filter("path like '%1.pdf' or path like '%2.pdf'").withColumns({"sha256": F.lit("old"), "bytes": F.lit(2).cast("long")})
    return assets.scan(declared, manifest, actual).withColumn("wrappers", F.array_join("wrappers", ","))


@stated("SELECT c_custkey, CASE i WHEN 0 THEN 'a/B' || c_custkey WHEN 1 THEN 'Café/x' ELSE NULL END AS portable, CASE i WHEN 0 THEN 'a/b' || c_custkey WHEN 1 THEN 'café/x' ELSE NULL END AS alias FROM (SELECT c_custkey, c_custkey % 6 AS i FROM customer)")
def paths_portable(spark, sf):
    """Paths that every system can hold, and what systems without letter case call them."""
    forms = F.array(F.concat(F.lit("a/B"), F.col("c_custkey").cast("string")), F.lit("Café/x"), F.lit("a/CON.txt"), F.lit("a/../b"), F.lit("a/b."), F.lit("/a"))
    rows = tb.read(spark, sf, "customer").select("c_custkey", F.element_at(forms, (F.col("c_custkey") % 6 + 1).cast("int")).alias("path"))
    return merkle.portable_paths(rows.select("path")).distinct().join(rows, "path").select("c_custkey", "portable", "alias")


@stated("SELECT c_custkey, c_name || chr(10) || chr(10) || '* ' || c_mktsegment || chr(10) || '* a & b' || chr(10) || chr(10) || '1. one' || chr(10) AS text FROM customer")
def extract_html_parts(spark, sf):
    html = F.concat(F.lit("<title>t</title><script>x()</script><h1>"), F.col("c_name"), F.lit("</h1><ul><li>"), F.col("c_mktsegment"), F.lit("<li>a  &amp;\n b</ul><ol><li>one</ol><style>p{}</style>"))
    rows = tb.read(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".HTML")).alias("path"), html.cast("binary").alias("content"))
    return extract.extract(rows).select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("c_custkey"), "text")


@stated("SELECT c_custkey, 'x' || chr(9) || c_name || 'y' AS clean, 'x ' || c_name || 'y' AS one_line, c_name || chr(10) || chr(10) || 'b' || chr(10) AS tidy, 'é' || c_custkey || chr(65533) AS lossy FROM customer")
def text_sanitized(spark, sf):
    """Control sequences, line ends and broken bytes."""
    name = F.col("c_name")
    raw = F.concat(F.lit("x\t\x1b[1;31m"), name, F.lit("\x1b[0m\x07\x1b]0;title\x07y"))
    lossy = F.concat(F.lit("é").cast("binary"), F.col("c_custkey").cast("string").cast("binary"), F.unhex(F.lit("ff")))
    return tb.read(spark, sf, "customer").select(
        "c_custkey", T.sanitize(raw).alias("clean"), T.sanitize_line(raw).alias("one_line"), T.normalize_extracted(F.concat(F.lit("\n"), name, F.lit(" \t\r\n\r\n\n\nb"))).alias("tidy"),
        T.lossy_utf8(lossy).alias("lossy"))


@stated("SELECT c_custkey, i + 1 AS level, CASE i WHEN 6 THEN '' ELSE 'a # ' || c_custkey END AS heading, CASE WHEN i < 6 THEN i + 1 ELSE 0 END AS marked FROM (SELECT c_custkey, c_custkey % 7 AS i FROM customer)")
def text_headings(spark, sf):
    """Levels and texts of headings, closing marks left out; seven marks are no heading."""
    i = (F.col("c_custkey") % 7).cast("int")
    line = F.concat(F.lit("  "), F.repeat(F.lit("#"), i + 1), F.lit(" a # "), F.col("c_custkey").cast("string"), F.lit(" ##  "))
    return tb.read(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7 + 1).alias("level"), T.heading_text(line).alias("heading"), T.heading_level(line).cast("long").alias("marked"))


@stated("SELECT c_custkey, CASE i WHEN 0 THEN 'caf' || chr(233) || c_custkey ELSE 'records/n/' || c_custkey END AS key, i = 2 AS short FROM (SELECT c_custkey, c_custkey % 3 AS i FROM customer)")
def links_edge_keys(spark, sf):
    """Targets as links compare: NFC, no extension, no leading dots."""
    k = F.col("c_custkey").cast("string")
    forms = F.array(F.concat(F.lit(" café"), k, F.lit(".md ")), F.concat(F.lit("././records\\n\\"), k), F.concat(F.lit("/records/n/"), k))
    own = F.element_at(forms, (F.col("c_custkey") % 3 + 1).cast("int"))
    short = F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("./"), k, F.lit(".md"))).otherwise(F.lit("a/b"))
    return tb.read(spark, sf, "customer").select("c_custkey", link.edge_key(own).alias("key"), link.is_short_form(short).alias("short"))


@stated("SELECT event_id, i < 4 AS ok, CASE WHEN i < 4 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM (SELECT event_id, ts, event_id % 8 AS i FROM events)")
def time_strict_forms(spark, sf):
    """One instant in four spellings, and four texts that are no full times."""
    ts = F.col("ts").cast("timestamp")
    z = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    forms = [F.concat(z, F.lit("Z")), F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("z")), F.concat(F.date_format(ts + F.expr("interval 2 hours"), "yyyy-MM-dd't'HH:mm:ss"), F.lit(".000+02:00")),
             F.concat(F.date_format(ts - F.expr("interval 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-01:30")), F.date_format(ts, "yyyy-MM-dd"), z, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), F.lit("Z")),
             F.concat(F.date_format(ts, "yyyy-'13'-dd'T'HH:mm:ss"), F.lit("Z"))]
    found = TM.rfc3339(F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int")))
    return tb.read(spark, sf, "events").select("event_id", found.isNotNull().alias("ok"), F.date_format(found, "yyyy-MM-dd HH:mm:ss").alias("at"))


@stated(_FILES + "SELECT path, 'part-' || (k % 5) AS slug, upper(type[1]) || type[2:] AS shown, 'records/customers/' || k AS target, 'records/customers' AS folder FROM f")
def sql_scalars(spark, sf):
    """The scalar functions from a session's SQL."""
    from ..functions import sql

    sql.register(spark)
    rows = records(spark, sf).select("path", "type", F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"))
    return spark.sql("SELECT path, ink_slug('Part ' || (k % 5)) AS slug, ink_capitalize(type) AS shown, ink_target(' ./' || path) AS target, ink_type_folder(path) AS folder FROM {rows}", rows=rows)


@stated(_FILES + f", e AS ({_EDGES}) SELECT src AS path, region, dst_key, count(*) AS n FROM e GROUP BY ALL")
def sql_links(spark, sf):
    """Links by a table function from a session's SQL."""
    from ..functions import sql

    sql.register(spark)
    return spark.sql("SELECT path, l.region, l.dst_key, count(*) AS n FROM {files}, LATERAL ink_links(text) AS l GROUP BY ALL", files=markdown(spark, sf).select("path", "text"))


@stated("SELECT c_mktsegment AS layer, 'n' || c_nationkey AS type_folder, 'records/customers/' || c_custkey AS path, row_number() OVER (ORDER BY c_mktsegment, 'n' || c_nationkey, c_custkey::VARCHAR) AS rank FROM customer WHERE c_mktsegment <> 'BUILDING'")
def tree_as_rows(spark, sf):
    """The tree in its order, a row for each file."""
    rows = tb.customers(spark, sf).withColumns({"layer": F.element_at("tags", 1), "type_folder": F.concat(F.lit("n"), F.element_at("tokens", "c_nationkey")[0]["text"])})
    return ranked(emit.tree_rows(rows.filter("layer <> 'BUILDING'"))).select("layer", "type_folder", "path", F.col("rank").cast("long").alias("rank"))


@stated("SELECT 'records/customers/' || c_custkey AS path, 'records/nations/' || c_nationkey AS target, 'body' AS region FROM customer WHERE c_nationkey >= 20")
def graph_broken_occurrences(spark, sf):
    """Every occurrence of a link to a nation that is not there, from parsed files."""
    edges = S.edges(markdown(spark, sf)).filter("region = 'body'")
    there = tb.read(spark, sf, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("records/nations/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"))
    there = there.unionByName(tb.read(spark, sf, "customer").select(F.concat(F.lit("records/customers/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path")))
    return graph.broken(edges, there).select(F.regexp_replace("src", r"\.md$", "").alias("path"), "target", "region")


@stated("SELECT 'records/customers/' || c_custkey AS path, 'records/nations/' || c_nationkey AS value FROM customer WHERE c_custkey = 7")
def query_field_of_one(spark, sf):
    """One field of one record, and its link reduced to the target."""
    rows = records(spark, sf)
    found = query.field_of(rows, "records/customers/7.md", "nation")
    return spark.createDataFrame([("records/customers/7", found.strip("[]").split("|")[0])], "path string, value string")


@stated("SELECT o_orderstatus AS kind, strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n FROM orders GROUP BY 1, 2")
def log_months_by_kind(spark, sf):
    """Entries by calendar month and kind, as a stream's unbounded counts have them."""
    from ..streaming import follow

    rows = tb.read(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("kind"))
    return follow.by_month(rows)


@stated("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM "
        "(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session")
def log_sessions(spark, sf):
    """Sessions of each user, two hours apart."""
    from ..streaming import follow

    rows = tb.read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return follow.sessions(rows, "2 hours").select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@stated("SELECT c_custkey, c_name || chr(10) || c_mktsegment || ' (é)' || chr(10) AS text, '1' AS pages FROM customer")
def extract_pdf_text(spark, sf):
    """The text layer of small PDF files, one for each customer."""
    body = F.concat(F.lit("BT /F1 9 Tf ("), F.col("c_name"), F.lit(") Tj 0 -12 Td ("), F.col("c_mktsegment"), F.lit(" \\(\\351\\)) Tj ET"))
    head = F.lit("%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n3 0 obj <</Type/Page/Parent 2 0 R/Contents 4 0 R>> endobj\n4 0 obj <</Length ")
    raw = F.concat(head, F.length(body).cast("string"), F.lit(">> stream\n"), body, F.lit("\nendstream endobj\ntrailer <</Root 1 0 R>>\n%%EOF"))
    rows = tb.read(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("path"), raw.cast("binary").alias("content"))
    found = extract.extract(rows)
    return found.select(F.split_part("path", F.lit("."), F.lit(1)).cast("long").alias("c_custkey"), "text", F.element_at("metadata", "pages").alias("pages"))


@stated(_FILES + "SELECT path, '---' || L || 'type: customer' || L || 'meta-type: fact' || L || 'created: \"2026-05-01T00:00:00Z\"' || L || 'updated: \"2026-05-01T00:00:00Z\"' || L || 'summary: First words of ' || k || L "
        "|| 'country: NZ' || L || '---' || L || 'First words of ' || k || L AS text FROM f")
def files_initialised(spark, sf):
    """Files that were dropped in without their fields, completed: type by folder, times, defaults, summary."""
    from datetime import datetime

    from ..sources.config import Config, FieldSpec, Schema

    rows = markdown(spark, sf).select("path", F.concat(F.lit("---\nmeta-type: fact\n---\nFirst words of "), F.regexp_extract("path", r"(\d+)", 1), F.lit("\n")).alias("text"))
    config = Config(schemas={"customer": Schema(fields=[FieldSpec("country", default="NZ")])})
    return emit.initialised(S.described(rows.select("path", F.lit(0).cast("long").alias("size"), F.col("text").cast("binary").alias("content"))), config, datetime(2026, 5, 1), {"records/customers": "customer"})


@stated("SELECT 'records/customers/' || c_custkey || ': ' || c_name AS line FROM customer WHERE c_nationkey = 7")
def query_text_lines(spark, sf):
    """Results as lines of text."""
    return query.lines(query.query(tb.customers(spark, sf), layer="records", wheres=["c_nationkey=7"]).select("path", "summary"), "text")


@stated("SELECT '{\"path\":\"records/customers/' || c_custkey || '\",\"type\":\"' || lower(c_mktsegment) || '\"}' AS line FROM customer WHERE c_nationkey = 7")
def query_json_lines(spark, sf):
    """Results as JSON, a line each."""
    return query.lines(query.query(tb.customers(spark, sf), layer="records", wheres=["c_nationkey=7"]).select("path", "type"), "ndjson")
