"""What keeps the queries on parsed files fast: frontmatter without the YAML library, one parse a file, ranks without one task."""

import random

import yaml
from pyspark.sql import functions as F

from inkspan.operators import catalog, emit, stats, validate
from inkspan.plans import files as plans
from inkspan.sources import frontmatter as fm
from inkspan.sources import store as S

HEAD = 'type: building\nid: c7\ncreated: 2026-01-02T03:04:05Z\nsummary: Customer#000000007\nnation: "[[records/nations/7|Nation 7]]"\npeers:\n  - "[[records/customers/8]]"\n  - b c\ncents: -956195\nshare: 1.5\nok: true\nnone:\ntags: [BUILDING, n7, 8]\n'
TOKENS = ["a", "b1", "é", "-", "- ", "  - ", ": ", ":", "\n", "\n", " ", "#", " #", "[", "]", ", ", '"', "'", "true", "null", "~", "-1", "1.5", ".inf", "|", ">", "&x", "*x", "!t", "? ", "{", "}", "...", "%", "<<", "\t",
          "2026-01-02T03:04:05Z", '"[[a/b]]"', "k: v\n", "k2: ", "tags: [a, b]\n", "x:\n", '  - "q w"\n', "- z\n", "\u2028", "\x07"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_simple_frontmatter_needs_no_yaml_library(monkeypatch):
    want = yaml.load(HEAD, fm._Loader)
    monkeypatch.setattr(yaml, "load", None)
    assert fm.load(HEAD) == want and list(fm.load(HEAD)) == list(want)


def test_simple_frontmatter_is_what_the_library_says():
    r, taken = random.Random(3), 0
    for _ in range(60_000):
        text = "".join(r.choice(TOKENS) for _ in range(r.randint(1, 9)))
        if (got := fm.simple(text)) is not None:
            taken += 1
            assert repr(got) == repr(yaml.load(text, fm._Loader)), text
    assert taken > 500
    for text in ("a: b\na: c\n", "a: b: c\n", "a: x\n  y\n", "a:\n  - b\n - c\n", "true: x\n", "a: 'b'\n", "a: b # c\n", "a:\n  b: c\n", "a: [b, [c]]\n", "a: &x b\n"):
        assert fm.simple(text) is None, text


def test_ranks_follow_the_order_without_a_window_over_all_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5).orderBy("k")
    out = plans.ranked(rows)
    assert [(x.k, x.rank) for x in out.orderBy("rank").collect()] == [(i, i + 1) for i in range(1000)]
    window = plan(out).split("Window [")[1]
    assert "HashAggregate" in window.split("FileScan")[0]  # it takes a row a partition, not the rows


def test_the_dump_parses_files_after_their_sort(spark):
    files = S.described(spark.createDataFrame([("records/a/b.md", 1, bytearray(b"---\ntype: x\n---\n"))], "path string, size long, content binary"))
    lines = plan(emit.emit(files)).splitlines()
    sort = next(i for i, x in enumerate(lines) if "Sort [" in x)
    assert any("_emitted" in x for x in lines[:sort]) and not any("_emitted" in x for x in lines[sort:])


def test_catalogue_lines_come_in_order_from_many_partitions(spark, tmp_path):
    import duckdb

    duckdb.sql(f"COPY (SELECT i AS c_custkey, 'Customer#' || lpad(i::VARCHAR, 9, '0') AS c_name, (i % 25)::INT AS c_nationkey, i / 4 AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(300) t(i)) TO '{tmp_path}/customer.parquet'")
    out = plans.files_json_lines(spark, str(tmp_path))
    assert "Window [" in plan(out) and "HashAggregate" in plan(out).split("Window [")[1].split("FileScan")[0]
    paths = [x.path for x in catalog.json_lines(plans.records(spark, str(tmp_path))).orderBy("folder", *catalog.recency()).collect()]
    assert [x.path for x in out.orderBy("rank").collect()] == paths and len(paths) == 300
    assert "hashpartitioning(c_custkey" in plan(plans.markdown(spark, str(tmp_path)))


def test_rules_parse_each_file_once(spark):
    files = S.described(spark.createDataFrame([("records/a/b.md", 1, bytearray(b"---\ntype: x\nlinks: [[[a/b]], [[c/d]]]\n---\n")), ("records/a/c.md", 1, bytearray(b"---\ntype: x\n---\n"))], "path string, size long, content binary"))
    parts = validate.file_rules(validate.facts(files), validate.Config())
    found = validate.either(parts)
    assert plan(found).count("_facts(") and len([x for x in plan(found).splitlines() if "ArrowEvalPython" in x and "_facts(" in x]) == 1
    codes = [(x.file, x.code, x.key) for x in found.collect()]
    assert ("records/a/b.md", "WIKI_LINK_FLOW_FORM_LIST", "links") in codes and ("records/a/c.md", "SUMMARY_MISSING", "summary") in codes


def test_statistics_parse_types_and_links_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    links = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def kind(x):
        seen.add(1)
        return x

    @F.udf("string")
    def target(x):
        links.add(1)
        return x

    files = spark.createDataFrame([("records/a/b.md", "records", 3), ("records/a/c.md", "records", 4)], "path string, layer string, size long")
    records = files.select("path", kind(F.lit("x")).alias("type"))
    edges = files.select(F.col("path").alias("src"), target(F.lit("records/a/z")).alias("target"), F.lit("records/a/z").alias("dst_key"))
    got = stats.stats(files, records, edges, files)
    assert got["type_distribution"] == {"x": 2} and got["broken_link_count"] == 2 and got["orphan_count"] == 2
    assert seen.value <= 2 and links.value <= 2
