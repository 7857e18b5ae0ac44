import json
import os

import pytest
from pyspark.sql import functions as F

from inkspan.errors import StoreError
from inkspan.operators import assets, catalog, emit, graph, merkle, query, search, stats, timeline, validate, write
from inkspan.sources import store as S
from store_fixture import build


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    return S.Store.open(build(tmp_path_factory.mktemp("store")))


@pytest.fixture(scope="module")
def files(spark, store):
    return S.files(spark, store).persist()


@pytest.fixture(scope="module")
def good(files):
    return files.filter("path <> 'records/notes/bad.md'")


@pytest.fixture(scope="module")
def records(good):
    return S.records(good).persist()


@pytest.fixture(scope="module")
def edges(files):
    return S.edges(files).persist()


def paths(df, c="path"):
    return [r[c] for r in df.collect()]


def test_listing(spark, store, files):
    got = set(paths(files))
    assert "records/companies/_hidden-name.md" in got and not any(".git" in p for p in got) and "STORE.md" not in got and len(got) == 12
    assert paths(S.files(spark, store, folder="records/contacts").orderBy("path")) == [f"records/contacts/{n}.md" for n in ("bob", "eve", "zed")]
    with pytest.raises(StoreError) as e:
        S.Store.open("/tmp")
    assert e.value.code == "NOT_A_STORE" and e.value.exit_code == 3
    with pytest.raises(StoreError):
        S.files(spark, store, layer="other")


def test_malformed_frontmatter_fails_the_catalogue_only(files):
    with pytest.raises(Exception, match="FM_MALFORMED_YAML"):
        S.records(files).collect()
    assert S.records(files, strict=False).count() == 12


def test_query(records):
    # Path order is by component: a/x before a-b.
    assert paths(query.query(records, type="company")) == ["records/companies/_hidden-name.md", "records/companies/a/x.md", "records/companies/a-b.md", "records/companies/acme.md"]
    assert paths(query.query(records)) == []
    assert paths(query.query(records, wheres=["turnover=1234"])) == ["records/companies/_hidden-name.md"]
    assert paths(query.query(records, wheres=["turnover=1234.0", "founded=yes"])) == ["records/companies/_hidden-name.md"]
    assert paths(query.query(records, wheres=["tags=big"])) == ["records/companies/acme.md"]
    assert paths(query.query(records, layer="records", updated_after="2026-02-01", updated_before="2026-02-28T22:00:00Z")) == ["records/companies/a/x.md", "records/companies/acme.md"]
    assert paths(query.query(records, wheres=["big=12345678901234567890123", "code=012", "n=7", "x=1000"])) == ["records/notes/plan.md"]
    assert paths(query.query(records, layer="records", limit=1)) == ["records/companies/_hidden-name.md"]
    assert paths(query.find_by_type(records, "note")) == []  # its canonical layer is sources
    assert {r.value for r in query.get_field(records, "tier").collect()} == {"gold", "tin"}
    with pytest.raises(StoreError):
        query.query(records, layer="x")


def test_search(files, records, edges):
    got = [(r.path, r.line, r.text) for r in search.search(files, records, edges, "[Kk]ickoff").collect()]
    assert [g[0] for g in got] == ["records/loose.md", "records/loose.md", "sources/emails/2026/01/mail.md"]
    assert got[0][2] == "A kickoff line" and got[0][1] == 7
    assert len(search.search(files, records, edges, "kickoff", type="email").collect()) == 1
    assert search.search(files, records, edges, "Hello", links_to="records/companies/acme").count() == 1
    assert search.search(files, records, edges, "anvils", linked_from="records/contacts/eve").count() == 1
    assert search.search(files, records, edges, "[Kk]ickoff", limit=1).count() == 1
    with pytest.raises(StoreError):
        search.search(files, records, edges, "(")


def test_graph(spark, store, files, records, edges):
    assert paths(graph.backlinks(edges, "records/contacts/eve"), "src") == ["records/companies/acme", "records/notes/plan"]
    assert paths(graph.backlinks(edges, "records/contacts/eve", records.filter("type = 'note'")), "src") == ["records/notes/plan"]
    assert paths(graph.forwardlinks(edges, "records/contacts/eve"), "target") == ["nobody", "records/companies/acme", "records/none/gone"]
    assert "records/companies/a-b.md" in paths(graph.orphans(files, edges))  # the only link to it is fenced
    assert "records/companies/acme.md" not in paths(graph.orphans(files, edges))
    listing = S.listing(spark, store).filter("not is_dir")
    assert sorted(set(paths(graph.broken(edges, listing), "target"))) == ["nobody", "records/none/gone", "records/people/x"]
    rows = {r.path: (r.hops, r.via, r.direction, r.summary) for r in graph.neighborhood(edges, "records/contacts/eve", 2, nodes=records).collect()}
    assert rows["records/companies/acme"] == (1, "records/contacts/eve", "out", "Makes anvils") and rows["records/notes/plan"][:3] == (1, "records/contacts/eve", "in")
    assert rows["nobody"][3] == ""
    assert graph.neighborhood(edges, "records/contacts/eve", 1, max_nodes=2).count() == 2
    assert graph.neighborhood(edges, "records/contacts/eve", 1, nodes=records, type="company").count() == 1


def test_stats_tree_emit(spark, store, files, records, edges):
    got = stats.stats(files, S.records(files, strict=False), edges, S.listing(spark, store).filter("not is_dir"))
    assert got["total_files"] == 12 and got["files_per_layer"] == {"records": 10, "sources": 2} and got["top_types"][0] == ("company", 4) and got["broken_link_count"] == 3
    tree = {r.type_folder: r.paths for r in emit.tree(records).collect()}
    assert "records/loose.md" not in sum(tree.values(), []) and len(tree["records/companies"]) == 4
    rows = {r.path: r for r in emit.emit(files).collect()}
    eve = rows["records/contacts/eve.md"]
    assert eve.id == "e1" and eve.meta_type == "fact" and list(eve.links) == ["records/companies/acme", "nobody", "records/none/gone"] and rows["records/notes/bad.md"].frontmatter == "{}"
    assert rows["records/companies/acme.md"].title == "Acme" and len(eve.sha256) == 64
    assert emit.emit_tally(files).first().records == 10
    assert [(r.heading, r.level) for r in emit.outline(files).filter("path = 'records/notes/plan.md'").collect()] == [("One", 2), ("Deep", 3), ("Two", 2)]
    assert paths(emit.relinked(files, "records/contacts/eve", "records/contacts/eva").orderBy("path")) == ["records/companies/acme.md", "records/notes/plan.md"]
    again = emit.formatted(files.join(emit.formatted(files).select("path", F.col("text").alias("t")), "path").select("path", F.col("t").alias("text")))
    assert {r.path: r.text for r in again.collect()} == {r.path: r.text for r in emit.formatted(files).collect()}


def test_timeline(spark, store, edges):
    log = S.log(spark, store)
    assert [r.kind for r in timeline.tail(log, 2).collect()] == ["validate", "dance"]
    assert [r.kind for r in timeline.since(log, "2026-01-02T09:00:00Z").collect()] == ["create", "validate", "dance"]
    assert log.filter("kind = 'create'").first().note.endswith("## [not a header]")
    assert timeline.out_of_order(log).first().kind == "update" and timeline.unknown_kinds(log).first().kind == "dance"
    assert {r.ym: r.n for r in timeline.by_month(log).collect()} == {"2025-12": 1, "2026-01": 4}
    cut = F.lit("2026-01-02 00:00:00").cast("timestamp")
    assert set(paths(timeline.working_set(log, edges, cut))) == {"records/contacts/eve", "records/companies/acme", "records/notes/plan"}
    assert timeline.last_validate(log).first().ts == timeline.last_validate_physical(log).first().ts


def test_validate(spark, store):
    got = {(r.code, r.file, r.key) for r in validate.validate_all(spark, store).collect()}
    want = {
        ("DUP_ID", "records/contacts/bob.md", "id"), ("DUP_UNIQUE_KEY", "records/contacts/bob.md", "email"), ("FM_MALFORMED_YAML", "records/notes/bad.md", None),
        ("SCHEMA_ENUM_VIOLATION", "records/contacts/bob.md", "tier"), ("SCHEMA_LINK_PREFIX_MISMATCH", "records/contacts/bob.md", "company"), ("SUMMARY_MISSING", "records/contacts/zed.md", "summary"),
        ("SCHEMA_SHAPE_MISMATCH", "records/contacts/zed.md", "email"), ("FM_BAD_TIMESTAMP", "records/contacts/zed.md", "created"), ("FM_BAD_META_TYPE", "records/contacts/zed.md", "meta-type"),
        ("SCHEMA_SHAPE_MISMATCH", "records/companies/_hidden-name.md", "founded"), ("WIKI_LINK_SHORT_FORM", "records/contacts/eve.md", "nobody"), ("WIKI_LINK_BROKEN", "records/contacts/eve.md", "records/none/gone"),
        ("WIKI_LINK_HAS_EXTENSION", "records/notes/plan.md", "records/contacts/eve.md"), ("POLICY_IGNORED_TYPE_PRESENT", "sources/emails/2026/01/temp.md", "type"), ("LOG_OUT_OF_ORDER", "log.md", None),
        ("LOG_UNKNOWN_KIND", "log.md", None), ("INDEX_MISSING", "records/contacts/index.md", None), ("INDEX_JSONL_MISSING", "records/index.jsonl", None),
    }
    assert want <= got, want - got
    assert not any(c == "SCHEMA_SHAPE_MISMATCH" and f.endswith("acme.md") for c, f, _ in got)
    changed = spark.createDataFrame([("records/contacts/eve",)], "path string")
    some = {r.file for r in validate.validate_working_set(spark, store, changed).collect()}
    assert "records/contacts/eve.md" in some and "records/contacts/zed.md" not in some


def test_rebuilt_catalogue_validates_and_writes_keep_it(spark, tmp_path):
    store = S.Store.open(build(tmp_path))
    os.unlink(tmp_path / "records/notes/bad.md")
    catalog.rebuild(S.records(S.files(spark, store)), store.root, store.config)
    codes = {r.code for r in validate.validate_all(spark, store).collect()}
    assert not any(c.startswith("INDEX_") for c in codes), codes
    page = (tmp_path / "records/companies/index.md").read_text()
    assert catalog.show(store.root, "records/companies") == page and catalog.show(store.root).startswith("---\ntype: index")
    for scope, code in (("elsewhere", "BAD_SCOPE"), ("records/../x", "BAD_SCOPE"), ("records/none", "INDEX_MISSING")):
        with pytest.raises(StoreError) as e:
            catalog.show(store.root, scope)
        assert e.value.code == code
    assert page.splitlines()[4] == "updated: 2026-03-01T00:00:00+02:00" and "- [[records/companies/acme]] — Makes anvils  ·  #big #old" in page
    assert "- [[records/companies/index|Firms]] (4) — who we work with" in (tmp_path / "index.md").read_text()
    assert json.loads((tmp_path / "records/index.jsonl").read_text())["path"] == "records/loose.md"

    write.write(store, "contact", "ann", {"name": "Ann", "email": "ann@acme.com", "company": "[[records/companies/acme]]"}, "Hi.\n")
    assert "summary: Ann of acme" in (tmp_path / "records/contacts/ann.md").read_text() and "country: NZ" in (tmp_path / "records/contacts/ann.md").read_text()
    write.write(store, "email", "m2", {"date": "2026-2-03"}, "Body text\n")
    assert (tmp_path / "sources/emails/2026/02/m2.md").exists()
    write.set_field(store, "records/contacts/ann.md", "tier", "gold")
    write.link(store, "records/contacts/ann.md", "records/contacts/eve")
    linkers = [p + ".md" for p in paths(graph.backlinks(S.edges(S.files(spark, store)), "records/contacts/eve"), "src")]
    write.rename(store, "records/contacts/eve.md", "records/contacts/eva.md", linkers)
    assert "[[records/contacts/eva]]" in (tmp_path / "records/contacts/ann.md").read_text() and not (tmp_path / "records/contacts/eve.md").exists()
    assert not write.recover(store)
    (tmp_path / "records/contacts/raw.md").write_text("Dropped in.\n")
    write.initialise(store, "records/contacts/raw.md")
    for bad, code in ((("note", "plan", {}, "x", "records/notes/plan.md"), "POLICY_FROZEN_PAGE"), (("contact", "ann", {}, "x"), "PATH_COLLISION"), (("note", "no", {}, ""), "SUMMARY_REQUIRED")):
        with pytest.raises(StoreError) as e:
            write.write(store, *bad)
        assert e.value.code == code
    # Write-through equals a rebuild, byte for byte.
    kept = {n: (tmp_path / n).read_bytes() for n in catalog.rebuild(S.records(S.files(spark, store)), store.root, store.config, dry_run=True)}
    fresh = catalog.rebuild(S.records(S.files(spark, store)), store.root, store.config)
    assert set(fresh) == set(kept) and {n: (tmp_path / n).read_bytes() for n in fresh} == kept
    assert not [n for _, _, names in os.walk(tmp_path) for n in names if n.endswith(".tmp")]
    before = (tmp_path / "index.md").read_bytes()
    (tmp_path / "records/contacts/index.jsonl").write_text("stale")
    assert set(catalog.rebuild_folder(S.records(S.files(spark, store)), store.root, "records/contacts")) == {"records/contacts/index.md", "records/contacts/index.jsonl"}
    assert (tmp_path / "records/contacts/index.jsonl").read_bytes() == kept["records/contacts/index.jsonl"] and (tmp_path / "index.md").read_bytes() == before


def test_the_log_names_bad_headers_and_order_spans_files(spark, tmp_path):
    store = S.Store.open(build(tmp_path))
    (tmp_path / "log/2025-11.md").write_text("---\ntype: log\n---\n\n## [2026-05-01 10:00] create | records/x\nAhead.\n\n## [2025-02-30 10:00] update | records/y\n\n## [no time\nnote\n\n## [2026-05-01 11:00]\n")
    log = S.log(spark, store)
    found = validate.united(validate.log_rules(log)).collect()
    assert sum(r.code == "LOG_BAD_TIMESTAMP" for r in found) == 3
    late = [(r.file, r.code) for r in found if r.code == "LOG_OUT_OF_ORDER"]
    assert ("log/2025-12.md", "LOG_OUT_OF_ORDER") in late  # older than the archive before it, whatever stands between
    assert timeline.tail(log, 50).count() == 6


def test_a_store_of_another_name(spark, tmp_path):
    build(tmp_path)
    (tmp_path / "STORE.md").rename(tmp_path / "BASE.md")
    (tmp_path / "BASE.md").write_text((tmp_path / "BASE.md").read_text().replace("type: store", "type: base"))
    store = S.Store.open(str(tmp_path), "BASE.md", "base")
    assert not store.config.problems or all(p[1] != "CONFIG_BAD_TYPE" for p in store.config.problems)
    assert store.has("records/contacts/eve.md") and not store.has("records/contacts/EVE.md") and store.has("records/contacts", folder=True)
    assert len(paths(S.files(spark, store))) == 12
    with pytest.raises(StoreError) as e:
        query.field_of(S.records(S.files(spark, store), strict=False), "records/contacts/eve.md", "none")
    assert e.value.code == "FM_KEY_NOT_FOUND"


def test_listing_spreads_over_tasks(spark, tmp_path, monkeypatch):
    store = S.Store.open(build(tmp_path))
    want = sorted(store.paths())
    for levels in (1, 2, 9):
        monkeypatch.setattr(S, "LEVELS", levels)
        assert sorted((r.path, r.is_dir, r.size) for r in S.listing(spark, store).collect()) == want


def test_scoped_issues_disclose_nothing(spark):
    rows = spark.createDataFrame([("error", "WIKI_LINK_BROKEN", "a", 1, "k", "no file x", None, ["x"]), ("error", "DUP_ID", "a", 1, "k", "m", None, ["x"])], validate.ISSUES)
    got = {r.code: r for r in validate.scoped(rows).collect()}
    assert got["WIKI_LINK_SCOPED_UNRESOLVED"].severity == "info" and "x" not in got["WIKI_LINK_SCOPED_UNRESOLVED"].message.split() and got["WIKI_LINK_SCOPED_UNRESOLVED"].related == [] and got["DUP_ID"].related == ["x"]


def test_a_move_that_breaks_off_is_finished(spark, tmp_path, monkeypatch):
    store = S.Store.open(build(tmp_path))
    os.unlink(tmp_path / "records/notes/bad.md")
    catalog.rebuild(S.records(S.files(spark, store)), store.root, store.config)
    calls = []

    def breaking(path, data, new=False, durable=write.durable):
        calls.append(path)
        if len(calls) == 3:  # the journal and one text are written
            raise OSError("the disk went away")
        durable(path, data, new)

    monkeypatch.setattr(write, "durable", breaking)
    with pytest.raises(OSError):
        write.rename(store, "records/contacts/eve.md", "records/contacts/eva.md", ["records/companies/acme.md", "records/notes/plan.md"])
    monkeypatch.undo()
    assert (tmp_path / ".rename.json").exists() and write.recover(store) and not write.recover(store)
    assert (tmp_path / "records/contacts/eva.md").exists() and not (tmp_path / "records/contacts/eve.md").exists()
    assert "[[records/contacts/eva]]" in (tmp_path / "records/companies/acme.md").read_text() and "eva" in (tmp_path / "records/contacts/index.jsonl").read_text()


def test_log_append_rotates(tmp_path):
    from datetime import datetime

    build(tmp_path)
    timeline.append(str(tmp_path), "create", "records/x", "note\n## [x", datetime(2026, 2, 1, 8, 0))
    assert "records/contacts/eve" in (tmp_path / "log/2026-01.md").read_text() and "records/contacts/eve" not in (tmp_path / "log.md").read_text()
    assert (tmp_path / "log.md").read_text().count("## [2026") == 1


def test_assets(spark, store, tmp_path):
    declared = spark.createDataFrame([("r/a.md", "assets/a.pdf", True), ("r/b.md", "assets/a.pdf", False), ("r/b.md", "assets/gone.png", False)], "wrapper string, path string, required boolean")
    actual = assets.hashed(declared.select("path").distinct(), store.root)
    rows = assets.scan(declared, assets.empty_manifest(spark), actual)
    got = rows.collect()
    assert [r.path for r in got] == ["assets/a.pdf"] and got[0].wrappers == ["r/a.md", "r/b.md"] and got[0].required and got[0].media_type == "application/pdf" and got[0].bytes == 9
    assert assets.write_manifest(rows, str(tmp_path)) and not assets.write_manifest(rows, str(tmp_path))
    broken = rows.withColumn("sha256", F.lit("0"))
    assert assets.verify(broken, actual).first().state == "corrupt" and assets.verify(broken, actual, quick=True).first().state == "ok"
    assert paths(assets.untracked(S.listing(spark, store), declared)) == []
    assert assets.status(rows, actual).first().present == 1 and paths(assets.paths(rows)) == ["assets/a.pdf"]
    from inkspan.sources import frontmatter as fm

    assert assets.declared_in(fm.load("asset: a.pdf\nassets:\n  - b.pdf\n  - {path: c.pdf, required: false}\n")) == [{"path": "a.pdf", "required": True}, {"path": "b.pdf", "required": True}, {"path": "c.pdf", "required": False}]


def test_merkle(spark):
    entries = {f"records/a/{k}.md": f"{k:064x}" for k in range(200)}
    trie = merkle.Trie(entries)
    df = spark.createDataFrame(list(entries.items()), "path string, sha256 string")
    assert merkle.root(df) == trie.root() == merkle.root(df, 1) and merkle.root(df.limit(0)) == merkle.Trie({}).root() and merkle.root(df.limit(1)) == merkle.Trie(dict([df.first()])).root()
    for p in list(entries)[:20]:
        assert merkle.verify_proof(trie.root(), trie.prove(p)) == entries[p]
    assert merkle.verify_proof(trie.root(), trie.prove("none")) is None
    old = merkle.entries(df)
    now = df.withColumn("sha256", F.when(F.col("path") == "records/a/7.md", F.lit("f" * 64)).otherwise(F.col("sha256")))
    got = {r.path: r for r in merkle.entries(now, old).collect()}
    assert [p for p, r in got.items() if not r.reused] == ["records/a/7.md"]
    assert {p: r.entry for p, r in got.items()} == {r.path: r.entry for r in merkle.entries(now).collect()}
    forged = trie.prove(next(iter(entries)))
    forged["entry"][1] = "0" * 64 if forged["entry"][1] != "0" * 64 else "1" * 64
    with pytest.raises(ValueError):
        merkle.verify_proof(trie.root(), forged)
    assert merkle.portable("a/CON.txt") is None and merkle.portable("a/b.") is None and merkle.portable("cafe\u0301") == "caf\u00e9"
    rows = spark.createDataFrame([("a/B",), ("A/b",), ("x",), ("x/y",), ("ok/z",)], "path string")
    assert sorted(paths(merkle.collisions(rows), "alias")) == ["a/b", "x"]


def test_log_append_keeps_undated_and_repeated_entries(tmp_path):
    from datetime import datetime

    undated = "## [2026-02-30 10:00] update | records/y\n  as written\n\n"
    old = ["## [2026-01-05 08:00] create | records/x\nnote\n\n", "## [2026-01-06 08:00] update\n\n"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "2026-01.md").write_text("---\ntype: log\n---\n\n" + old[0])
    (tmp_path / "log.md").write_text("# Log\n\n" + old[0] + undated + old[0] + old[1])
    timeline.append(str(tmp_path), "create", None, "", datetime(2026, 2, 1, 8, 0))
    assert (tmp_path / "log.md").read_text() == "# Log\n\n" + undated + "## [2026-02-01 08:00] create\n\n"
    assert (tmp_path / "log" / "2026-01.md").read_text() == "---\ntype: log\n---\n\n" + old[0] + old[0] + old[0] + old[1]
    assert not (tmp_path / "log" / ".rotating").exists()
    # A writer that broke off between the archive and log.md is repeated without doubles.
    (tmp_path / "log" / ".rotating").write_text("")
    (tmp_path / "log.md").write_text("# Log\n\n" + old[0] + old[0] + old[1])
    timeline.append(str(tmp_path), "create", None, "", datetime(2026, 2, 1, 8, 0))
    assert (tmp_path / "log" / "2026-01.md").read_text() == "---\ntype: log\n---\n\n" + old[0] + old[0] + old[0] + old[1]
