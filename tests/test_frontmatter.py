import json

from inkspan.sources import config as C
from inkspan.sources import frontmatter as fm
from inkspan.sources import timeline as tl
from store_fixture import DB


def test_split_states():
    assert fm.split("---\na: 1\n---\nbody")[:3] == (fm.OK, "a: 1\n", "body")
    assert fm.split("﻿--- \r\na: 1\r\n---\t\nb")[0] == fm.OK
    assert fm.split("---\na: 1\n")[0] == fm.OPEN
    assert fm.split("no")[0] == fm.NONE
    assert fm.split("---\n---\nx")[:3] == (fm.OK, "", "x")
    assert fm.split("---\na: 1\n---\nbody")[3] == 4
    assert fm.split("")[0] == fm.NONE


def test_yaml_dialect():
    got = fm.load("a: yes\nb: 2026-05-22\nc: 012\nd: 12:30:00\ne: 1e3\nf: 1234.00\ng: 12345678901234567890123\nh: null\ni: [[x]]\nj: true\nk: 7\n")
    assert got == {"a": "yes", "b": "2026-05-22", "c": "012", "d": "12:30:00", "e": 1000.0, "f": 1234.0, "g": "12345678901234567890123", "h": None, "i": "[[x]]", "j": True, "k": 7}
    assert fm.scalar(got["f"]) == "1234.0"
    assert fm.load("- a\n- b") is None and fm.load("a: [") is None and fm.load("a: 1\na: 2") is None and fm.load("") == {}
    assert fm.load("l:\n  - [[a]]\n  - [[b]]")["l"] == ["[[a]]", "[[b]]"]


def test_record_projection():
    r = fm.record("records/x/y.md", {"type": "t", "created": "2026-05-22", "updated": "2026-05-22T10:00:00-07:00", "tags": "one", "amount": 1.5, "deep": {"a": 1}, "l": [1, [True]]})
    assert r["created"] is None and r["updated"].hour == 17 and r["updated_raw"].endswith("-07:00")
    assert r["tags"] == ["one"] and r["summary"] == "(no summary)"
    assert json.loads(r["fields_json"]) == {"amount": 1.5, "deep": {"a": 1}, "l": [1, [True]], "meta-type": "fact"}
    assert [t["text"] for t in r["tokens"]["l"]] == ["1", "true"] and r["tokens"]["deep"] == []


def test_edges_and_fences():
    text = "---\nlinks:\n  - \"[[a/b]]\"\n---\né [[c/d|D]] [[ ./e\\f.md ]]\n~~~\n[[g/h]]\n```\n[[i/j]]\n~~~~\n[[k/l#x]] [[]] [[[m]]]\n"
    found = fm.edges(text)
    assert [e["dst_key"] for e in found] == ["a/b", "c/d", "e/f", "k/l#x", "m"][: len(found)]
    body = fm.split(text)[2].encode()
    for e in found:
        if e["region"] == "body":
            assert body[e["start"] : e["end"]].decode() == e["raw"]
    assert found[1]["alias"] == "D" and found[0]["region"] == "fm"
    assert fm.edges("[[cafe\u0301/x]]")[0]["dst_key"] == "caf\u00e9/x"


def test_sections_and_summaries():
    text = "---\na: 1\n---\n# Top\n\nIntro\n## One\nx\n### Deep\ny\n## Two ##\nz\n```\n## no\n```\n"
    s = fm.sections(text)
    assert [(x["heading"], x["level"]) for x in s] == [("One", 2), ("Deep", 3), ("Two", 2)]
    assert s[0]["body"].startswith("x\n### Deep") and s[0]["line"] == 7 and fm.first_h1(text) == "Top"
    assert fm.first_paragraph("# H\n\nTitle\n===\n\n```\ncode\n```\none\ntwo\n\nthree") == "one two"
    assert fm.render_template("{a} of {b} {c", {"a": "x", "b": ["[[p/q]]", "[[r|S]]"]}) == "x of q, S {c"
    assert fm.default_summary(None, {}, "w " * 300) == ("w " * 300)[:200]


def test_render_round_trip_and_rewrite():
    front = {"zeta": "[[a/b]]", "type": "t", "tags": ["x", "y"], "n": 1, "f": 2.5, "s": "12", "empty": None, "list": ["[[a/b|c]]", "d: e"]}
    text = fm.render(front, "body\n")
    assert fm.load(fm.split(text)[1]) == front
    assert list(fm.load(fm.split(text)[1]))[0] == "type" and list(fm.load(fm.split(text)[1]))[-1] == "tags"
    moved = fm.rewrite_links("x: \"[[a/b]]\"\n[[a/b.md|t]] [[a/bc]]\n```\n[[a/b]]\n```\n", "a/b", "n/m")
    assert moved == "x: \"[[n/m]]\"\n[[n/m|t]] [[a/bc]]\n```\n[[a/b]]\n```\n"


def test_config():
    c = C.parse(DB)
    assert c.frozen == ["records/notes/plan.md"] and c.ignored == ["temp"] and c.instructions == "Be brief."
    contact = c.schemas["contact"]
    spec = {f.name: f for f in contact.fields}
    assert spec["email"].required and spec["email"].shape == "email" and spec["company"].link_prefix == "records/companies/"
    assert spec["tier"].enum == ["gold", "silver"] and spec["country"].default == "NZ" and contact.unique == [["email"]]
    assert contact.summary_template == "{name} of {company}" and c.folders["records/companies"] == ("Firms", "who we work with")
    assert not c.problems
    assert {p[1] for p in C.parse("---\ntype: x\n---\n## Odd\n## Schemas\n### t\n- a\n- unique: a\n").problems} == {"CONFIG_BAD_TYPE", "CONFIG_MISSING_FIELD", "CONFIG_UNKNOWN_SECTION", "CONFIG_SCHEMA_FIELD"}


def test_log_text():
    t, kind, obj = tl.parse_header("## [2026-05-27 10:00] ingest | a/b")
    assert (t.year, kind, obj) == (2026, "ingest", "a/b")
    assert tl.parse_header("## [2026-13-27 10:00] x")[0] is None and tl.parse_header("## nope") is None
    entry = tl.render_entry(t, "note", None, "## [2026-01-01 00:00] fake\nplain")
    assert [(k, n) for _, k, _, n, _ in tl.parse_log(entry)] == [("note", "## [2026-01-01 00:00] fake\nplain")]
