import pytest
from pyspark.sql import functions as F

from inkspan.errors import StoreError
from inkspan.functions import documents as D
from inkspan.functions import link, match, path as P, shape, text as T, time as TM


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("fn,value,want", [
    (T.collapse_whitespace, " a \u00a0\tb\n", "a b"), (T.capitalize, "été", "Été"), (T.slug, "A b_C!/d", "a-b_c/d"), (T.heading_level, "### x", 3), (T.heading_level, "#x", 0),
    (T.heading_text, "## a # b ##", "a # b"), (T.lines, "a\r\nb\n", ["a", "b"]), (T.lines, "a", ["a"]), (T.sanitize, "a\x1b[31mb\x07c\td", "abc\td"),
    (T.normalize_extracted, "a  \r\n\n\n\nb", "a\n\nb\n"), (T.normalize_extracted, "\n", ""), (T.display_name, "records/hub-spot_x", "Hub spot x"),
    (link.canonical_target, " ./a\\b.md ", "a/b"), (link.canonical_target, "/x#f", "x#f"), (link.edge_key, "cafe\u0301", "caf\u00e9"),
    (P.type_folder, "records/a/2026/b.md", "records/a"), (P.type_folder, "records/b.md", None), (P.is_content, "records/a/_b.md", True), (P.is_content, "records/a/index.md", False),
    (P.is_content, "records/.a/b.md", False), (P.infer_type, "records/contacts/x.md", "contact"), (P.infer_type, "records/odd/x.md", "odd"), (P.media_type, "a/b.PDF", "application/pdf"),
    (P.is_safe, "a/../b", False), (P.is_safe, "a/b", True), (TM.year_month, "2026-5-01", "2026-05"), (TM.year_month, "2026-13", None), (shape.is_email, "mo@@host.org", False), (shape.is_email, " a@b..c ", True), (shape.is_currency, "+5", True), (shape.is_currency, "-$5", False), (shape.is_currency, "$ 1,2,3", True), (shape.is_url, " http://a b", True),
    (shape.is_email, "a@b.co", True), (shape.is_currency, "$1,234.56", True), (shape.is_currency, "USD 100", True), (shape.is_currency, "1e3", False), (shape.is_currency, "inf", False),
    (shape.is_url, "http://x", True), (shape.is_url, "https://", False), (shape.is_date, "2026-02-30", False), (shape.is_date, "2026-02-28", True), (shape.is_int, "12", True), (shape.is_int, "1.0", False),
    (shape.is_ulid, "01hzy8qv7m3c5d6e7f8g9hjkmn", True), (shape.is_bool, "true", True),
])
def test_expressions(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_strict_time(spark):
    rows = spark.createDataFrame([("2026-05-27T10:00:00Z",), ("2026-05-27T12:00:00.000+02:00",), ("2026-05-27",), ("x",)], "v string").select(TM.rfc3339(F.col("v")).alias("t")).collect()
    assert rows[0].t == rows[1].t and rows[2].t is None and rows[3].t is None
    assert TM.bound("2026-05-27").isoformat() == "2026-05-27T00:00:00+00:00"
    with pytest.raises(StoreError) as e:
        TM.bound("May")
    assert e.value.code == "BAD_TIMESTAMP" and e.value.exit_code == 2


def test_globs():
    import re

    ok = lambda g, p: bool(re.search(P.glob_regex(g), p))
    assert ok("records/*/x", "records/a/x.md") and not ok("records/*/x", "records/a/b/x.md")
    assert ok("records/**", "records/a/b.md") and ok("**/x.md", "x.md") and ok("a/**/**/b", "a/b") and ok("./a.b", "a.b") and not ok("a.b", "acb")
    assert ok("a/b?", "a/b?.md") and not ok("a/b?", "a/bc.md") and ok("a/**", "a.md") and ok("**", "x/y") and not ok("a/**", "ab/c")


def test_where_grammar():
    assert match.parse_where("a=b=c") == ("a", "b=c") and match.number("1d") is None and match.number(" 1 ") is None and match.number(".5e1") == 5.0
    with pytest.raises(StoreError):
        match.parse_where("ab")
    for bad in ("(?=x)", "(a)\\1", "("):
        with pytest.raises(StoreError):
            match.check_regex(bad)


def _zip(files):
    import io
    import zipfile

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_docx_xlsx_ods_epub_html():
    w = 'xmlns:w="http://w"'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>A &amp; b</w:t><w:tab/><w:t>c</w:t></w:r></w:p><w:p><w:r><w:t>d</w:t><w:br/><w:t>e</w:t></w:r></w:p></w:body></w:document>"})
    assert D.extract("x.DOCX", docx)["text"] == "A & b\tc\nd\ne\n"
    r = 'xmlns:r="http://r"'
    xlsx = _zip({
        "xl/workbook.xml": f'<workbook {r}><sheets><sheet name="S1" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><x Id="a" Target="worksheets/s.xml"/></R>',
        "xl/sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl/styles.xml": '<s><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></s>',
        "xl/worksheets/s.xml": '<ws><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.0</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" s="1"><v>45000</v></c></row></sheetData></ws>',
    })
    got = D.extract("x.xlsx", xlsx)
    assert got["text"] == "hi\t\t2\tTRUE\t2023-03-15\n" and got["metadata"] == {"sheets": "1", "sheet_names": "S1"}
    ods = _zip({"content.xml": '<o xmlns:t="t" xmlns:f="f"><t:table t:name="N"><t:table-row><t:table-cell f:value-type="float" f:value="3.0" t:number-columns-repeated="2"/><t:table-cell><t:p>x</t:p></t:table-cell></t:table-row></t:table></o>'})
    assert D.extract("x.ods", ods)["text"] == "3\t3\tx\n"
    epub = _zip({
        "META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p><title>T</title><item id="b" href="b%20c.xhtml"/><item id="a" href="a.xhtml"/><itemref idref="a"/><itemref idref="b"/></p>',
        "O/a.xhtml": "<h1>One</h1><p>x</p>", "O/b c.xhtml": "<p>Two</p>",
    })
    got = D.extract("x.epub", epub)
    assert got["text"] == "One\n\nx\n\nTwo\n" and got["metadata"] == {"chapters": "2", "title": "T"}
    assert D.extract("x.html", b"<ul><li>a<li>b</ul><script>no</script><ol><li>c</ol>")["text"] == "* a\n* b\n\n1. c\n"
    assert D.extract("x.xyz", b"")["error_code"] == "UNSUPPORTED_FORMAT" and D.extract("x.docx", b"junk")["error_code"] == "EXTRACT_PARSE_ERROR"
    assert D.extract("x.html", b"<div>" * 3000)["error_code"] == "EXTRACT_PARSE_ERROR"
    assert D.extract("x.docx", _zip({"word/document.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'}))["error_code"] == "EXTRACT_PARSE_ERROR"


def test_a_document_that_takes_too_long_or_too_much_fails_alone(monkeypatch):
    import time

    def large(raw):
        return "x" * (8 << 30), {}

    monkeypatch.setitem(D.READERS, "large", large)
    with pytest.raises(D.ExtractError) as e, D.guarded(0.1):
        time.sleep(5)
    assert e.value.code == "EXTRACT_TIMEOUT"
    assert D.extract("x.large", b"")["error_code"] == "EXTRACT_RESOURCE_LIMIT"
    assert D.extract("x.html", b"<p>a")["text"] == "a\n"


def test_splitting_is_linear_and_keys_are_known():
    import time

    from inkspan.sources import frontmatter as fm

    start = time.perf_counter()
    assert fm.split("---\n" + "a: b\n" * 400_000)[0] == fm.OPEN
    assert time.perf_counter() - start < 5
    assert fm.split("---\na: 1\n---") == (fm.OK, "a: 1\n", "", 4) and fm.split("---") == (fm.OPEN, None, "---", 1) and fm.split("---\n---\nx") == (fm.OK, "", "x", 3)
    text = "---\na: x\nb:\n  - \"[[r/x]]\"\nc: [[r/y]]\nsummary: see [[r/z|Z]]\nd: [[[a]], [[b]]]\n---\n[[r/w]]\n"
    assert [(e["key"], e["target"]) for e in fm.edges(text)][:3] == [("b", "r/x"), ("c", "r/y"), ("summary", "r/z")] and fm.edges(text)[-1]["key"] is None
    assert fm.link_fields(fm.split(text)[1]) == [("summary", "r/z", "Z"), ("b", "r/x", None), ("c", "r/y", None)]


def test_configuration_doubts():
    from inkspan.sources import config as C

    text = "---\ntype: store\nscope: s\nowner: o\n---\n## Schemas\n### t\n- a (required, requierd)\n- a\n- (string)\n- unique: a, b\n"
    assert [(s, line) for s, c, line, _ in C.parse(text).problems] == [("warning", 7), ("warning", 7), ("info", 7), ("warning", 7)] or len(C.parse(text).problems) == 4
    assert C.parse(text.replace("type: store", "type: other"), "other").problems == C.parse(text).problems


def _pdf(*streams, fonts=b"", extra=b"", deflated=True):
    """A file of one page a stream."""
    import zlib

    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(streams)))
    out = [b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + kids + b"] /Count 9 /Resources << /Font << " + fonts + b" >> >> >>\nendobj\n", extra]
    for k, s in enumerate(streams):
        body = zlib.compress(s) if deflated else s
        out.append(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n" % (10 + 2 * k, 11 + 2 * k))
        out.append(b"%d 0 obj\n<< /Length %d %s >>\nstream\n" % (11 + 2 * k, len(body), b"/Filter /FlateDecode" if deflated else b"") + body + b"\nendstream\nendobj\n")
    return b"".join(out) + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("deflated", [True, False])
def test_pdf_text(deflated):
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange endcmap"
    fonts = b"/F1 << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> /F2 5 0 R /F3 << /Subtype /Type1 /Encoding << /Differences [65 /eacute /uni00E9 /three] >> >>"
    extra = b"5 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >> endobj 6 0 obj << /Length %d >> stream\n" % len(cmap) + cmap + b"\nendstream endobj\n"
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\) \\351) Tj 0 -14 Td [(sp) -300 (aced) 10 (out)] TJ T* (next) Tj ET"
    two = b"BT /F2 9 Tf 1 0 0 1 10 20 Tm <000100020010> Tj 1 0 0 1 60 20 Tm <0012> Tj 1 0 0 1 10 5 Tm <0011> Tj ET BT /F3 9 Tf (ABC) Tj ET"
    raw = _pdf(one, two, fonts=fonts, extra=extra, deflated=deflated)
    got = D.extract("x.pdf", raw)
    assert got["error_code"] is None and got["metadata"] == {"pages": "2"}
    assert got["text"] == "Hello (world) é\nsp acedout\nnext\n\nAfia c\nb\néé3\n"
    assert D.extract("x.pdf", b"junk")["error_code"] == "EXTRACT_PARSE_ERROR"
    assert D.extract("x.pdf", raw.replace(b"trailer\n<<", b"trailer\n<< /Encrypt 99 0 R"))["error_code"] == "DOCUMENT_ENCRYPTED"
    assert D.extract("x.pdf", _pdf(b"q 1 0 0 1 0 0 cm Q"))["text"] == ""


def test_pdf_object_streams_predictors_and_forms():
    import zlib

    from inkspan.functions import pdf as P

    body = b"1 0 2 37 << /Type /Catalog /Pages 2 0 R >>     << /Type /Pages /Kids [3 0 R] >>"
    first = body.index(b"<<")
    body = b"1 0 2 %d " % (body.index(b"<< /Type /Pages") - first) + body[first:]
    first = body.index(b"<<")
    packed = zlib.compress(body)
    form = b"BT (inner) Tj ET"
    raw = (b"%PDF-1.7\n9 0 obj << /Type /ObjStm /N 2 /First " + str(first).encode() + b" /Filter /FlateDecode /Length " + str(len(packed)).encode() + b" >> stream\n" + packed + b"\nendstream endobj\n"
           b"3 0 obj << /Type /Page /Contents [4 0 R] /Resources << /XObject << /X 7 0 R >> >> >> endobj\n4 0 obj << /Length 5 0 R >> stream\nBT (outer) Tj ET /X Do\nendstream endobj\n5 0 obj 22 endobj\n"
           b"7 0 obj << /Type /XObject /Subtype /Form /Length " + str(len(form)).encode() + b" >> stream\n" + form + b"\nendstream endobj\n%%EOF")
    assert P.text(raw) == ("outer\ninner", 1)
    rows = b"".join(bytes([k]) + bytes([10, 20, 30]) for k in (0, 1, 2, 3, 4))
    assert len(P._predicted(rows, 3)) == 15 and P._predicted(rows, 3)[:6] == bytes([10, 20, 30, 10, 30, 60])
    loop = _pdf(b"/X Do", extra=b"8 0 obj 8 0 R endobj\n")
    assert P.text(loop)[0] == ""
