"""Quality, toxicity, extraction and SentencePiece."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkspan.llm import extraction, pieces, quality, toxicity
from inkspan.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_words_follow_the_contract():
    texts = ["", " a  b\tc\r\nd ", "é x y", "one", None, "\x0b\x0c"]
    data, off = W.utf8(pa.array(texts))
    w = W.split(data, off)
    got = [[bytes(data[w.starts[k] : w.ends[k]]).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    import re

    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    h = W.hashes(w)
    assert len(set(h.tolist())) == len({x for g in got for x in g}) and int(h[0]) == W.hash_text("a")
    a, b = W.windows(np.array([5, 6, 5, 6, 5], W.U64), 2)
    assert a[0] == a[2] and a[1] == a[3] and a[0] != a[1] and b[0] == b[2]
    assert W.sliding(np.array([3, 1, 2, 5, 4]), 3, np.minimum).tolist() == [1, 1, 2]
    assert list(W.slices(np.array([0, 5, 5, 100, 101]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_quality_is_accurate_on_held_out_rows(spark):
    rows = quality.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_scores_equal_a_plain_fit(spark):
    """The same model fitted in plain numpy on sf0.001: class moments of the taught rows, shrunk, and the logistic line."""
    import zlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels_ = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = {}
    for k, t in texts.items():
        data, off = W.utf8(pa.array([t]))
        x[k] = quality.statistics(data, off)[0]
    taught = [k for k in labels_ if k in x and labels_[k] in (0, 1) and zlib.crc32(str(k).encode()) % 4 != 2]
    assert 30 < len(taught) < len(texts)
    y = np.array([labels_[k] for k in taught])
    m = np.stack([x[k] for k in taught])
    mean = np.stack([m[y == c].mean(0) for c in (0, 1)])
    scatter = np.stack([(m[y == c] - mean[c]).T @ (m[y == c] - mean[c]) for c in (0, 1)])
    pooled = scatter.sum(0) / (len(y) - 2)

    def density(v, c):
        cov = 0.8 * scatter[c] / ((y == c).sum() - 1) + 0.2 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
        d = v - mean[c]
        return np.log(((y == c).sum() + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    every = np.stack([x[k] for k in texts])
    margin = lambda v: np.clip(density(v, 1) - density(v, 0), -60, 60)
    # The line is fitted on the drawn rows, 95 % of few being all that the draw takes.
    share = min(1.0, 0.95 * 20_000 / len(taught))
    assert share == 1.0
    beta = quality.logistic(margin(m)[:, None] / 10, y.astype(float))
    want = dict(zip(texts, 1 / (1 + np.exp(-(max(beta[0], 0) / 10 * margin(every) + beta[1])))))
    got = {r.doc_id: (r.score, r.held_out, r.predicted) for r in quality.op1_quality(spark, sf).collect()}
    assert set(got) == set(want)
    for k, (score, held, predicted) in got.items():
        assert abs(score - want[k]) < 1e-6 and held == (zlib.crc32(str(k).encode()) % 4 == 2) and predicted == int(score >= 0.7)


def test_quality_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 50_000), (4, "x")]).withColumn("X", F.lit(1)).withColumn("ident", F.lit(2))
    none = labels(spark, [])
    got = quality.scores(d, none).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert quality.scores(d.limit(0), none).count() == 0
    some = labels(spark, [(2, 1, 0), (2, 0, 0), (3, 1, 0), (4, None, 0), (None, 1, 0), (1, 0, 0)])
    assert quality.accepted(d, some).columns == d.columns
    assert quality.Discriminant.fit(np.zeros((2, 23, 23))).score(np.zeros((1, 22)))[0] == 0.5


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(c, 1 + c, (400, 3)) for c in (0, 1)]
    total = np.stack([np.c_[np.ones(len(a)), a].T @ np.c_[np.ones(len(a)), a] for a in x])
    m = quality.Discriminant.fit(total, 0, 0)
    p = rng.normal(size=(5, 3))

    def density(c):
        cov = np.cov(x[c].T) + 1e-4 * np.eye(3)
        d = p - x[c].mean(0)
        return np.log(401 / 802) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    assert np.allclose(m.margin(p), density(1) - density(0))


def test_toxicity_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.85 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.02


def measured(text):
    s = toxicity.Scorer({})
    data, off = W.utf8(pa.array([text]))
    return s.measure(data, off)[0, 0]


def test_grammar_weighs_clauses():
    plain = measured("that idiot there.")
    assert plain > 0 and measured("you idiot.") > plain
    assert 0 < measured("not an idiot.") < plain and 0 < measured("she said idiot.") < plain
    assert measured("not that. an idiot.") == plain  # a negation ends with its clause
    assert measured("kill the process.") == 0 < measured("you we will kill.")
    # A threat's target may stand before it or after; denied and reported threats count less.
    aimed = np.expm1(measured("I will kill you."))
    assert aimed > 0 and np.isclose(np.expm1(measured("you I will kill.")), aimed) and np.isclose(np.expm1(measured("we will beat them.")), aimed)
    assert np.isclose(np.expm1(measured("you will not kill.")), 0.3 * aimed) and np.isclose(np.expm1(measured("I will not kill you.")), 0.3 * aimed)
    assert np.isclose(np.expm1(measured("she said you will kill.")), 0.5 * aimed) and np.isclose(np.expm1(measured("she said I will kill you.")), 0.5 * aimed)
    assert np.isclose(np.expm1(measured("she said you will not kill.")), 0.15 * aimed)
    assert measured("calm words only.") == 0 and measured("") == 0
    a = toxicity.Transducer(0, {(0, 1): (1, 2, 2.0)})
    b = toxicity.Transducer(0, {(0, 2): (0, toxicity.DONE, 3.0)})
    to, factor = toxicity.compose(a, b)
    assert factor[0, 1] == 6.0 and factor[to[0, 1], 1] == 0.0


def test_the_composed_machine_equals_its_parts_one_by_one():
    """Random clauses through each transducer in turn, symbol by symbol, and through the composed tables."""
    rng = np.random.default_rng(0)
    to, factor = toxicity.grammar()
    for clause in rng.integers(0, toxicity.END, (3000, 12)):
        parts = toxicity.parts()
        states = [p.start for p in parts]
        state = 0
        for symbol in clause.tolist():
            own, weight = symbol, 1.0
            for k, p in enumerate(parts):
                states[k], own, w = p.arcs.get((states[k], own), (states[k], own, 1.0))
                weight *= w
            assert np.isclose(factor[state, symbol], weight if own == toxicity.DONE else 0.0)
            state = to[state, symbol]


def test_toxicity_scores_equal_a_plain_reading(spark):
    """Every measure of sf0.001 again from words, clauses and transducers one by one."""
    import re

    scorer = toxicity.Scorer({W.hash_text("the"): 0.5})
    known = {int(k): (int(c), float(v)) for k, c, v in zip(scorer.keys, scorer.kind, scorer.value)}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        text = r.text.lower()
        data, off = W.utf8(pa.array([text]))
        sums, heaviest, matched, words = 0.0, 0.0, 0, 0
        for clause in re.split(r"[.,;:!?\n()\[\]|]", text):
            parts, total = toxicity.parts(), 0.0
            states = [p.start for p in parts]
            for word in re.findall(r"[a-zA-Z'\x80-\U0010ffff]+", clause):
                words += 1
                prefixes = [W.hash_text(word)] + [int(W.mix(np.array([W.hash_text(word[:k]) ^ k], W.U64))[0]) for k in (6, 5, 4) if len(word) > k]
                symbol, value = next((known[h] for h in prefixes if h in known), (0, 0.0))
                weight = 1.0
                for k, p in enumerate(parts):
                    states[k], symbol, w = p.step(states[k], symbol)
                    weight *= w
                total += weight * value if symbol == toxicity.DONE else 0.0
            sums, heaviest, matched = sums + total, max(heaviest, total), matched + (total > 0)
        assert np.allclose(scorer.measure(data, off)[0], [np.log1p(sums), heaviest, np.log1p(100 * matched / max(words, 1))])


def test_toxicity_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (2, "you idiot"), (None, "clean"), (3, "calm " * 50_000)]).withColumn("y", F.lit(1)).withColumn("X0", F.lit(1))
    got = {(r.doc_id, r.score) for r in toxicity.scores(d, labels(spark, [])).collect()}
    assert max(got, key=lambda x: x[1])[0] == 2 and len(got) >= 3
    assert toxicity.scores(d.limit(0), labels(spark, [])).count() == 0


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>x &amp; y&nbsp;z<br>w</p>", "x & y z w"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes", "yes"), ("<div><p>one, two, three</p></div><footer><p>foot, er, text</p></footer>", "one, two, three"),
    ("<article><h1>T</h1><p>Body, with words.</p><div class='comments'><p>Nice, very, nice, long, comment, with, commas</p></div></article>", "T\nBody, with words."),
    ("<article><header><h1>T</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "T\na\nb\nc\nd"),
    ("<nav><a href=x>menu</a></nav><div role='banner'>no</div><div id='cookie-notice'><p>We, use, cookies</p></div><main><p>m</p></main>", "m"),
])
def test_extraction_cases(page, want):
    assert extraction.main_text(page) == want


def test_extraction_picks_the_article_among_boxes():
    links = "".join(f"<li><a href='{k}'>Link number {k}, with a comma</a></li>" for k in range(30))
    body = "".join(f"<p>Paragraph {k}, with commas, and enough words to be counted as prose by length.</p>" for k in range(5))
    page = f"<body><div class='top'><ul>{links}</ul></div><div class='x'>{body}<p>Short.</p></div><div class='y'><p>Subscribe now</p></div></body>"
    assert extraction.main_text(page).split("\n") == [f"Paragraph {k}, with commas, and enough words to be counted as prose by length." for k in range(5)] + ["Short."]
    assert extraction.main_text("<div>" * 4000 + "deep" + "</div>" * 4000) == "deep"


@pytest.mark.parametrize("tag", ["h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "li", "dt", "dd", "th", "td", "caption", "figcaption", "summary", "center", "div", "section", "address"])
def test_every_block_with_text_is_main_text(tag):
    around = {"li": "ul", "dt": "dl", "dd": "dl", "th": "table", "td": "table", "caption": "table", "figcaption": "figure", "summary": "details"}.get(tag)
    own = f"<{tag}>Only this text</{tag}>"
    assert extraction.main_text(f"<body>{f'<{around}>{own}</{around}>' if around else own}</body>") == "Only this text"


def test_names_in_the_article_do_not_erase_it():
    page = ("<header><p>Site, of, ours</p></header><div class='notice'>We, use, cookies, here, and, there</div><article><h2 class='header'>Head</h2>"
            "<p class='legal analysis'>The court, it says, was right.</p><p class='notice'>A notice of appeal.</p><div class='ad'>Buy</div>"
            "<div class='widget'><a href='x'>More</a> <a href='y'>links</a></div><article class='comment'><p>First, comment</p></article></article>"
            "<article class='teaser'><p>Other, story</p></article>")
    assert extraction.main_text(page) == "Head\nThe court, it says, was right.\nA notice of appeal."


def test_the_score_chooses_between_articles():
    long = "".join(f"<p>Paragraph {k}, with commas, of the long story.</p>" for k in range(6))
    assert extraction.main_text(f"<main><article><p>Short one.</p></article><article>{long}</article></main>").startswith("Paragraph 0")
    assert extraction.main_text("<form><input><article><p>in a form</p></article></form>") == "in a form"
    assert extraction.main_text("<div><a href='a'>only</a> <a href='b'>links</a></div>") == "only links"


def test_generated_pages_give_their_article():
    """Pages of random parts, whose article is known block by block."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() + ("," if r.random() < 0.1 else "") for _ in range(n)) + "."
    for k in range(300):
        blocks, inner = [], []
        for _ in range(r.randint(1, 9)):
            kind, text = r.choice(["p", "p", "p", "h2", "blockquote", "ul", "pre", "table"]), prose(r.randint(1, 60))
            marked = text.replace(",", " &amp;", 1) if r.random() < 0.3 else text
            blocks.append(marked.replace("&amp;", "&"))
            wrap = {"ul": "<ul><li>{}</ul>", "table": "<table><tr><td>{}</table>"}.get(kind, f"<{kind}>{{}}</{kind}>")
            inner.append(wrap.format(marked.replace(" ", r.choice([" ", "\n  ", "&#32;"]), 1)))
            if r.random() < 0.3:
                inner.append(r.choice(["<div class='advert'>Buy, now, cheap</div>", "<script>if(a<b){'<p>x</p>'}</script>", "<!-- <p>old</p> -->",
                                       "<aside><p>Aside, of, the, story</p></aside>", "<form><label>Name</label><input></form>"]))
        if r.random() < 0.3:
            inner.append("<section id='comments'><h2>Comments</h2><p>" + prose(40) + "</p></section>")
        tag = r.choice(["article", "main", "div id='content'"])
        page = f"<html><head><title>T</title></head><body><nav><ul>{'<li><a href=x>menu</a>' * 9}</ul></nav><div class='cookie-notice'>{prose(20)}</div>"
        page += f"<{tag}>{''.join(inner)}</{tag.split()[0]}><div class='sidebar'><p>{prose(r.randint(3, 50))}</p></div><footer><p>{prose(30)}</p></footer></body></html>"
        assert extraction.main_text(page) == "\n".join(blocks), (k, page)


def test_a_long_page_is_read_whole():
    body = "".join(f"<div><p>Line {k}, of many.</p></div>" for k in range(160_000))
    page = f"<body><nav><a href=x>menu</a></nav><article>{body}</article></body>"
    assert len(page) > 5_000_000 and extraction.main_text(page) == "\n".join(f"Line {k}, of many." for k in range(160_000))


def test_extraction_query_and_edges(spark):
    got = extraction.op2_extraction(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) > 0 for r in got)
    d = spark.createDataFrame([(1, None, "t"), (1, "<p>a", "t"), (None, "<p>b", None)], "page_id long, html string, Text string")
    assert extraction.extract(d).columns == ["page_id", "html", "text"]
    assert [r.text for r in extraction.extract(d).orderBy("text").collect()] == ["", "a", "b"]
    assert extraction.extract(d.limit(0), text="out").count() == 0


def piece_model(pieces_, kind, **normal):
    """A model file written by hand: pieces with scores and types."""
    import struct

    def field(n, raw):
        return bytes([n << 3 | 2]) + varint(len(raw)) + raw

    def varint(v):
        out = b""
        while v > 127:
            out += bytes([v & 127 | 128])
            v >>= 7
        return out + bytes([v])

    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([t])) for p, s, t in pieces_)
    trainer = b"\x18" + bytes([kind]) + b"\x98\x02" + b"\x01"  # model type; byte fallback (field 35)
    norm = b"\x18" + bytes([normal.get("dummy", 1)]) + b"\x20" + bytes([normal.get("remove", 1)]) + b"\x28\x01"
    return body + field(2, trainer) + field(3, field(1, b"identity") + norm)


BASE = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]


@pytest.mark.parametrize("remove", [0, 1])
def test_unigram_model_in_parity(remove):
    raw = piece_model(BASE + [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -3.2, 1), ("▁ab", -4.0, 1), ("ba", -4.5, 1), ("▁a", -4.1, 1)], 1, remove=remove)
    c = pieces.Codec(raw)
    texts = ["", "ab", "abba ab", "  a  b ", "xyz é", "aab\nb", "bababab ab"]
    ids, ends, same = c.encode(texts)
    assert same.all() and [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == c.whole_reference.encode(texts)
    assert [t.decode() for t in c.decode(ids, ends)] == [c.whole_reference.decode(x) for x in c.whole_reference.encode(texts)]


def test_pieces_in_parity_and_round_trip():
    raw = open(pieces.MODEL, "rb").read()
    c = pieces.codec(raw)
    texts = ["", " ", "   a", "a   b    c", " " * 11 + "x", " " * 23, "\n\n a\n", "x\t\ty", "▁a▁▁b", "é漢字🙂 x", "\x00", "a" * 3000, "The " * 500, "<s> </s> <unk> <0x0A>"]
    ids, ends, same = c.encode(texts)
    assert same.all() and [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == c.whole_reference.encode(texts)
    back = [t.decode() for t in c.decode(ids, ends)]
    assert back == [t.replace("▁", " ") for t in texts]
    assert [c.whole.decode(x.ids) for x in c.whole.encode_batch(texts)] == back


def test_a_unigram_model_of_real_size_in_parity(spark, tmp_path):
    """8,000 pieces with scores by rule, from the words of the fixtures."""
    from collections import Counter

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    seen = Counter(w[i:j] for t in texts for w in set(("▁" + t.replace("\n", " ").replace(" ", " ▁")).split(" ")) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 6) + 1))
    pieces_ = [p for p, _ in seen.most_common(8000) if "\t" not in p]
    total = sum(seen[p] for p in pieces_)
    raw = piece_model(BASE + [(p, float(np.log(seen[p] / total)) - 1e-4 * k, 1) for k, p in enumerate(pieces_)], 1)
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    rows = pieces.encode(docs(spark, list(enumerate(texts))), model_path=str(path)).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert len(rows) == len(texts)
    for r in rows:
        right = sp.encode(texts[r.doc_id])
        assert r.parity == (list(r.ids) == right)
        # The other library adds scores in single precision over the whole text: nearly equal ways may differ, never for the worse here.
        assert r.parity or sum(map(sp.get_score, r.ids)) >= sum(map(sp.get_score, right)) > sum(map(sp.get_score, r.ids)) - 0.05
    assert np.mean([r.parity for r in rows]) > 0.95
    lines = [x for t in texts for x in t.split("\n") if len(x) < 200]
    ids, ends, same = pieces.Codec(raw).encode(lines)
    assert same.all() and len(lines) > 100


def test_a_chunk_that_differs_is_reported():
    class Other:
        def encode(self, texts, num_threads):
            return [[1] if "odd" in t else ids for t, ids in zip(texts, self.right.encode(texts))]

    c = pieces.Codec(open(pieces.MODEL, "rb").read())
    Other.right = c.part_reference
    c.part_reference = Other()
    ids, ends, same = c.encode(["plain words", "an odd one", "", "plain again"])
    assert same.tolist() == [True, False, True, True]
    assert ids[ends[1] : ends[2]].tolist() == c.whole_reference.encode("an odd one")


def test_pieces_operator(spark):
    d = docs(spark, [(1, None), (2, "hello there"), (2, "hello there"), (None, "é")]).withColumn("IDS", F.lit("x")).withColumn("Parity", F.lit(1))
    rows = pieces.encode(d)
    assert rows.columns == ["doc_id", "lang", "source", "n_chars", "ids", "parity"]
    back = {(r.doc_id, r.text) for r in pieces.decode(rows).collect()}
    assert back == {(1, ""), (2, "hello there"), (None, "é")}
    assert pieces.encode(d.limit(0)).count() == 0
    got = pieces.op8_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.round_trip and r.parity for r in got)
    import hashlib

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in got:
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.n_byte_tokens == sum(map(sp.is_byte, ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.text_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
