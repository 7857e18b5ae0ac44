"""Substring dedup, near-duplicates, neighbours, mixing, WARC, Matroska and the pipeline, against brute force."""

import itertools
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from inkspan.llm import common, matroska, mixing, nearby, neighbours, registry, similar, substrings, warc
from inkspan.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i is None or i % 7 else None, None if t is None else len(t)) for i, t in rows], DOCS)


def sample(seed=1):
    """Copies, near copies, shared passages, empty, null and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows = [(k, " ".join(word() for _ in range(r.randint(0, 150)))) for k in range(60)]
    passage = " ".join(word() for _ in range(60))
    rows += [(100 + k, f"{rows[k][1]}\n{passage} {word()}") for k in range(10)]
    rows += [(200 + k, rows[40][1]) for k in range(30)]
    for k in range(30):
        w = rows[41][1].split() or ["x"]
        w[r.randrange(len(w))] = word()
        rows.append((300 + k, "  ".join(w)))
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "x " * 200), (5, rows[5][1]), (None, "lonely words here"), (None, None), (404, "One TWO"), (405, "one two")]
    return rows


def test_substrings_equal_brute_force(spark):
    rows = sample()
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (i, _), w in zip(rows, words):
        gone = {k for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    d = docs(spark, rows).withColumn("KEY", F.lit("k")).withColumn("spans", F.lit(1))
    got = [(r.doc_id, r.sub_words, r.sub_removed, r.sub_kept) for r in substrings.remove_repeated(d).collect()]
    assert Counter(got) == Counter(want)
    kept = substrings.without_repeated(d)
    assert kept.columns == d.columns
    whole = {(i, t) for (i, t), (_, _, n, _) in zip(rows, want) if not n and t is not None}
    assert whole <= {(r.doc_id, r.text) for r in kept.collect()}
    assert substrings.remove_repeated(d.limit(0)).count() == 0


@pytest.mark.parametrize("flush", [7, 100])
def test_texts_cut_over_flushes_lose_all_repeats(spark, monkeypatch, flush):
    monkeypatch.setattr(substrings, "FLUSH", flush)
    r = random.Random(flush)
    long = [f"w{r.randrange(10**6)}" for _ in range(500)]
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join(long[200:320]) + " end"), (4, " ".join(long[:150] + ["mid"] + long[150:]))]
    got = {r.doc_id: (r.sub_removed, r.sub_kept) for r in substrings.remove_repeated(docs(spark, rows)).collect()}
    assert got == {1: (500, ""), 2: (500, ""), 3: (120, "end"), 4: (500, "mid")}


def test_windows_of_just_enough_words(spark):
    """34 repeated words stay, 35 and 36 go; so do all but the last windows of a long text that repeats itself."""
    word = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [word(34, 34), word(34, 34) + " end", word(35, 35), "start " + word(35, 35), word(36, 36) + " a", word(36, 36) + " b", "z " * 100_000, word(1, 20)]
    got = {r.doc_id: (r.sub_words, r.sub_removed) for r in substrings.remove_repeated(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: (34, 0), 1: (35, 0), 2: (35, 35), 3: (36, 35), 4: (37, 36), 5: (37, 36), 6: (100_000, 100_000), 7: (20, 0)}
    assert substrings.remove_repeated(docs(spark, []), keep=["doc_id"]).count() == 0


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_merged_sketches_never_underestimate(most):
    """Every anchor that stands at two places, in one partition or in two, is estimated repeated."""
    r = random.Random(7)
    texts = [" ".join(f"v{r.randrange(4000)}" for _ in range(r.choice([10, 50, 300]))) for _ in range(60)]
    texts += [texts[3] + " tail", "head " + texts[5], texts[8]]
    cells, rows = 1 << 16, {}
    for part in (texts[:30], texts[30:]):
        for b in substrings._sketch(cells, 35, most)(iter([pa.record_batch([pa.array(part)], names=["text"])])):
            for k in range(b.num_rows):
                rows.setdefault(b.column(0)[k].as_py(), []).append(b.slice(k, 1))
    bits = bytearray(2 * cells // 8)
    for block, own in rows.items():
        merged = substrings._merge(pa.Table.from_batches(own)).column("cells")[0].as_py()
        bits[block * substrings.BLOCK // 8 : (block + 1) * substrings.BLOCK // 8] = merged
    twice = np.unpackbits(np.frombuffer(bytes(bits), np.uint8))
    places = Counter()
    for t in texts:
        data, off = W.utf8(pa.array([t]))
        w = W.split(data, off)
        starts, least, sub = substrings._anchored(W.hashes(w), w.first, 35)
        places.update({int(h): int((sub == h).sum()) for h in np.unique(least)})
    repeated = np.array([h for h, n in places.items() if n > 1], np.uint64)
    single = np.array([h for h, n in places.items() if n == 1], np.uint64)
    x, y = substrings._cells(repeated, cells)
    assert len(repeated) > 20 and twice[x].all() and twice[y].all()
    x, y = substrings._cells(single, cells)
    assert (twice[x] & twice[y]).mean() < 0.05


def fingerprint(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    c = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * c[b] > len(runs)) if runs else 0


def reachable(v, bits):
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= bits):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(v))]


def test_nearby_equals_brute_force(spark):
    rows = sample()
    v = np.array([fingerprint(t) for _, t in rows], np.uint64)
    comp = reachable(v, 3)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{int(f):016x}", least.get(c)) for (i, _), f, c in zip(rows, v, comp))
    d = docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("ROOT", F.lit(1))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in nearby.near_duplicates(d).collect()) == want
    assert nearby.near_duplicates(d.limit(0)).count() == 0
    kept = nearby.without_near_duplicates(d)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(set(least.values()))


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_links_of_fingerprints(spark, bits):
    r = random.Random(bits)
    v = {r.getrandbits(64) for _ in range(300)}
    for x in list(v)[:40]:
        for _ in range(12):
            for b in r.sample(range(64), r.randint(1, bits + 2)):
                x ^= 1 << b
            v.add(x)
    v = np.array(sorted(v), np.uint64)
    want = reachable(v, bits)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in common.components(nearby.links(df, bits)).collect()}
    got = [roots.get(int(x), int(x)) for x in v.view(np.int64)]
    assert Counter(Counter(want).values()) == Counter(Counter(got).values())
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_lists_give_the_same_forest_in_blocks_and_by_masks(monkeypatch):
    rng = np.random.default_rng(0)
    fp = np.unique((np.uint64(5) << np.uint64(40)) | rng.integers(0, 1 << 24, 3000).astype(np.uint64))
    a = nearby._forest(fp, 3)
    monkeypatch.setattr(nearby, "comb", lambda n, k: 0)
    b = nearby._forest(fp, 3)
    assert len(a[0]) == len(b[0]) > 0 and set(a[1]) == set(b[1])


@pytest.mark.parametrize("bits", range(7))
def test_linked_pairs_meet_under_some_key(bits):
    """Whatever ``8 - bits`` positions a pair shares, a key's bytes are all among them, and so are a longer key's that extends it."""
    short, long = nearby.runs(bits), nearby.runs(bits, True)
    for shared in itertools.combinations(range(8), 8 - bits):
        own = [at for at in short if set(at) <= set(shared)]
        assert own and all(any(set(at) <= set(more) <= set(shared) for more in long) for at in own)


def test_the_tally_drops_pairs_that_meet():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    fp = np.unique(np.concatenate([fp, fp[:2000] ^ rng.integers(0, 1 << 40, 2000).astype(np.uint64), fp[:500] ^ np.uint64(1 << 9 | 1 << 33)]))
    lists = {}
    for batch in nearby._postings(3)(iter([pa.record_batch([pa.array(fp.view(np.int64))], names=["fp"])])):
        for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)):
            lists.setdefault(key, []).append(x)
    met = np.array(sorted({(a, b) for own in lists.values() for a, b in itertools.combinations(sorted(own), 2)}), np.uint64)
    counted = nearby.tallied(met[:, 0], met[:, 1], 3)
    assert 1500 < len(met) and counted.sum() < len(met) / 2
    assert {tuple(x) for x in met[nearby.linked(met[:, 0], met[:, 1], 3)]} == {
        (a, b) for i, a in enumerate(fp) for b in fp[i + 1 :][np.bitwise_count(fp[i + 1 :] ^ a) <= 3]}


def test_a_hot_list_is_split_and_loses_no_link(spark, monkeypatch):
    """Half of all fingerprints share four bytes: their lists pass on under longer keys."""
    rng = np.random.default_rng(2)
    fp = np.concatenate([rng.integers(0, 1 << 28, 1500), rng.integers(0, 1 << 62, 1500)]).astype(np.uint64)
    fp = np.unique(np.concatenate([fp, fp[::3] ^ np.uint64(5), fp[::7] ^ np.uint64(1 << 20 | 1 << 11)]))
    want = reachable(fp, 3)
    monkeypatch.setattr(nearby, "LOCAL", 20)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in common.components(nearby.links(df, 3)).collect()}
    got = [roots.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got)) < len(fp)


@pytest.mark.parametrize("rows", [1, 50, 1 << 17])
def test_sorted_lists_come_whole_or_pass_through(rows):
    r = random.Random(rows)
    given = sorted((k, r.randrange(100)) for k in range(30) for _ in range(r.choice([1, 3, 9, 10, 80])))
    batches = [pa.record_batch([pa.array([k for k, _ in given[i : i + 13]], pa.int64()), pa.array([v for _, v in given[i : i + 13]], pa.int64())], names=["k", "v"])
               for i in range(0, len(given), 13)]
    sizes = Counter(k for k, _ in set(given))
    out = []
    for key, value, long in common.sorted_lists(iter(batches), 9, rows):
        assert all((sizes[k] > 9) == long for k in key.tolist())
        if not long:
            assert all((key == k).sum() == sizes[k] for k in set(key.tolist()))
        out += list(zip(key.tolist(), value.tolist()))
    assert sorted(out) == sorted(set(given))


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7000, 7001), (7001, 7000), (5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[1000 + k] == 1000 for k in range(50)) and got[7001] == 7000
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_share_a_class(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, sets = [], []
    for g in range(12):
        base = [word() for _ in range(r.choice([40, 120, 300, 700]))]
        for _ in range(4):
            w = list(base)
            for _ in range(len(w) // 100):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(900, ""), (901, None), (902, "tiny"), (903, "TINY"), (None, "tiny"), (0, rows[0][1])]
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    d = docs(spark, rows)
    got = {r.ident: r.component_id for r in similar.similar_classes(d).collect()}
    for (i, _), a in zip(rows, sets):
        for (j, _), b in zip(rows, sets):
            if i is not None and j is not None:
                alike = len(a & b) / len(a | b)
                assert alike < 0.8 or got[i] == got[j], (i, j, alike)
                assert alike > 0.05 or got[i] != got[j], (i, j, alike)
    assert got[901] == 900 and got[903] == 902
    kept = [x.doc_id for x in similar.without_similar(d).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(got[i] for i in got if i is not None)) and None in kept
    assert similar.similar_classes(d.limit(0)).count() == 0


def alike_sets(texts):
    """Components of texts by brute force: the exact Jaccard similarity of five-word shingles is 0.8 or more."""
    ids, sets = {}, []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(sorted({ids.setdefault(tuple(w[k : k + 5]), len(ids)) for k in range(max(1, len(w) - 4))}))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        seen = Counter(j for x in s for j in where.get(x, ()))
        for j, both in seen.items():
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            where.setdefault(x, []).append(i)
    return [find(i) for i in range(len(sets))]


def edited(r, base, edits):
    w = list(base)
    for k in r.sample(range(len(w)), edits):
        w[k] = f"e{r.randrange(10**9)}"
    return " ".join(w)


def test_similar_classes_equal_brute_force_near_the_line(spark):
    """Short texts and pairs on both sides of 0.8, each pair on its own."""
    r = random.Random(5)
    texts = []
    for n in [5, 6, 8, 9, 10, 13, 20] * 8 + [49, 94, 184, 400] * 25:
        base = [f"w{r.randrange(10**9)}" for _ in range(n)]
        less = max(1, (n - 4) // 9)
        for other in (edited(r, base, max(1, n // 50)), " ".join(base[: n - less]), " ".join(base[: n - (n - 4) // 5]), " ".join(base[: n - (n - 4) // 5 - 1])):
            own = [f"{w}x{len(texts)}" for w in base]
            texts += [" ".join(own), " ".join(f"{w}x{len(texts)}" if w in base else w for w in other.split())]
    want = alike_sets(texts)
    got = {x.ident: x.component_id for x in similar.similar_classes(docs(spark, list(enumerate(texts)))).collect()}
    assert 100 < sum(w != i for i, w in enumerate(want)) < len(texts) // 2
    assert [got[i] for i in range(len(texts))] == want


def test_large_groups_of_copies_equal_brute_force(spark):
    """Thousands of copies edited each on its own; the text that joins them is one of them, or there is none."""
    r = random.Random(6)
    base, lost = ([f"w{r.randrange(10**9)}" for _ in range(124)] for _ in range(2))
    texts = [edited(r, base, r.choice([2, 2, 2, 3, 4])) for _ in range(2500)]
    texts.insert(1700, " ".join(base))
    texts += [edited(r, lost, r.choice([1, 2, 3])) for _ in range(400)]
    want = alike_sets(texts)
    got = {x.ident: x.component_id for x in similar.similar_classes(docs(spark, list(enumerate(texts)))).collect()}
    assert max(Counter(want).values()) > 1500 and len(set(want)) > 20
    assert [got[i] for i in range(len(texts))] == want


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 24))
    x = centre[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x[100:160] = x[7]  # one vector many times
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [float("inf")] * 24), (5004, [1.0, None] * 12), (None, [1.0] * 24), (5005, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("V", F.lit(1))
    got = {}
    for r in neighbours.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(abs(s - float(x[v] @ x[q])) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    longer = spark.createDataFrame([*rows[:40], (9000, [1.0] * 99)], "vec_id long, embedding array<double>")  # a longer vector empties nothing
    assert neighbours.search(longer, longer).count() == 40 * 20
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")
    assert neighbours.search(few, few).count() == 20 and neighbours.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = c.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = Counter(tuple(plain(dict(zip(names, r))[k]) for k in cols) for r in found.fetchall())
    assert Counter(tuple(plain(r[k]) for k in cols) for r in df.collect()) == want


def test_mixing_targets_and_edges(spark):
    rows = sample(2)
    d = docs(spark, rows).withColumn("SIZE", F.lit(1)).withColumn("Mix_Size", F.lit(1))
    out = mixing.mix(d).collect()
    assert len(out) == len(rows)
    taken, target, most = Counter(), {}, Counter()
    for r in out:
        assert 0 <= r.mix_repeats <= 2
        taken[r.source] += r.mix_repeats * r.mix_size
        target[r.source] = r.mix_target
        most[r.source] = max(most[r.source], r.mix_size)
    total = sum(r.mix_size for r in out)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert mixing.mixed(d).count() == sum(r.mix_repeats for r in out) and mixing.mixed(d).columns == d.columns
    assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, out))
    assert mixing.mix(d.limit(0)).count() == 0
    plan = "".join(mixing.mix(d)._jdf.queryExecution().executedPlan().toString())
    assert "Python" not in plan and "Arrow" not in plan


def test_warc_round_trip_with_segments_and_revisits(spark, tmp_path):
    big = "".join(random.Random(1).choice("abc é\r\n") for _ in range(70_000))
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://c", "<p>" + "0\r\n\r\n" * 3000), (6, "x", "one"), (6, "x", "one"), (None, "x", "null id"), (None, "y", "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Digest", F.lit(1))
    archives = common.written(warc.write_archives(df, segment=1000, archive=5000))
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(re.match(r"<urn:page:(-?\d*):", r.record_id)[1], []).append(r)
    assert bytes(by["2"][0].payload).decode() == big and by["1"][0].record_type == "revisit" and by["1"][0].refers_to.startswith("<urn:page:2:")
    assert by["3"][0].record_type == "revisit" and by["4"][0].payload_bytes == 0 and bytes(by["5"][0].payload).decode() == rows[4][2]
    assert [r.record_type for r in by["6"]] == ["response", "response"] and sorted(r.record_type for r in by[""]) == ["response", "revisit"]
    # The same from files on disk, by Spark's own reader.
    for r in archives.collect():
        (tmp_path / r["name"]).write_bytes(bytes(r.content))
    assert warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).count() == len(rows)
    assert warc.write_archives(df.limit(0)).count() == 0


def test_warc_damage_is_noticed():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for raw in (b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc"):
        with pytest.raises(warc.Damaged):
            warc.unchunked(raw)
    assert warc.joined([(2, 6, b"def"), (1, None, b"abc")]) == b"abcdef"
    for parts in ([(1, None, b"abc"), (3, 6, b"def")], [(1, None, b"abc"), (2, 7, b"def")], [(1, None, b"abc"), (2, None, b"def")]):
        with pytest.raises(warc.Damaged):
            warc.joined(parts)
    with pytest.raises(warc.Damaged):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_matroska_round_trips_every_lacing():
    r = random.Random(0)
    for n in (0, 1, 576, 577, 5000, 576 * 9, 576 * 600 + 3):
        raw = r.randbytes(n)
        for lacing in (matroska.XIPH, matroska.EBML_LACING, matroska.FIXED):
            payload = matroska.padded(raw) if lacing == matroska.FIXED else raw
            file = matroska.mux(payload, lacing=lacing)
            media = matroska.parse(file)
            assert matroska.track_bytes(file, media) == payload and media.tracks == {1: "A_PCM/INT/LIT"}
            assert len(media.cues) == len(media.clusters) and all(dict(media.clusters)[p] == t for t, _, p in media.cues)


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.EBML_LACING, matroska.FIXED])
def test_laced_packets_follow_each_other(lacing):
    """576 samples at 8000 a second last 72 ms, in a lace and across blocks and clusters."""
    media = matroska.parse(matroska.mux(matroska.padded(bytes(576 * 300)), lacing=lacing))
    assert [p[1] for p in media.packets] == [k * 72_000_000 for k in range(300)]
    assert media.durations == {1: 72_000_000}


def test_a_block_group_states_how_long_its_lace_lasts():
    e, i = matroska.element, matroska.integer
    laced = b"\x81" + b"\x00\x00" + bytes([matroska.FIXED << 1]) + b"\x03" + b"abcd"
    cluster = e(matroska.CLUSTER, i(matroska.TIME, 10) + e(matroska.GROUP, e(matroska.INNER, laced) + i(matroska.BLOCK_DURATION, 8)))
    media = matroska.parse(matroska._HEAD + e(matroska.SEGMENT, cluster))
    assert [p[1] for p in media.packets] == [10_000_000, 12_000_000, 14_000_000, 16_000_000]


def test_matroska_unknown_sizes_groups_and_damage():
    e, i = matroska.element, matroska.integer
    block = b"\x82" + b"\x00\x05" + b"\x00" + b"data"
    cluster = i(matroska.TIME, 10) + e(matroska.GROUP, e(matroska.INNER, block) + i(matroska.REFERENCE, 1))
    unknown = lambda ident, body: ident.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    tracks = e(matroska.TRACKS, e(matroska.ENTRY, i(matroska.NUMBER, 2) + e(matroska.CODEC, b"X")))
    file = matroska._HEAD + unknown(matroska.SEGMENT, tracks + unknown(matroska.CLUSTER, cluster) + e(matroska.CLUSTER, i(matroska.TIME, 20) + e(matroska.BLOCK, block)))
    media = matroska.parse(file)
    assert [(t, s, n, k) for t, s, _, n, k in media.packets] == [(2, 15_000_000, 4, False), (2, 25_000_000, 4, False)] and media.tracks == {2: "X"}
    good = matroska.mux(matroska.padded(b"x"))
    for raw in (b"", b"\x00", good[:50], good[:-1], b"RIFF" * 9):
        with pytest.raises(matroska.Malformed):
            matroska.parse(raw)


def test_matroska_operator(spark):
    d = docs(spark, [(1, None), (2, "é" * 1000), (2, "é" * 1000)]).withColumn("Media", F.lit(1))
    files = matroska.media_column(d)
    assert files.columns == ["doc_id", "text", "lang", "source", "n_chars", "media"]
    table = matroska.packet_table(files, "doc_id").collect()
    assert Counter(r.doc_id for r in table) == {1: 1, 2: 8} and all(r["size"] == 576 and r.track == 1 for r in table)
    bad = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"")], "doc_id long, media binary")
    assert [(r.doc_id, r.error is not None) for r in matroska.packet_table(bad, "doc_id").collect()] == [(1, True)]
    got = matroska.op7_matroska(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    import hashlib
    import zlib

    for r in got:
        p = matroska.padded(texts[r.doc_id].encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.n_bytes) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(texts[r.doc_id].encode()))


def test_pipeline_equals_its_stages_on_fixtures(spark, tmp_path):
    """Each stage against a plain statement of what it keeps, on one small folder of tables."""
    import corpus_pipeline
    import sentencepiece

    from inkspan.llm import pieces, quality

    for t in ("documents", "labels"):
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    here = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    names = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, here = here, common.written(stage(spark, here, str(tmp_path)))
        names.append(name)
        assert here.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if len(names) == 1:
            good = {r.doc_id for r in quality.scores(before, spark.read.parquet(str(tmp_path / "labels.parquet"))).filter("score >= 0.7").collect()}
            assert {r.doc_id for r in here.collect()} == good
        elif len(names) == 2:
            rows = before.orderBy("doc_id").collect()
            assert {r.doc_id for r in here.collect()} == {rows[c].doc_id for c in alike_sets([r.text for r in rows])}
        elif len(names) == 3:
            want = {r.doc_id: (r.sub_removed, r.sub_kept) for r in substrings.remove_repeated(before).collect()}
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id: r.text for r in here.collect()} == {k: s if n else texts[k] for k, (n, s) in want.items()}
            assert all(r.n_chars == len(r.text) for r in here.collect())
        else:
            want = {r.doc_id: r.mix_repeats for r in mixing.mix(before).collect() if r.mix_repeats}
            assert Counter(r.doc_id for r in here.collect()) == Counter(want)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in here.collect()}
    got = corpus_pipeline.STAGES[4][1](spark, here, str(tmp_path)).collect()
    assert len(got) == here.count() and all(list(r.ids) == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_near_dedup_stage_keeps_what_brute_force_keeps(spark):
    """Documents of the fixtures, short texts, pairs on both sides of 0.8 and a group longer than is paired at once."""
    import corpus_pipeline

    r = random.Random(8)
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    for n in [5, 8, 9, 13] * 5 + [49, 94, 400] * 10:
        base = [f"w{r.randrange(10**9)}" for _ in range(n)]
        texts += [" ".join(base), " ".join(base[: n - (n - 4) // 5 - r.randrange(2)])]
    base = [f"w{r.randrange(10**9)}" for _ in range(124)]
    texts += [edited(r, base, 2) for _ in range(3 * similar.PAIRED)] + [" ".join(base)]
    kept = corpus_pipeline.deduplicate(spark, docs(spark, list(enumerate(texts))), SF)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(alike_sets(texts)))


def test_word_sums():
    assert W.per_row(np.array([1, 2, 3]), np.array([0, 2, 2, 3])).tolist() == [3, 0, 3]
    assert W.distinct_per_row(np.array([1, 1, 2], W.U64), np.array([0, 2, 3])).tolist() == [1, 1]


def test_written_tables_can_be_deleted(spark):
    common.forget_written(spark)
    df = common.written(spark.range(3))
    assert df.count() == 3 and common.forget_written(spark) == 1 and common.forget_written(spark) == 0


def _folder(tmp_path, spark, rows, labels):
    spark.createDataFrame(rows, DOCS + ", TEXT_ string, ident string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_takes_nulls_repeats_extra_columns_and_long_texts(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    prose = lambda n: " ".join(r.choice("the of and to in is that for with as on by house river green walks slowly under evening light".split()) for _ in range(n)) + "."
    rows = [(k, prose(r.randint(5, 200)), "en", f"s{k % 4}" if k % 9 else None, 1, "x", "y") for k in range(150)]
    rows += [(150, None, "en", "s1", None, None, None), (151, "", None, None, 0, "x", None), (152, "", "en", "s1", 0, None, "y"), (None, prose(30), "en", "s2", 1, "x", "y"), (None, prose(31), None, None, 1, "x", "y")]
    rows += [rows[3], rows[3], (400, prose(60_000), "en", "s3", 1, "x", "y"), (401, rows[5][1], "en", "s0", 1, "x", "y")]
    labels = [(k, k % 2, 0) for k in range(0, 150, 2)] + [(3, None, 0), (None, 1, 0), (5, 0, 0), (5, 1, 0)]
    sf = _folder(tmp_path, spark, rows, labels)
    here = spark.read.parquet(sf + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        before, here = here, common.written(stage(spark, here, sf))
        assert here.columns == before.columns, name
        if name == "SimHash near-dedup":
            ids = [x.doc_id for x in here.collect()]
            assert ids.count(None) == 2 and ids.count(3) == 1 and 401 not in ids and ids.count(150) + ids.count(151) + ids.count(152) == 1 and 400 in ids
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "parity"]
    assert all(x.n_tokens == len(x.ids) for x in got.collect())


def test_pipeline_takes_empty_tables(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, _folder(tmp_path, spark, [], [])).count() == 0


def test_released_tables_are_gone_and_kept_ones_stay(spark):
    at = common.mark()
    a, b = common.written(spark.range(3)), common.written(spark.range(5))
    assert common.release(spark, at, b) == 1 and b.count() == 5
    with pytest.raises(Exception):  # noqa: B017  its files are gone
        a.collect()
    assert common.release(spark, at) == 1
