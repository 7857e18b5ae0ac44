"""The near-dedup stage's wide index: positions, lists, blocks, and whole tables against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from inkspan.llm import nearby, similar
from tests.llm.test_llm_sets import SF, alike_sets, docs, edited


def random_set(r, n):
    return {r.getrandbits(64) for _ in range(n)}


def flat(sets):
    rows = [np.array(sorted(s), np.uint64) for s in sets]
    return np.concatenate(rows), np.append(0, np.cumsum([len(x) for x in rows]))


def test_sets_at_the_line_share_the_guaranteed_positions():
    r = random.Random(3)
    pairs = []
    for n in [4, 5, 9, 20, 23, 24, 30, 47, 48, 60, 95, 96, 191, 192, 383, 384, 800, 3000, 20000] * 6:
        a = random_set(r, n)
        least = -(-8 * n // 10)  # a subset, the farthest in size
        pairs.append((a, set(r.sample(sorted(a), least))))
        both = int(n * 8 / 9)  # equal sizes, as far apart as may be
        while both / (2 * n - both) < 0.8:
            both += 1
        pairs.append((a, set(r.sample(sorted(a), both)) | random_set(r, n - both)))
    for a, b in pairs:
        h, first = flat([a, b])
        row, key = similar.posted(h, first, 0.8)
        assert len(np.unique(row)) == 2
        shared = np.intersect1d(key[row == 0], key[row == 1])
        assert len(shared) >= min(similar.least(len(a)), similar.least(len(b))), (len(a), len(b))


def test_chance_pairs_fall_below_the_tally():
    r = random.Random(4)
    common = random_set(r, 60)  # a passage that all hold
    sets = [common | random_set(r, 140) for _ in range(300)]
    row, key = similar.posted(*flat(sets), 0.8)
    order = np.lexsort((row, key))
    out = list(similar._met(iter([pa.record_batch([pa.array(key[order].view(np.int64)), pa.array(row[order])], names=["key", "node"])])))
    tally = np.concatenate([b.column(3).to_numpy() for b in out])
    assert (tally > 0).any() and (tally[tally > 0] < similar.LEAST).mean() > 0.9


def test_parities_bound_what_sets_differ_in():
    r = random.Random(5)
    for n in (3, 30, 300, 3000):
        a = random_set(r, n)
        b = set(r.sample(sorted(a), n - n // 10)) | random_set(r, n // 20)
        x, y = similar.parities(*flat([a, b]))
        for size in (8, min(len(x), len(y))):
            gap = np.bitwise_count(np.frombuffer(similar.folded(x, size), np.uint8) ^ np.frombuffer(similar.folded(y, size), np.uint8)).sum()
            assert gap <= len(a ^ b)


@pytest.mark.parametrize("cut", [1, 7, 10_000])
def test_lists_pass_in_any_batches(cut):
    """Long lists pass as rows, short ones as tallied pairs, however the rows come in batches."""
    r = random.Random(6)
    rows = sorted({(k, r.randrange(500)) for k in range(40) for _ in range(r.choice([1, 2, 5, 16, 17, 300]))})
    rows = sorted(rows + rows[::3])  # tasks may repeat a set
    lists: dict = {}
    for k, v in rows:
        lists.setdefault(k, set()).add(v)
    batches = [pa.record_batch([pa.array([k for k, _ in part], pa.int64()), pa.array([v for _, v in part], pa.int64())], names=["key", "node"])
               for part in (rows[i : i + cut] for i in range(0, len(rows), cut))]
    got_pairs: dict = {}
    got_rows = []
    for b in similar._met(iter(batches)):
        for k, x, y, t in zip(*(c.to_pylist() for c in b.columns)):
            if t:
                got_pairs[x, y] = got_pairs.get((x, y), 0) + t
            else:
                got_rows.append((k, x))
    want: dict = {}
    for members in lists.values():
        if len(members) <= similar.PAIRED:
            for x in members:
                for y in members:
                    if x < y:
                        want[x, y] = want.get((x, y), 0) + 1
    assert got_pairs == want
    assert sorted(got_rows) == sorted((k, x) for k, m in lists.items() if len(m) > similar.PAIRED for x in m)


def test_leaders_follow_lists_over_batches():
    def batch(rows):
        return pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], names=["key", "node"])

    out = similar._led(iter([batch([(1, 9), (1, 2)]), batch([(1, 3), (2, 5)]), batch([]), batch([(2, 6)])]))
    got = sorted((x, y) for b in out for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert got == [(5, 5), (5, 6), (9, 2), (9, 3), (9, 9)]


@pytest.mark.parametrize("tile", [similar.TILE, 32])
def test_a_family_of_a_thousand_near_copies_equals_brute_force(spark, monkeypatch, tile):
    """Copies edited on their own, most of them below 0.8 to each other, with and without their base; groups in one block and in many."""
    monkeypatch.setattr(similar, "TILE", tile)
    r = random.Random(tile)
    texts = []
    for n, copies, most, with_base in [(150, 600, 7, True), (150, 300, 5, False), (60, 100, 2, False)]:
        base = [f"w{r.randrange(10**9)}" for _ in range(n)]
        texts += [edited(r, base, r.randint(1, most)) for _ in range(copies)] + [" ".join(base)] * with_base
    want = alike_sets(texts)
    got = {x.ident: x.component_id for x in similar.similar_classes(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 3 < len(set(want)) < len(texts)


def test_whole_fixture_table_equals_brute_force(spark):
    """Every link of sf0.01 at 0.8: none lost, none made."""
    rows = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").orderBy("doc_id").collect()
    want = alike_sets([x.text or "" for x in rows])
    ids = [x.doc_id for x in rows]
    got = {x.ident: x.component_id for x in similar.similar_classes(spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")).collect()}
    assert [got[i] for i in ids] == [ids[c] for c in want]


@pytest.mark.parametrize("options", [{"shingle": 5, "similarity": 0.8}, {}])
def test_texts_that_share_an_id_stay_apart(spark, options):
    """One row of each group stays, whatever ids are repeated; rows that repeat both stay once, rows without an id all."""
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(5, a), (5, b), (5, b), (7, a), (3, c), (3, c), (2, b), (None, a), (None, a)]
    kept = nearby.without_near_duplicates(docs(spark, rows), **options).collect()
    names = {a: "a", b: "b", c: "c"}
    assert sorted((str(x.doc_id), names[x.text]) for x in kept) == [("2", "b"), ("3", "c"), ("5", "a"), ("None", "a"), ("None", "a")]


def test_extra_columns_long_texts_and_a_wrong_similarity(spark):
    long = " ".join(f"v{i}" for i in range(300_000))
    d = docs(spark, [(1, long), (2, long + " more"), (3, long.upper()), (4, None), (5, "")])
    d = d.selectExpr("*", "1 as NODE", "2 as Ident", "3 as keys")
    got = {x.ident: x.component_id for x in similar.similar_classes(d).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert similar.without_similar(d).columns == d.columns
    with pytest.raises(ValueError):
        similar.similar_classes(d, similarity=0.5)


def test_the_stage_links_copies_by_simhash_and_verifies_them(spark, monkeypatch):
    """The stage's fingerprints are those of all texts, its links those at three bits; of these only sets at 0.8 are one class."""
    import corpus_pipeline

    found, own, verify = [], nearby.links, similar._verified

    def links(distinct, bits=3):
        out = own(distinct, bits)
        found.append((bits, {x.fp for x in distinct.collect()}, {(min(x), max(x)) for x in out.collect()}))
        return out

    def verified(pairs, *rest):
        tested.update((min(x.a, x.b), max(x.a, x.b)) for x in pairs.collect())
        return verify(pairs, *rest)

    tested = set()
    monkeypatch.setattr(nearby, "links", links)
    monkeypatch.setattr(similar, "_verified", verified)
    r = random.Random(12)
    texts = []
    for _ in range(20):
        base = [f"w{r.randrange(10**9)}" for _ in range(1500)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    texts += ["a b c d e f g " * 200, "a b c d e f g " * 200 + "h i j k l m n o p q"]  # much alike by SimHash, far apart as sets
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    fp = nearby.fingerprints(data, off, 5).view(np.int64).tolist()
    node = [n for _, _, _, _, _, own_nodes in similar._sets(iter([pa.record_batch([pa.array(texts)], names=["text"])]), 5) for n in own_nodes.tolist()]
    apart = [((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(fp[::2], fp[1::2])]
    kept = {x.doc_id for x in corpus_pipeline.deduplicate(spark, docs(spark, list(enumerate(texts))), SF).collect()}
    (bits, seen, pairs), = found
    assert bits == 3 and seen == set(fp)
    assert {(min(a, b), max(a, b)) for a, b, n in zip(fp[::2], fp[1::2], apart) if 0 < n <= 3} <= pairs and sum(n <= 3 for n in apart) > 10
    assert {(min(a, b), max(a, b)) for a, b, n in zip(node[::2], node[1::2], apart) if n <= 3} <= tested
    assert kept == set(alike_sets(texts)) and apart[-1] <= 3 and {40, 41} <= kept
