"""Operator 4: toxicity by a weighted finite-state grammar over clauses.

Words are read as a small alphabet of classes (insult, threat, target,
negation, reporting verb, anything else).  Five transducers, one for each
class, rewrite and weigh that alphabet; :func:`compose` makes one machine of
them, and every clause that holds an insult or a threat runs through it once.
The insults' own weights are learned: words and word beginnings of four to six
characters, by their log odds in toxic against clean labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import bounded, held_out, labelled, modest, quoted, table, written
from .quality import logistic

OTHER, INSULT, THREAT, TARGET, NOT, REPORT, END = range(7)
#: Symbols that only pass between transducers: a threat denied, reported or both, each of them aimed (AIMED more), and a match.
DENIED, QUOTED, BOTH, AIMED, DONE = 7, 8, 9, 10, 20
#: What a threat counts, by how it is said.
SAID = {THREAT: 1.0, DENIED: 0.3, QUOTED: 0.5, BOTH: 0.15}

#: Seed vocabulary of four languages; insults beyond it are learned.
SEEDS = {
    THREAT: "kill hurt destroy smash beat punish töten umbringen schlagen tuer tuerai frapper matar mataré golpear".split(),
    TARGET: "you your yours u they he she them dich dir du ihr sie euch toi tu vous te tú ti usted ustedes".split(),
    NOT: "not no never neither nor isn't aren't don't nicht kein keine nie niemals pas jamais ni nunca jamás".split(),
    REPORT: "said says called calls wrote writes quoted claimed reported sagte nannte schrieb dit écrit appelé dijo llamó escribió".split(),
    INSULT: "idiot moron stupid loser scum idiota imbécile dummkopf".split(),
}


@dataclass
class Transducer:
    """A deterministic weighted transducer.

    ``arcs[state, symbol] = (state, symbol out, factor)``; a symbol without an
    arc stays in its state unchanged with factor 1.
    """

    start: int
    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(*parts: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """The composition as tables ``to[state, symbol]`` and ``factor[state, symbol]`` over the input symbols.

    A factor is the product along the parts, and counts as a weight only where
    the last part writes :data:`DONE`; elsewhere it is 0.
    """
    states = {tuple(p.start for p in parts): 0}
    order = list(states)
    to, factor = [], []
    for have in order:
        row_to, row_f = [], []
        for symbol in range(END + 1):
            nxt, weight = [], 1.0
            for p, s in zip(parts, have):
                s, symbol, w = p.step(s, symbol)
                nxt.append(s)
                weight *= w
            key = tuple(nxt)
            if key not in states:
                states[key] = len(states)
                order.append(key)
            row_to.append(states[key])
            row_f.append(weight if symbol == DONE else 0.0)
        to.append(row_to)
        factor.append(row_f)
    return np.array(to), np.array(factor)


def parts() -> tuple[Transducer, ...]:
    """Negation, reported speech, target, threat and insult, in the order in which they are composed."""
    negation = Transducer(0)  # a negation reaches three words on
    for state in range(4):
        less = max(0, state - 1)
        negation.arcs[state, NOT] = (3, NOT, 1.0)
        for symbol in (OTHER, TARGET, REPORT):
            negation.arcs[state, symbol] = (less, symbol, 1.0)
        negation.arcs[state, INSULT] = (less, INSULT, 0.3 if state else 1.0)
        negation.arcs[state, THREAT] = (less, DENIED if state else THREAT, 1.0)
    reported = Transducer(0)  # a reporting verb weakens the rest of its clause
    reported.arcs[0, REPORT] = (1, REPORT, 1.0)
    reported.arcs[1, INSULT] = (1, INSULT, 0.5)
    reported.arcs[1, THREAT] = (1, QUOTED, 1.0)
    reported.arcs[1, DENIED] = (1, BOTH, 1.0)
    target = Transducer(0)  # after a target, what is said is aimed at it
    target.arcs[0, TARGET] = (1, TARGET, 1.0)
    target.arcs[1, INSULT] = (1, INSULT, 1.5)
    for said in SAID:
        target.arcs[1, said] = (1, said + AIMED, 1.0)
    threat = Transducer(0)  # a threat counts when it is aimed: at once, or where its target follows
    for waiting in (0, *SAID):
        for said, weight in SAID.items():
            threat.arcs[waiting, said + AIMED] = (waiting, DONE, 0.75 * weight)
            threat.arcs[waiting, said] = (said, OTHER, 1.0)
        if waiting:
            threat.arcs[waiting, TARGET] = (0, DONE, 0.75 * SAID[waiting])
    insult = Transducer(0)  # a second insult in one clause counts a little more
    insult.arcs[0, INSULT] = (1, DONE, 1.0)
    insult.arcs[1, INSULT] = (1, DONE, 1.2)
    return negation, reported, target, threat, insult


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """The composed machine of :func:`parts`."""
    return compose(*parts())


_BETWEEN = np.ones(256, bool)  # letters and apostrophes make words here
_BETWEEN[ord("a") : ord("z") + 1] = False
_BETWEEN[ord("A") : ord("Z") + 1] = False
_BETWEEN[ord("'")] = False
_BETWEEN[128:] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\n()[]|"]] = True
PREFIXES = (4, 5, 6)


def features(data: np.ndarray, w: W.Words) -> np.ndarray:
    """Hashes of each word (row 0) and of its first 4, 5 and 6 characters (0 if it has no more)."""
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    out = [W.hashes(w)]
    at = np.searchsorted(lead, w.starts)
    for k in PREFIXES:
        end = lead[np.minimum(at + k, len(lead) - 1)]
        longer = end < w.ends
        h = np.zeros(len(w.starts), W.U64)
        if longer.any():
            part = W.Words(w.data, w.starts[longer], w.ends[longer], w.first)
            h[longer] = W.mix(W.hashes(part, length=end[longer] - w.starts[longer]) ^ W.U64(k))
        out.append(h)
    return np.stack(out)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) to (feature, toxic documents, clean documents), combined in the task."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def combined() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*found))
        key, at = np.unique(h, return_inverse=True)
        total = np.zeros((len(key), 2), np.int64)
        np.add.at(total, at, n)
        return key, total

    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        data, off = W.utf8(batch.column(1))
        for i, j in W.slices(off):
            own = data[off[i] : off[j]]
            w = W.split(own, off[i : j + 1] - off[i], _BETWEEN)
            if not len(w.starts):
                continue
            h = features(own, w)
            row = np.tile(w.rows, len(h))
            h = h.ravel()
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            new &= h != 0
            toxic = y[i + row[new]] == 1
            found.append((h[new], np.stack([toxic, ~toxic], 1).astype(np.int64)))
        if sum(len(x[0]) for x in found) > 1 << 21:
            found = [combined()]
            if len(found[0][0]) > 1 << 20:
                yield _counts(*found.pop())
    if found:
        yield _counts(*combined())


def _counts(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "toxic": pa.array(n[:, 0]), "clean": pa.array(n[:, 1])})


def lexicon(rows: DataFrame, odds: float = 2.0, surprise: float = 13.0) -> dict[int, float]:
    """Learned insults of rows ``(y, text)``: feature hash to weight, bounded by what the bounded rows hold.

    A feature must have smoothed log odds of ``odds`` and a log likelihood
    ratio against the base rate of ``surprise`` (about the log of the number of
    features tried); its weight is the log odds shrunk by its count, over 4.
    """
    counts = rows.mapInArrow(_counted, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    total = rows.agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("c")).first()
    if not total.t or not total.c:
        return {}
    value = F.log((F.col("t") + 0.5) / (total.t + 1)) - F.log((F.col("c") + 0.5) / (total.c + 1))
    rate = total.t / (total.t + total.c)
    n = F.col("t") + F.col("c")
    gain = F.col("t") * F.log(F.col("t") / (n * rate)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - rate)))).otherwise(0)
    best = counts.filter("t >= 2").withColumn("v", value).filter((F.col("v") >= odds) & (gain >= surprise))
    return {r.h & (2**64 - 1): min(r.v, 8.0) / 4 * r.t / (r.t + 2) for r in best.collect()}


class Scorer:
    """Word classes and weights by hash, and the composed machine."""

    def __init__(self, learned: dict[int, float]) -> None:
        known = {W.hash_text(x): (c, 1.0) for c, xs in SEEDS.items() for x in xs}
        known |= {h: (INSULT, v) for h, v in learned.items()}
        keys = sorted(known)
        self.keys = np.array(keys, W.U64)
        self.kind = np.array([known[k][0] for k in keys], np.int8)
        self.value = np.array([known[k][1] for k in keys])
        self.to, self.factor = (x.tolist() for x in grammar())

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word: a whole word's entry before its beginnings', the longest first."""
        kind = np.zeros(h.shape[1], np.int8)
        value = np.zeros(h.shape[1])
        for row in (0, *range(len(h) - 1, 0, -1)):
            at = np.minimum(np.searchsorted(self.keys, h[row]), len(self.keys) - 1)
            hit = (self.keys[at] == h[row]) & (kind == OTHER)
            kind[hit] = self.kind[at[hit]]
            value[hit] = self.value[at[hit]]
        return kind, value

    def measure(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: log of the sum over clauses, the heaviest clause, clauses by 100 words (log)."""
        n = len(offsets) - 1
        out = np.zeros((n, 3))
        w = W.split(data, offsets, _BETWEEN)
        if not len(w.starts):
            return out
        kind, value = self.classes(features(data, w))
        hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        if not len(hits):
            return out
        stops = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_STOP[data], out=stops[1:])
        new = np.ones(len(w.starts), bool)
        new[1:] = stops[w.starts[1:]] > stops[w.ends[:-1]]
        new[w.first[:-1][w.counts > 0]] = True
        heads = np.append(np.flatnonzero(new), len(new))
        row = w.rows
        matched = np.zeros(n)
        for c in np.unique(np.searchsorted(heads, hits, "right") - 1):
            a, b = heads[c], heads[c + 1]
            state, total = 0, 0.0
            for symbol, own in zip(kind[a:b].tolist(), value[a:b].tolist()):
                total += self.factor[state][symbol] * own
                state = self.to[state][symbol]
            r = row[a]
            out[r, 0] += total
            out[r, 1] = max(out[r, 1], total)
            matched[r] += total > 0
        out[:, 0] = np.log1p(out[:, 0])
        out[:, 2] = np.log1p(100 * matched / np.maximum(w.counts, 1))
        return out


def _measured(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.utf8(batch.column(1))
            x = [scorer.measure(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in W.slices(off)]
            x = np.concatenate(x) if x else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, c].copy()) for c in range(3)]], names=["ident", "x0", "x1", "x2"])

    return run


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
           modulus: int = 5, remainder: int = 0, sample: int = 40_000) -> DataFrame:
    """``(doc_id, score)`` of every row, from its whole text in lower case.

    Learns from ``sample`` labelled rows at most, none of them held out.  Null
    and empty texts measure zero and score as texts without a matched clause;
    repeated rows score alike; a null id scores but teaches nothing; without
    labels of both kinds nothing is learned, and matched seed words decide.
    """
    known = bounded(labelled(labels, label, modulus, remainder, doc_id), sample)
    whole = modest(docs).select(F.col(quoted(doc_id)).alias("ident"), F.lower(F.coalesce(F.col(quoted(text)), F.lit(""))).alias("text"))
    taught = whole.join(F.broadcast(known), "ident").select("y", "text")  # 16 bytes a row, ``sample`` rows at most
    kind = docs.schema[doc_id].dataType.simpleString()
    measured = written(whole.mapInArrow(_measured(Scorer(lexicon(taught))), f"ident {kind}, x0 double, x1 double, x2 double"))
    rows = measured.join(F.broadcast(known), "ident").select("y", "x0", "x1", "x2").limit(2 * sample).collect()
    beta = np.array([2.0, 1.0, 0.0, -2.0])
    if len({r.y for r in rows}) == 2:
        beta = logistic(np.array([r[1:] for r in rows], float), np.array([r.y for r in rows], float), 1e-5)
    z = sum((F.col(f"x{i}") * float(beta[i]) for i in range(3)), F.lit(float(beta[3])))
    return measured.select(F.col("ident").alias(doc_id), (1 / (1 + F.exp(-z))).alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
