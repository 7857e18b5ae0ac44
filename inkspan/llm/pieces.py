"""Operator 8: SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here, and its normaliser, metaspace marker,
scores or merges, and byte fallback are rebuilt as a ``tokenizers.Tokenizer``.
Where no piece crosses a word boundary (checked on the vocabulary), a text is
the concatenation of its chunks (a run of spaces and the word after it, or a
line feed), so each distinct chunk is encoded once per worker, in multithreaded
batches, and checked there against the sentencepiece library.  A text with a
chunk on which the two differ says so in a parity column; its ids are those of
the tokenizers library.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import lean, modest, quoted, table

#: Where the vocabulary files of public tokenizers are; a parameter of everything here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct chunks a worker remembers.
REMEMBERED = 100_000
#: Chunks that travel as one text to the libraries.
TOGETHER = 64


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number, and integer or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[i : i + size]
        i += size


class Model:
    """What a model file says: pieces, scores, types, the kind of model and the normaliser's settings."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.remove_extra, self.escape = b"", True, True, True
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(fields(value))
                self.kind, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                self.charsmap = own.get(2, b"")
                self.dummy_prefix, self.remove_extra, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.unk = self.types.index(UNKNOWN)

    @property
    def chunked(self) -> bool:
        """Whether texts may be cut before each run of spaces and around line feeds."""
        plain = [p for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER)]
        return (
            not self.charsmap and not self.remove_extra and self.escape and self.kind == BPE
            and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain) and USER not in self.types
            and self.byte_fallback and "<0x0A>" in self.pieces
        )

    def normalizer(self, prefix: bool):
        """The normaliser as the tokenizers library states it; ``prefix`` adds the first space."""
        from tokenizers import Regex, normalizers as N

        parts = [N.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            parts += [N.Replace(Regex("^ +| +$"), ""), N.Replace(Regex(" {2,}"), " ")]
        if prefix and self.dummy_prefix:
            parts.append(N.Prepend(SPACE if self.escape else " "))
        if self.escape:
            parts.append(N.Replace(" ", SPACE))
        return N.Sequence(parts)

    def merges(self) -> list[tuple[str, str]]:
        """Every way to join two pieces into one, the joined piece of highest score first."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER, UNUSED)}
        out = []
        for p, i in ids.items():
            cuts = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
            out += [(-self.scores[i], i, ids[a], ids[b], a, b) for a, b in cuts]
        return [(a, b) for *_, a, b in sorted(out)]

    def tokenizer(self, prefix: bool = True):
        from tokenizers import Tokenizer, decoders, models

        if self.kind == BPE:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            core = models.Unigram(list(zip(self.pieces, self.scores)), self.unk, self.byte_fallback)
        else:
            raise ValueError(f"models of type {self.kind} are not BPE or unigram")
        t = Tokenizer(core)
        t.normalizer = self.normalizer(prefix)
        steps = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
        t.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if prefix and self.dummy_prefix else steps)
        return t

    def reference(self, prefix: bool = True):
        """The sentencepiece library's processor, without the first space unless ``prefix``."""
        import sentencepiece

        if prefix or not self.dummy_prefix:
            return sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        # A later normaliser field overrides an earlier one: number 3, holding {3: 0}.
        return sentencepiece.SentencePieceProcessor(model_proto=self.raw + b"\x1a\x02\x18\x00")


@cache
def model(raw: bytes) -> Model:
    return Model(raw)


_CHUNK = re.compile(" *[^ \n]+|\n| +")


class Codec:
    """Encodes and decodes batches of texts; keeps the chunks that it has met."""

    def __init__(self, raw: bytes, verify: bool = True) -> None:
        self.model = model(raw)
        self.verify = verify
        self.whole = self.model.tokenizer()
        self.whole_reference = self.model.reference()
        if self.model.chunked:
            self.part = self.model.tokenizer(prefix=False)
            self.part_reference = self.model.reference(prefix=False)
            self.line = self.model.pieces.index("<0x0A>")
        self.forget()
        plain = [p.replace(SPACE, " ").encode() for p in self.model.pieces]
        for i, t in enumerate(self.model.types):
            if t == BYTE:
                plain[i] = bytes([int(self.model.pieces[i][3:5], 16)])
            elif t in (CONTROL, UNUSED):
                plain[i] = b""
            elif t == UNKNOWN:
                plain[i] = " ⁇ ".encode()
        self.sizes = np.array([len(p) for p in plain])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.octets = np.frombuffer(b"".join(plain), np.uint8)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 12, np.int64)
        self.len = np.zeros(1 << 12, np.int64)
        self.same = np.ones(1 << 12, bool)
        self.used = 0

    def _both(self, texts: list[str], own, other) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether the reference has the same (true without verification)."""
        ids = [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        right = other.encode(texts, num_threads=threads()) if self.verify else ids
        return ids, [a == b for a, b in zip(ids, right)]

    def _parts(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids and parity of each chunk.  Chunks travel many to a text, a line feed between them; a text on
        which the libraries differ is taken apart."""
        groups = [chunks[i : i + TOGETHER] for i in range(0, len(chunks), TOGETHER)]
        for group, ids, same in zip(groups, *self._both(["\n".join(g) for g in groups], self.part, self.part_reference)):
            if not same:
                yield from ((np.array(x, np.uint32), ok) for x, ok in zip(*self._both(group, self.part, self.part_reference)))
                continue
            ids = np.array(ids, np.uint32)
            yield from ((x[k > 0 :], True) for k, x in enumerate(np.split(ids, np.flatnonzero(ids == self.line))))

    def _learn(self, chunks: list[str]) -> None:
        if "\n" in chunks:
            chunks = [c for c in chunks if c != "\n"]
            (ids,), (same,) = self._both(["\n"], self.part, self.part_reference)
            self._keep("\n", np.array(ids, np.uint32), same)
        for (ids, same), chunk in zip(self._parts(chunks), chunks):
            self._keep(chunk, ids, same)

    def _keep(self, chunk: str, ids: np.ndarray, same: bool) -> None:
        k, n = len(self.known), len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if k == len(self.at):
            self.at, self.len, self.same = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len, self.same))
        self.flat[self.used : self.used + n] = ids
        self.at[k], self.len[k], self.same[k] = self.used, n, same
        self.used += n
        self.known[chunk] = k

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin and end, and whether both libraries agree on it."""
        if not self.model.chunked:
            ids, same = self._both(texts, self.whole, self.whole_reference)
            ends = np.append(0, np.cumsum([len(x) for x in ids]))
            return np.array([i for x in ids for i in x], np.uint32), ends.astype(np.int64), np.array(same, bool)
        chunks: list[str] = []
        counts = [0]
        for text in texts:
            if text:
                if SPACE in text:
                    text = text.replace(SPACE, " ")
                chunks += _CHUNK.findall(" " + text if self.model.dummy_prefix else text)
            counts.append(len(chunks))
        if len(self.known) > REMEMBERED:
            self.forget()
        if new := [c for c in dict.fromkeys(chunks) if c not in self.known]:
            self._learn(new)
        k = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        size = self.len[k]
        ends = np.append(0, np.cumsum(size))[counts]
        return self.flat[W.ranges(self.at[k], size)], ends, W.per_row(~self.same[k], np.array(counts)) == 0

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each text; the added first space goes."""
        size = self.sizes[ids]
        raw = self.octets[W.ranges(self.starts[ids], size)].tobytes()
        cut = np.append(0, np.cumsum(size))[ends].tolist()
        first = self.model.dummy_prefix
        return [raw[a + 1 : b] if first and raw[a : a + 1] == b" " and a < b else raw[a:b] for a, b in zip(cut, cut[1:])]


def threads() -> int:
    """Threads that a batch is encoded by: the task's cores (``spark.task.cpus``), or all outside a task."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.cpus() if task else os.cpu_count() or 1


@cache
def codec(raw: bytes) -> Codec:
    # Read by the tokenizers library when it makes its thread pool, at the first batch.
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads()))
    return Codec(raw)


def _texts(col: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    data, off = W.utf8(col)
    for i, j in W.slices(off):
        raw = data[off[i] : off[j]].tobytes()
        cut = (off[i : j + 1] - off[i]).tolist()
        yield i, j, [raw[a:b].decode() for a, b in zip(cut, cut[1:])]


def _rows(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    rows = modest(docs).select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    return rows, "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))


def encode(docs: DataFrame, text: str = "text", model_path: str = MODEL, ids: str = "ids", keep: list[str] | None = None, parity: str = "parity") -> DataFrame:
    """Adds ``ids`` (array<int>), the whole text's pieces, and ``parity`` to the columns ``keep`` (default: all but the text).

    ``parity`` says whether the sentencepiece library gives the same ids.  A
    null text is empty; an empty text has no ids; repeated rows repeat; columns
    of the names ``ids`` and ``parity``, whatever their letters' case, are
    replaced; an empty table gives no rows; a text of any length is encoded
    whole, by one task.  ``model_path`` is read on the driver and sent along
    (half a megabyte).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (text.lower(), ids.lower(), parity.lower())]
    raw = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    rows, kinds = _rows(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in _texts(batch.column(batch.num_columns - 1)):
                found, ends, same = codec(raw.value).encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(len(keep))], lists, pa.array(same)], names=[*batch.schema.names[:-1], "ids", "parity"])

    out = rows.mapInArrow(lean(run), kinds + "ids array<int>, parity boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(ids), F.col("parity").alias(parity))


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", model_path: str = MODEL) -> DataFrame:
    """Replaces ``ids`` by the text that they stand for; null ids give null, bytes that are no UTF-8 U+FFFD.

    A column of the name ``text``, whatever its letters' case, is replaced;
    no ids give the empty text; repeated rows repeat; an empty table gives no
    rows; a list of any length is decoded whole, by one task.
    """
    raw = rows.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    keep = [c for c in rows.columns if c.lower() not in (ids.lower(), text.lower())]
    own = rows.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.col(quoted(ids)).cast("array<int>").alias("ids"))
    kinds = "".join(f"k{i} {rows.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            texts = codec(raw.value).decode(flat, np.append(0, np.cumsum(size)))
            made = [t.decode(errors="replace") if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return own.mapInArrow(lean(run), kinds + "text string").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(text))


def op8_pieces(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """Each document encoded, decoded again and digested: ``n_tokens``, ``ids_sha256`` (little-endian
    uint32), ``n_byte_tokens``, ``text_sha256`` of the decoded text, whether it is the text itself, and
    whether the sentencepiece library gives the same ids."""
    docs = table(spark, sf_dir, "documents")
    raw = spark.sparkContext.broadcast(open(model_path, "rb").read())
    rows, _ = _rows(docs, ["doc_id"], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        is_byte = np.array([t == BYTE for t in own.model.types])
        for batch in batches:
            for i, j, texts in _texts(batch.column(1)):
                ids, ends, same = own.encode(texts)
                back = own.decode(ids, ends)
                octets, cut = ids.tobytes(), (4 * ends).tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array(W.per_row(is_byte[ids], ends)),
                    pa.array([hashlib.sha256(octets[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in back]),
                    pa.array([t == x.encode() for t, x in zip(back, texts)]), pa.array(same),
                ], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "text_sha256", "round_trip", "parity"])

    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean, parity boolean")
