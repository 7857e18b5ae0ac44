"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  Stages are written as Parquet and
read again, so each works on what the one before it kept, and a lost executor
costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import mixing, nearby, pieces, quality, substrings
from inkspan.llm.common import mark, release, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.7 go; null and empty texts are scored as texts without words,
    rows without an id like any other; an empty table stays empty."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents four fifths alike in five-word shingles, the one with the smallest id stays.

    SimHash fingerprints of all texts are linked by the operator's index with
    count filtering at three of 64 bits, which is for close copies; the same
    index on wider fingerprints adds the pairs that lie farther apart.  Every
    link is verified on whole shingle sets.  Null and empty texts are one
    group, rows without an id all stay, of rows that repeat an id one.
    """
    return nearby.without_near_duplicates(docs, shingle=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that occur elsewhere go; documents without any stay as they are, a null text
    becomes empty, and a document whose words all go stays with an empty text."""
    rows = substrings.without_repeated(docs)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of their sources takes them; a null source is a source, empty texts weigh nothing."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, parity)``: the SentencePiece ids of each document's whole text, and
    whether both libraries give them.  A null text has no ids; rows without an id stay; repeated rows repeat."""
    rows = pieces.encode(docs, keep=["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "parity")


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The classifier's scores and the byte-pair encoding have no statement in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other; what a stage wrote on its way is deleted when its result is written."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
            release(spark, since, docs)
    return docs
