"""Tables seen as stores: ordinary columns become records, foreign keys links, events a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.match import PLAIN
from ..schema import TOKEN

_KINDS = {"string": "string", "boolean": "bool", "double": "float", "float": "float"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token(c: str, dtype: str) -> Column:
    """One column as the tokens of a field: arrays item by item, null as none."""
    def one(x: Column, kind: str) -> Column:
        k = _KINDS.get(kind, "int" if kind in ("tinyint", "smallint", "int", "bigint") else "string")
        num = x.cast("double") if k in ("int", "float") else F.lit(None).cast("double")
        return F.struct(F.lit(k).alias("kind"), x.cast("string").alias("text"), num.alias("num"))

    if dtype.startswith("array<"):
        found = F.transform(F.filter(F.col(c), lambda x: x.isNotNull()), lambda x: one(x, dtype[6:-1]))
    else:
        found = F.when(F.col(c).isNotNull(), F.array(one(F.col(c), dtype)))
    return F.coalesce(found, F.array().cast(f"array<{TOKEN}>")).cast(f"array<{TOKEN}>")


def as_records(rows: DataFrame, *, path: Column, type: Column | str, summary: Column, tags: Column | None = None, created: Column | None = None,
               updated: Column | None = None, fields: Sequence[str] = (), layer: str | None = None) -> DataFrame:
    """The record relation of any DataFrame; ``fields`` become queryable by ``key=value``.

    All of it is Column expressions: what a query does not touch is pruned
    from the scan.  Each field stands in the token map and as a plain column
    (``field:name``), by which predicates reach the scan.  A ``layer`` that all
    paths have in common is a literal, so that a filter by it is free.
    """
    kinds = dict(rows.dtypes)
    none = F.lit(None).cast("timestamp")
    stamp = lambda c: none if c is None else c.cast("timestamp")
    pairs = [x for f in fields for x in (F.lit(f), token(f, kinds[f]))]
    p = path
    return rows.select(
        p.alias("path"), F.split(p, "/").alias("parts"), (F.split_part(p, F.lit("/"), F.lit(1)) if layer is None else F.lit(layer)).alias("layer"),
        F.concat_ws("/", F.slice(F.split(p, "/"), 1, 2)).alias("type_folder"),
        (F.lit(type) if isinstance(type, str) else type).alias("type"), summary.alias("summary"),
        (F.array().cast("array<string>") if tags is None else tags).alias("tags"), F.array().cast("array<string>").alias("links"),
        F.date_format(stamp(created), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_raw"), stamp(created).alias("created"),
        F.date_format(stamp(updated), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_raw"), stamp(updated).alias("updated"),
        F.to_json(F.struct(*fields)).alias("fields_json") if fields else F.lit("{}").alias("fields_json"),
        (F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,array<{TOKEN}>>")).alias("tokens"),
        *[F.col(f).alias(PLAIN + f) for f in fields],
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("words", F.split("o_orderpriority", "[- ]"))
    return as_records(
        rows, path=F.concat(F.lit("records/orders/"), F.col("o_orderkey").cast("string")), type="order",
        summary=F.concat_ws(" ", "o_orderstatus", "o_orderpriority"), tags=F.array("o_orderstatus", "o_orderpriority"),
        created=F.col("o_orderdate"), updated=F.col("o_orderdate"), fields=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "words"], layer="records",
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_records(
        read(spark, sf_dir, "customer"), path=F.concat(F.lit("records/customers/"), F.col("c_custkey").cast("string")), type=F.lower("c_mktsegment"),
        summary=F.col("c_name"), tags=F.array("c_mktsegment"), fields=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], layer="records",
    )


def edge(rows: DataFrame, source: str, source_key: str, target: str, target_key: str) -> DataFrame:
    """An integer foreign key as links.

    Beside the paths stand their parts, folder and number: a link operator
    compares these, so a folder that no link has costs no scan and a number is
    looked for by the scan itself.
    """
    to = F.concat(F.lit(target), F.col(target_key).cast("string"))
    return rows.filter(F.col(target_key).isNotNull()).select(
        F.concat(F.lit(source), F.col(source_key).cast("string")).alias("src"), to.alias("target"), to.alias("dst_key"),
        F.lit(source).alias("src_folder"), F.col(source_key).cast("long").alias("src_id"), F.lit(target).alias("dst_folder"), F.col(target_key).cast("long").alias("dst_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers link to nations, nations to regions, suppliers to nations, orders to customers."""
    t = lambda n: read(spark, sf_dir, n)
    return (
        edge(t("customer"), "records/customers/", "c_custkey", "records/nations/", "c_nationkey")
        .unionByName(edge(t("nation"), "records/nations/", "n_nationkey", "records/regions/", "n_regionkey"))
        .unionByName(edge(t("supplier"), "records/suppliers/", "s_suppkey", "records/nations/", "s_nationkey"))
        .unionByName(edge(t("orders"), "records/orders/", "o_orderkey", "records/customers/", "o_custkey"))
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one folder for each source."""
    path = F.concat(F.lit("sources/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "documents").select(
        path.alias("path"), F.split(path, "/").alias("parts"), F.lit("sources").alias("layer"), F.concat(F.lit("sources/"), F.col("source")).alias("type_folder"),
        F.octet_length("text").cast("long").alias("size"), "text", "doc_id", "lang", "source",
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log, one file a month, ids as physical order."""
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        ts.alias("ts"), F.date_format(ts, "yyyy-MM").alias("ym"), F.col("event_type").alias("kind"),
        F.concat(F.lit("records/users/"), F.col("user_id").cast("string")).alias("object"), F.col("props").alias("note"),
        F.concat(F.lit("log/"), F.date_format(ts, "yyyy-MM"), F.lit(".md")).alias("file"), F.col("event_id").alias("ordinal"),
    )
