"""Structured queries over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError, usage
from ..functions import path as P
from ..functions.match import PLAIN, parse_where, plain, where
from ..functions.time import within
from ..schema import LAYERS


def check_layer(layer: str | None) -> str | None:
    if layer is not None and layer not in LAYERS:
        raise usage("BAD_LAYER", f"{layer!r} is neither sources nor records")
    return layer


def filtered(records: DataFrame, type: str | None = None, layer: str | None = None, wheres: Sequence[str] = (),
             updated_after: str | None = None, updated_before: str | None = None,
             created_after: str | None = None, created_before: str | None = None) -> DataFrame:
    """All predicates as one conjunction, for Catalyst to push down and prune by.

    A field with a plain column is compared as a column, so the scan can take
    it; others are looked up in the record's tokens.
    """
    out = records
    kinds = dict(records.dtypes)
    if check_layer(layer):
        out = out.filter(F.col("layer") == layer)
    if type is not None:
        out = out.filter(F.col("type") == type)
    for w in wheres:
        key, text = parse_where(w)
        kind = kinds.get(PLAIN + key)
        out = out.filter(where(key, text) if kind is None else plain(key, text, kind))
    if updated_after is not None or updated_before is not None:
        out = out.filter(within(F.col("updated"), updated_after, updated_before))
    if created_after is not None or created_before is not None:
        out = out.filter(within(F.col("created"), created_after, created_before))
    return out


def query(records: DataFrame, *, limit: int | None = None, **predicates) -> DataFrame:
    """Records that meet every predicate, in path order, ``limit`` of them at most.

    A query without a type, a layer and a predicate is empty by contract, not everything.
    """
    bare = not any(predicates.get(k) for k in ("type", "layer", "wheres"))
    out = filtered(records, **predicates)
    if bare:
        return out.limit(0)
    out = out.orderBy("parts")
    return out if limit is None else out.limit(limit)


def find_by_type(records: DataFrame, type: str) -> DataFrame:
    """Records of a type in its canonical layer only; narrower than :func:`query` by type."""
    return records.filter((F.col("type") == type) & (F.col("layer") == P.layer_for_type(type))).orderBy("parts")


def find_by_where(records: DataFrame, predicate: str, layer: str | None = None) -> DataFrame:
    return filtered(records, layer=layer, wheres=[predicate]).orderBy("parts")


def get_field(records: DataFrame, key: str) -> DataFrame:
    """``(path, value)`` of one field: a typed one, else the field's JSON."""
    typed = {"type", "summary", "path"}
    times = {"created": "created_raw", "updated": "updated_raw"}
    if key in typed or key in times:
        value = F.col(times.get(key, key))
    elif key in ("tags", "links"):
        value = F.to_json(key)
    else:
        value = F.get_json_object("fields_json", "$['" + key.replace("'", "\\'") + "']")
    return records.select("path", value.alias("value")).filter("value is not null")


def field_of(records: DataFrame, path: str, key: str) -> str:
    """One field of one record; an error where the record is not there or has no such field."""
    found = get_field(records.filter(F.col("path") == path), key).first()
    if found is None:
        raise StoreError("FM_KEY_NOT_FOUND", f"{path} has no {key}")
    return found.value


def lines(rows: DataFrame, form: str = "text") -> DataFrame:
    """``line``: a row's columns as text (the first, a colon, the others) or as JSON with nulls left out (``ndjson``)."""
    if form == "ndjson":
        return emit_json(rows).select(F.col("json").alias("line"))
    if form != "text":
        raise usage("BAD_FORMAT", f"{form!r} is neither text nor ndjson")
    first, *rest = rows.columns
    return rows.select(F.concat(F.col(first).cast("string"), F.lit(": "), F.concat_ws(" ", *[F.col(c).cast("string") for c in rest])).alias("line"))


def emit_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, nulls left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
