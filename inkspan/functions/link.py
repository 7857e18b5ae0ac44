"""Links: canonical targets and edge keys."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import pandas


def canonical_target(c: Column) -> Column:
    """Forward slashes; no leading ``./`` or ``/``, no final ``.md``; a ``#fragment`` stays."""
    c = F.replace(F.trim(c), F.lit("\\"), F.lit("/"))
    c = F.regexp_replace(c, r"^(?:\./)+", "")
    c = F.regexp_replace(c, r"^/+", "")
    return F.trim(F.regexp_replace(c, r"\.md$", ""))


def canonical(target: str) -> str:
    """:func:`canonical_target` of one text."""
    target = re.sub(r"^/+", "", re.sub(r"^(?:\./)+", "", target.strip(" ").replace("\\", "/")))
    return re.sub(r"\.md$", "", target).strip(" ")


@pandas("string")
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def edge_key(c: Column) -> Column:
    """A target as links compare: Unicode NFC.  Spark has no such function, so texts beyond ASCII go through
    Python (the others as nulls); :func:`ascii_edge_key` keeps to the JVM altogether."""
    key = canonical_target(c)
    other = key.rlike(r"[^\x00-\x7f]")
    return F.when(other, _nfc(F.when(other, key))).otherwise(key)


def ascii_edge_key(c: Column) -> Column:
    return canonical_target(c)


def is_short_form(c: Column) -> Column:
    """A target without a folder."""
    return ~F.contains(canonical_target(c), F.lit("/"))
