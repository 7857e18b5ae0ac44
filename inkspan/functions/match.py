"""The ``key=value`` predicate over records."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import usage
from .time import rfc3339

_FLOAT = re.compile(r"[+-]?(?:inf(?:inity)?|nan|(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?)", re.I)


def parse_where(text: str) -> tuple[str, str]:
    """``key=value``, cut at the first sign."""
    key, sign, value = text.partition("=")
    if not sign:
        raise usage("BAD_WHERE", f"{text!r} is not key=value")
    return key.strip(), value


def number(text: str) -> float | None:
    """A literal's value as a float, or None.  Spark's own cast would take blanks and type letters too."""
    return float(text) if _FLOAT.fullmatch(text) else None


def where(key: str, value: str) -> Column:
    """``type``, ``summary`` and ``path`` by equality, ``tags`` and ``links`` by membership, ``created`` and
    ``updated`` as instants; other keys match any of their scalars: strings, integers and booleans as
    text, floats by value.  Null and nested mappings never match."""
    if key in ("type", "summary", "path"):
        found = F.col(key) == value
    elif key in ("tags", "links"):
        found = F.array_contains(key, value)
    elif key in ("created", "updated"):
        found = F.col(key) == rfc3339(F.lit(value))
    else:
        n = number(value)
        same = lambda t: t["text"] == value
        if n is not None and not math.isnan(n):
            found = F.exists(F.try_element_at("tokens", F.lit(key)), lambda t: F.coalesce(
                F.when(t["kind"] == "float", t["num"] == F.lit(n)).otherwise(same(t)), F.lit(False)))
        else:
            found = F.exists(F.try_element_at("tokens", F.lit(key)), lambda t: F.coalesce((t["kind"] != "float") & same(t), F.lit(False)))
    return F.coalesce(found, F.lit(False))


#: What a plain column that stands beside the token map is named: this and the field's name.
PLAIN = "field:"
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def plain(key: str, value: str, dtype: str) -> Column:
    """The same as :func:`where` on a field that has a plain column of type ``dtype``: a comparison with a literal
    of that type, which the scan can take."""
    c = F.col(f"`{PLAIN}{key}`")
    if dtype.startswith("array<"):
        return F.coalesce(F.exists(c, lambda x: F.coalesce(_equal(x, value, dtype[6:-1]), F.lit(False))), F.lit(False))
    return _equal(c, value, dtype)


def _equal(c: Column, value: str, dtype: str) -> Column:
    if dtype in _WHOLE:
        n = int(value) if re.fullmatch(r"-?[1-9]\d{0,17}|0", value) else None  # other spellings are other texts
        return F.lit(False) if n is None else c == F.lit(n)
    if dtype in ("double", "float"):
        n = number(value)
        return F.lit(False) if n is None or math.isnan(n) else c == F.lit(n)
    if dtype == "boolean":
        return c == F.lit(value == "true") if value in ("true", "false") else F.lit(False)
    return (c if dtype == "string" else c.cast("string")) == F.lit(value)


def check_regex(pattern: str) -> str:
    """A search pattern in the dialect without look-around and back-references, Unicode classes on."""
    if re.search(r"(?<!\\)(?:\\\\)*(?:\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<)", pattern):
        raise usage("BAD_QUERY_REGEX", "look-around, atomic groups and back-references are not supported")
    try:
        re.compile(pattern.replace("(?U)", ""))
    except re.error as e:
        raise usage("BAD_QUERY_REGEX", str(e)) from None
    # Unicode classes cost much and mean something only where the pattern has a class, a boundary or a case switch.
    return "(?U)" + pattern if re.search(r"\\[wWdDsSbBpP]|\[\[?:|\(\?[a-zA-Z]*i", pattern) else pattern
