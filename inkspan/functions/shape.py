"""Shape predicates of schema fields (Column to Column, false for null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import is_date_or_time


def _ok(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_email(c: Column) -> Column:
    """One ``@`` between a local part and a domain that holds a dot, but not at its ends; no spaces.  Blanks around do not count."""
    return _ok(_trimmed(c).rlike(r"^[^@ ]+@(?=[^@]*\.)[^@ .](?:[^@ ]*[^@ .])?$"))


def is_url(c: Column) -> Column:
    """``http://`` or ``https://`` and anything after it.  Blanks around do not count."""
    return _ok(_trimmed(c).rlike(r"(?s)^https?://.+$"))


def is_currency(c: Column) -> Column:
    """An optional sign of money, an optional three-letter code and a space, then an optional ``+`` or ``-``,
    digits, two decimals at most; commas anywhere among them do not count."""
    amount = F.regexp_replace(F.regexp_replace(_trimmed(c), r"(?U)^[$€£¥]\s*", ""), r"(?U)^[A-Za-z]{3}\s+", "")
    return _ok(_trimmed(F.replace(amount, F.lit(","), F.lit(""))).rlike(r"^[+-]?[0-9]+(?:\.[0-9]{1,2})?$"))


def is_int(c: Column) -> Column:
    return _ok(c.rlike(r"^[+-]?[0-9]+$") & c.try_cast("long").isNotNull())


def is_bool(c: Column) -> Column:
    return _ok(c.isin("true", "false"))


def is_date(c: Column) -> Column:
    return is_date_or_time(c)


def is_string(c: Column) -> Column:
    return c.isNotNull()


def is_ulid(c: Column) -> Column:
    return _ok(c.rlike(r"^[0-7][0-9a-hjkmnp-tv-z]{25}$"))


SHAPES = {
    "email": is_email, "url": is_url, "currency": is_currency, "int": is_int, "bool": is_bool, "date": is_date, "string": is_string,
}
