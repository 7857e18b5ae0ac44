"""Times: strict RFC 3339 (Column to Column) and bounds (on the driver)."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import usage

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(c: Column) -> Column:
    """The instant of a full RFC 3339 text, else null: Spark alone would take a date too."""
    return F.when(c.rlike(_RFC3339), F.try_to_timestamp(F.upper(c)))


def is_date_or_time(c: Column) -> Column:
    """Whether a text is ``YYYY-MM-DD`` or RFC 3339, of a day that exists."""
    day = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()
    return F.coalesce(day | rfc3339(c).isNotNull(), F.lit(False))


def bound(text: str) -> datetime:
    """A query bound: RFC 3339, or a date for its midnight in UTC."""
    try:
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            return datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=UTC)
        if re.fullmatch(_RFC3339, text):
            return datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
    except ValueError:
        pass
    raise usage("BAD_TIMESTAMP", f"{text!r} is neither RFC 3339 nor YYYY-MM-DD")


def within(c: Column, after: str | None = None, before: str | None = None) -> Column:
    """Inclusive on both sides; a missing time fails any bound."""
    ok = F.lit(True)
    if after is not None:
        ok = ok & F.coalesce(c >= F.lit(bound(after)), F.lit(False))
    if before is not None:
        ok = ok & F.coalesce(c <= F.lit(bound(before)), F.lit(False))
    return ok


def year_month(c: Column) -> Column:
    """``YYYY-MM`` of a text that begins with year and month (one or two digits), else null."""
    year, month = F.regexp_extract(c, r"^(\d{4})-(\d{1,2})(?!\d)", 1), F.regexp_extract(c, r"^(\d{4})-(\d{1,2})(?!\d)", 2)
    n = month.try_cast("int")
    return F.when(n.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))
