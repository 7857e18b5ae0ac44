"""Pandas UDFs that are made when they are first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pandas(kind: str) -> Callable:
    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
