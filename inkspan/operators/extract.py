"""Text extraction from documents, a row each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import pandas
from ..functions import documents as D

_OUT = "struct<text:string,metadata:map<string,string>,error_code:string,error:string>"


@pandas(_OUT)
def _extract(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([D.extract(n or "", None if c is None else bytes(c)) for n, c in zip(names, contents)], columns=["text", "metadata", "error_code", "error"])


def extract(rows: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``(name, text, metadata, error_code, error)`` of ``rows``, by the name's extension, in any letter case.

    A document that cannot be read has an error code and a null text.
    """
    return rows.withColumn("x", _extract(F.col(name), F.col(content))).select(name, "x.*")
