"""Written tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import usage

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only on one machine (``local`` masters, as in tests) may the session have
    none: a temporary folder is made there, and the session is told of it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise usage("NO_SHARED_FOLDER", "set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="inkspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads it."""
    path = f"{shared_dir(df.sparkSession)}/inkspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def mark() -> int:
    """A place in the sequence of written tables, for :func:`release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> int:
    """Deletes the tables written since a mark but for those of ``keep``; for when no result reads them any more."""
    jvm, kept = spark.sparkContext._jvm, {k.written_at for k in keep}
    gone = 0
    for name in _WRITTEN[since:]:
        if name not in kept:
            path = jvm.org.apache.hadoop.fs.Path(name)
            gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[since:] = [x for x in _WRITTEN[since:] if x in kept]
    return gone


def forget_written(spark: SparkSession) -> int:
    """Deletes every table that :func:`written` has left."""
    return release(spark, 0)
