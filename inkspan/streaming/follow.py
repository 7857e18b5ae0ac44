"""Streams: following a feed's head, and keeping the catalogue up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _advanced(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    top = None
    for batch in batches:
        if len(batch):
            m = int(batch["seq"].max())
            top = m if top is None else max(top, m)
    if top is not None and (last is None or top > last):
        state.update((top,))
        yield pd.DataFrame({"brain": [key[0]], "seq": [top], "previous": pd.array([last], dtype="Int64")})


def heads(feed: DataFrame) -> DataFrame:
    """``(brain, seq, previous)``: a row whenever a feed's largest ``seq`` advances.

    ``feed`` is a stream of ``(brain, seq)``.  The state is one number a brain;
    late rows are taken, never dropped, and change nothing.
    """
    return feed.select("brain", F.col("seq").cast("long")).groupBy("brain").applyInPandasWithState(
        _advanced, "brain string, seq long, previous long", "seq long", "update", GroupStateTimeout.NoTimeout
    )


def feed(spark: SparkSession, path: str, schema: str = "brain string, seq long, kind string, object string, at timestamp") -> DataFrame:
    """A feed as a stream: a folder of JSON-lines files that grows, each line an entry; lines that are none are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("seq is not null")


def subscribe(entries: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, since: int | None = None, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Hands each batch of entries past ``since`` to ``sink``, in ``seq`` order.

    ``once`` takes what is there and ends; else the stream goes on, a batch
    ``every`` so often.  What was handed on is known from ``checkpoint``, so a
    restart goes on where it stopped and repeats at most one batch under its
    own number.
    """
    rows = entries if since is None else entries.filter(F.col("seq") > since)

    def ordered(batch: DataFrame, n: int) -> None:
        sink(batch.orderBy("seq"), n)

    writer = rows.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _closing(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n = state.get[0] if state.exists else 0
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"ym": [key[0]], "kind": [key[1]], "n": [n]})
        return
    state.update((n + sum(len(b) for b in batches),))
    end = pd.Timestamp(f"{key[0]}-01", tz="UTC") + pd.offsets.MonthBegin(1)
    state.setTimeoutTimestamp(int(end.timestamp() * 1000))


def by_month(log: DataFrame, delay: str | None = None) -> DataFrame:
    """``(ym, kind, n)``: entries by calendar month of a stream of log rows.

    Without a ``delay`` counts grow for ever (update or complete mode).  With
    one a month's count comes out once, when the watermark has passed the
    month's end (append mode); its state, one number a month and kind, then
    goes.  Rows later than the watermark are dropped.
    """
    ym = F.date_format("ts", "yyyy-MM").alias("ym")
    if not delay:
        return log.groupBy(ym, "kind").agg(F.count("*").alias("n"))
    return log.withWatermark("ts", delay).select("ts", "kind", ym).groupBy("ym", "kind").applyInPandasWithState(
        _closing, "ym string, kind string, n long", "n long", "append", GroupStateTimeout.EventTimeTimeout
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def upsert_table(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: keeps the last row of each key in a table of numbered versions.

    Version n + 1 is written whole from version n and the batch, and a batch
    that is repeated writes its version again, so each counts once.
    """
    from ..operators.catalog import last_write_wins

    def sink(batch: DataFrame, n: int) -> None:
        rows = batch
        if n > 0:
            rows = batch.sparkSession.read.parquet(f"{path}/v{n - 1}").unionByName(batch)
        last_write_wins(rows, key, F.col(order)).write.mode("overwrite").parquet(f"{path}/v{n}")

    return sink
