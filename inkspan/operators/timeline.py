"""The activity log."""

from __future__ import annotations

import os
from collections import Counter
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.path import is_safe
from ..functions.time import bound
from ..schema import KINDS, LOG_TITLE, MUTATING
from ..sources.timeline import parse_log, render_entry



def tail(log: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """The ``n`` newest entries, oldest first; of equal times the physically later ones."""
    rows = log.filter("ts is not null") if kind is None else log.filter(F.col("ts").isNotNull() & (F.col("kind") == kind))
    return rows.orderBy(F.desc_nulls_last("ts"), F.desc("ordinal")).limit(n).orderBy("ts", "ordinal")


def since(log: DataFrame, text: str) -> DataFrame:
    """Entries strictly newer than a bound, in physical order; month archives before it are pruned."""
    t = bound(text)
    return log.filter((F.col("ym") >= t.astimezone(UTC).strftime("%Y-%m")) & (F.col("ts") > F.lit(t))).orderBy("ordinal")


def by_month(log: DataFrame) -> DataFrame:
    return log.groupBy("ym").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def last_validate_physical(log: DataFrame) -> DataFrame:
    """The time of the physically last ``validate`` entry."""
    return log.filter("kind = 'validate'").agg(F.max_by("ts", "ordinal").alias("ts"))


def last_validate(log: DataFrame) -> DataFrame:
    """The largest time of a ``validate`` entry."""
    return log.filter("kind = 'validate'").agg(F.max("ts").alias("ts"))


def changed_since(log: DataFrame, cutoff: Column) -> DataFrame:
    """``object``: what mutating entries at or after ``cutoff`` name, safe paths only, each once."""
    name = F.regexp_replace(F.trim(F.regexp_replace(F.trim("object"), r"^(?:\[\[)+|(?:\]\])+$|\|.*$", "")), r"(?:\.md)+$", "")
    return log.filter(F.col("kind").isin(*MUTATING) & (F.col("ts") >= cutoff)).select(name.alias("object")).filter((F.col("object") != "") & is_safe(F.col("object"))).distinct()


def working_set(log: DataFrame, edges: DataFrame, cutoff: Column) -> DataFrame:
    """``path``: changed objects and the files that link to them."""
    from .graph import linkers_of_any

    changed = changed_since(log, cutoff).select(F.col("object").alias("path"))
    return changed.union(linkers_of_any(edges, changed)).distinct()


def out_of_order(log: DataFrame) -> DataFrame:
    """Entries older than the last valid time before them, across files in their order.

    A file's own entries are one window; what its first ones follow comes from
    the files before, of which there is one row each.
    """
    timed = log.filter("ts is not null")
    ends = timed.groupBy("file").agg(F.min("ordinal").alias("start"), F.max_by("ts", "ordinal").alias("end"))
    follows = F.broadcast(ends.select("file", F.lag("end").over(Window.orderBy("start")).alias("follows")))  # a row a file
    before = F.coalesce(F.lag("ts").over(Window.partitionBy("file").orderBy("ordinal")), F.col("follows"))
    return timed.join(follows, "file").withColumn("before", before).filter(F.col("ts") < F.col("before")).select(*log.columns)


def unknown_kinds(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("kind").isin(*KINDS))


def not_in(log: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of one log that another with the same columns lacks, repeats counted: what is still to be archived."""
    return log.exceptAll(other.select(log.columns))


def page(feed: DataFrame, after: int, limit: int) -> DataFrame:
    """Entries with a ``seq`` past ``after``, 1 to 100 of them."""
    return feed.filter(F.col("seq") > after).orderBy("seq").limit(min(max(limit, 1), 100))


def append(root: str, kind: str, obj: str | None, note: str, now: datetime | None = None) -> None:
    """Appends an entry; entries of earlier months in ``log.md`` move to their month's archive first.

    A lock on the store's folder keeps writers apart, and files are replaced whole.
    """
    import fcntl

    now = now or datetime.now(UTC).replace(tzinfo=None)
    path = os.path.join(root, "log.md")
    with open(os.path.join(root, ".log.lock"), "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        text = open(path, encoding="utf-8").read() if os.path.exists(path) else f"---\ntype: log\n---\n\n# {LOG_TITLE}\n\n"
        entries = parse_log(text)
        head = "".join(text.splitlines(keepends=True)[: entries[0][4] - 1]) if entries else text
        lines = text.splitlines(keepends=True)
        ends = [e[4] - 1 for e in entries[1:]] + [len(lines)]
        old: dict[str, list[str]] = {}
        kept = ""
        for (t, k, o, n, line), end in zip(entries, ends):
            if t is None:  # a time that does not exist has no month: the entry stays as it is written
                own = "".join(lines[line - 1 : end])
                kept += own if own.endswith("\n") else own + "\n\n"
            elif t.strftime("%Y-%m") < now.strftime("%Y-%m"):
                old.setdefault(t.strftime("%Y-%m"), []).append(render_entry(t, k, o, n))
            else:
                kept += render_entry(t, k, o, n)
        os.makedirs(os.path.join(root, "log"), exist_ok=True)
        names = {month: os.path.join(root, "log", f"{month}.md") for month in old}
        have = {m: open(x, encoding="utf-8").read() if os.path.exists(x) else "---\ntype: log\n---\n\n" for m, x in names.items()}
        # A writer that broke off after the archives left its mark, and they hold all that is to move.
        mark = os.path.join(root, "log", ".rotating")
        archived = {m: Counter(render_entry(t, k, o, n) for t, k, o, n, _ in parse_log(x) if t is not None) for m, x in have.items()}
        if not (os.path.exists(mark) and all(not Counter(moved) - archived[m] for m, moved in old.items())):
            if old:
                _replace(mark, "")
            for month, moved in old.items():
                _replace(names[month], have[month] + "".join(moved))
        _replace(path, head + kept + render_entry(now, kind, obj, note))
        if os.path.exists(mark):
            os.remove(mark)


def _replace(path: str, text: str) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".tmp", path)
