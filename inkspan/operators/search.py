"""Hybrid search: candidates by structure and links, then a regex over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.match import check_regex
from .graph import backlinks, forwardlinks
from .query import check_layer, filtered


def match_lines(files: DataFrame, pattern: str, text: str = "text", order: str = "parts", keep: tuple[str, ...] = ("path", "parts"),
                limit: int | None = None, ordered: bool = True) -> DataFrame:
    """``(*keep, line, text)`` of every line that the pattern matches, in file and line order.

    Each line meets the pattern once, in its file's row: only matching lines
    become rows.  What follows a NUL byte is not searched.  A global order
    reads the files twice (for its ranges and for its rows): ``ordered=False``
    leaves it out where a ``limit`` does not ask for it.
    """
    regex = check_regex(pattern)
    clean = F.substring_index(F.col(text), "\0", 1)
    numbered = F.transform(T.lines(clean), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hits = files.select(*keep, F.explode(F.filter(numbered, lambda x: x["text"].rlike(regex))).alias("hit"))
    out = hits.select(*keep, "hit.line", "hit.text")
    if ordered or limit is not None:
        out = out.orderBy(order, "line")
    return out if limit is None else out.limit(limit)


def candidates(records: DataFrame, edges: DataFrame, *, type: str | None = None, layer: str | None = None, wheres=(), links_to: str | None = None,
               linked_from: str | None = None, sets: list[DataFrame] | None = None, **windows) -> DataFrame | None:
    """Paths to search, or None for every file: the intersection of what each given structure selects, and of ``sets(path)``."""
    sets = list(sets or [])
    if type is not None or wheres or any(windows.values()):
        sets.append(filtered(records, type=type, wheres=wheres, **windows).select("path"))
    if links_to is not None:
        sets.append(backlinks(edges, links_to).select(F.concat("src", F.lit(".md")).alias("path")))
    if linked_from is not None:
        sets.append(forwardlinks(edges, linked_from).select(F.concat("target", F.lit(".md")).alias("path")))
    found = None
    for s in sets:
        found = s if found is None else found.join(s, "path", "left_semi")
    return found


def search(files: DataFrame, records: DataFrame, edges: DataFrame, pattern: str, *, layer: str | None = None, limit: int | None = None,
           ordered: bool = True, **structure) -> DataFrame:
    """``(path, line, text)`` of matching lines in the files that every given structure selects.

    The semi-joins stand below the line scan: Catalyst would not move them there.
    """
    check_layer(layer)
    check_regex(pattern)
    rows = files.filter(F.col("layer") == layer) if layer else files
    paths = candidates(records, edges, **structure)
    if paths is not None:
        rows = rows.join(paths, "path", "left_semi")
    return match_lines(rows, pattern, limit=limit, ordered=ordered).drop("parts")
