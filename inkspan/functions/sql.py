"""The library's functions on a session's SQL surface."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import frontmatter as fm

#: Scalar functions as SQL expressions over ``x``.
SCALARS = {
    "ink_collapse": ("STRING", r"trim(regexp_replace(x, '(?U)\\s+', ' '))"),
    "ink_summary": ("STRING", r"substring(trim(regexp_replace(x, '(?U)\\s+', ' ')), 1, 200)"),
    "ink_capitalize": ("STRING", "concat(upper(substring(x, 1, 1)), substr(x, 2))"),
    "ink_slug": ("STRING", r"regexp_replace(regexp_replace(lower(x), '(?U)\\s', '-'), '(?U)[^\\p{Alnum}/_-]', '')"),
    "ink_target": ("STRING", r"trim(regexp_replace(regexp_replace(regexp_replace(replace(trim(x), '\\', '/'), '^(?:[.]/)+', ''), '^/+', ''), '[.]md$', ''))"),
    "ink_type_folder": ("STRING", "CASE WHEN size(split(x, '/')) >= 3 THEN array_join(slice(split(x, '/'), 1, 2), '/') END"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers scalar functions, and table functions over a text, for this session's SQL; their names.

    ``ink_collapse``, ``ink_summary``, ``ink_capitalize``, ``ink_slug``,
    ``ink_target`` and ``ink_type_folder`` take a string and are plain SQL
    expressions.  ``ink_links(text)`` gives a file's links, ``ink_wiki_links``
    every link as written, ``ink_sections`` its sections, a row each; used
    with LATERAL.  Null texts have no rows.
    """
    for name, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")

    @F.udtf(returnType="target string, dst_key string, region string, line int, start int, end int, raw string, alias string, key string")
    class Links:
        def eval(self, text: str) -> Iterator[tuple]:
            for e in fm.edges(text or ""):
                yield tuple(e[k] for k in ("target", "dst_key", "region", "line", "start", "end", "raw", "alias", "key"))

    @F.udtf(returnType="target string, display string, line int, column int, is_full_path boolean, has_extension boolean")
    class WikiLinks:
        def eval(self, text: str) -> Iterator[tuple]:
            for e in fm.wiki_links(text or ""):
                yield tuple(e[k] for k in ("target", "display", "line", "column", "is_full_path", "has_extension"))

    @F.udtf(returnType="heading string, level int, line int, body string")
    class Sections:
        def eval(self, text: str) -> Iterator[tuple]:
            for e in fm.sections(text or ""):
                yield tuple(e[k] for k in ("heading", "level", "line", "body"))

    tables = {"ink_links": Links, "ink_wiki_links": WikiLinks, "ink_sections": Sections}
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return [*SCALARS, *tables]
