"""Text functions (Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_MOST = 200


def collapse_whitespace(c: Column) -> Column:
    """Runs of Unicode white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, most: int = SUMMARY_MOST) -> Column:
    return F.substring(c, 1, most)


def normalize_summary(c: Column, most: int = SUMMARY_MOST) -> Column:
    return truncate(collapse_whitespace(c), most)


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def display_name(folder: Column) -> Column:
    """A folder's last name with hyphens and underscores as spaces, first letter upper."""
    return capitalize(F.translate(F.element_at(F.split(folder, "/"), -1), "-_", "  "))


def slug(c: Column) -> Column:
    """Lower case, white space as hyphens, only alphanumerics, ``-``, ``/`` and ``_`` left."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s", "-"), r"(?U)[^\p{Alnum}/_-]", "")


def heading_level(line: Column) -> Column:
    """1 to 6 for an ATX heading line, else 0."""
    return F.length(F.regexp_extract(line, r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))


def heading_text(line: Column) -> Column:
    """An ATX heading's text without its closing run of marks."""
    inner = F.regexp_extract(line, r"^ {0,3}#{1,6}(?:[ \t]+|$)(.*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?:^|[ \t]+)#+[ \t]*$", ""), r"^[ \t]+|[ \t]+$", ""))


def lines(text: Column) -> Column:
    """Lines without their ends; a final line feed ends the last line, it starts no other."""
    cut = F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def sanitize(c: Column) -> Column:
    """Terminal control sequences and control characters go; tabs and line feeds stay."""
    bare = F.regexp_replace(c, "\\x1b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\\\\\)|[@-Z\\\\\\\\-_])", "")
    return F.regexp_replace(bare, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def sanitize_line(c: Column) -> Column:
    return F.regexp_replace(sanitize(c), r"[\n\t]", " ")


def normalize_extracted(c: Column) -> Column:
    """Unix line ends, no trailing blanks on a line, one blank line at most, one final line feed."""
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    trimmed = F.regexp_replace(unix, r"(?m)[ \t]+$", "")
    squeezed = F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return F.when(squeezed == "", "").otherwise(F.concat(squeezed, F.lit("\n")))


def markdown_links(text: Column) -> Column:
    """Arrays of texts and urls of ``[text](url)`` links, as structs."""
    pattern = r"(?<!\[)\[([^\[\]]*)\]\(([^()\s]*)\)"
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("text"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("url"),
    )


def wiki_targets(text: Column) -> Column:
    """Targets of every ``[[target|display]]`` in appearance order, duplicates kept (not fence-aware)."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda x: x != "")


def ordered_distinct(a: Column) -> Column:
    """Distinct items in first-appearance order."""
    return F.array_distinct(a)


def sorted_set_token(a: Column) -> Column:
    """A list as one comparable token: distinct items, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(a)), ",")


def lossy_utf8(content: Column) -> Column:
    """Text of bytes, U+FFFD for what is no UTF-8."""
    return F.make_valid_utf8(content.cast("string"))
