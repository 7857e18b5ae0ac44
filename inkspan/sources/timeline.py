"""Text of the activity log: entries to rows and back."""

from __future__ import annotations

import re
from datetime import datetime

from ..schema import KINDS  # noqa: F401

_HEADER = re.compile(r"^## \[([^\]]*)\]([^|]*)(?:\|(.*))?$")


def parse_header(line: str) -> tuple[datetime | None, str | None, str | None] | None:
    """Time (UTC), kind and object of an entry's header line.

    A line that begins like a header but states no kind or no time that exists
    has no time; without a kind it has no kind either.  Other lines give None.
    """
    if not line.startswith("## ["):
        return None
    m = _HEADER.match(line)
    kind = m[2].strip() if m else ""
    try:
        t = datetime.strptime(m[1].strip(), "%Y-%m-%d %H:%M") if kind else None
    except ValueError:
        t = None
    return t, kind or None, (m[3] or "").strip() or None if m else None


def parse_log(text: str) -> list[tuple[datetime | None, str | None, str | None, str, int]]:
    """(time, kind, object, note, line) of each entry in physical order; escaped header lines are notes."""
    out: list[list] = []
    for n, line in enumerate(text.splitlines(), 1):
        if found := parse_header(line):
            out.append([*found, [], n])
        elif out:
            out[-1][3].append(line[1:] if line.startswith("\\## [") else line)
    return [(t, k, o, "\n".join(note).strip("\n"), n) for t, k, o, note, n in out]


def render_entry(t: datetime, kind: str, obj: str | None, note: str) -> str:
    """An entry's text; note lines that look like headers are escaped."""
    lines = ["\\" + x if x.startswith("## [") else x for x in note.splitlines()]
    return f"## [{t:%Y-%m-%d %H:%M}] {kind}" + (f" | {obj}" if obj else "") + "\n" + "".join(x + "\n" for x in lines) + "\n"
