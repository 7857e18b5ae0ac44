"""Frontmatter, links, headings and fences of one markdown file (plain Python, run inside UDFs)."""

from __future__ import annotations

import json
import re
from datetime import datetime

import yaml

from ..schema import LAYERS

STRICT, LOOSE = "strict", "loose"
NONE, OK, OPEN = "none", "ok", "unterminated"


class _Loader(yaml.SafeLoader):
    """Strings, null, booleans, decimal integers and floats only: dates and the like stay as written."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*)$", list("-+0123456789")),
    ("float", r"^(?:[-+]?(?:\.[0-9]+|(?:0|[1-9][0-9]*)(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+.0123456789")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _int(loader, node):
    value = int(node.value)
    return value if -(2**63) <= value < 2**64 else node.value  # wider literals stay exact, as text


def _float(loader, node):
    text = node.value.lower().replace(".inf", "inf").replace(".nan", "nan")
    return float(text)


def _mapping(loader, node):
    loader.flatten_mapping(node)
    out = {}
    for key, value in node.value:
        k = loader.construct_object(key, deep=True)
        if isinstance(k, (list, dict)):
            k = json.dumps(k)
        if k in out:
            raise yaml.YAMLError(f"duplicate key {k!r}")
        out[k] = loader.construct_object(value, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:int", _int)
_Loader.add_constructor("tag:yaml.org,2002:float", _float)
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor(None, lambda l, n: l.construct_mapping(n, True) if isinstance(n, yaml.MappingNode)
                        else l.construct_sequence(n, True) if isinstance(n, yaml.SequenceNode) else n.value)


def split(text: str) -> tuple[str, str | None, str, int]:
    """State, frontmatter text, body and the 1-based line on which the body begins.

    A fence is ``---`` with nothing but blanks after it; a byte order mark
    before the first is passed over.
    """
    own = text[1:] if text.startswith("﻿") else text
    end = own.find("\n")
    if (own if end < 0 else own[:end]).rstrip() != "---":
        return NONE, None, text, 1
    start = at = end + 1 if end >= 0 else len(own)
    line = 2
    while at < len(own):
        end = own.find("\n", at)
        stop = len(own) if end < 0 else end
        if own[at : min(stop, at + 3)] == "---" and own[at:stop].rstrip() == "---":
            return OK, own[start:at], own[stop + 1 :], line + 1
        at, line = stop + 1, line + 1
    return OPEN, None, text, 1


def unfold(value):
    """A YAML flow ``[[x]]`` is a link again: a sequence of one sequence of one string becomes its text."""
    if isinstance(value, list):
        if len(value) == 1 and isinstance(value[0], list) and len(value[0]) == 1 and isinstance(value[0][0], str):
            return f"[[{value[0][0]}]]"
        return [unfold(v) for v in value]
    if isinstance(value, dict):
        return {k: unfold(v) for k, v in value.items()}
    return value


_NAME = r"[A-Za-z][\w-]{0,99}"
_PLAIN = r"(?:[\w./+]|-(?=[\w.]))(?:[\w./+@,;()#|'=*&!~-]|:(?=[\w./+@-])|(?<=[^ ]) +(?=[\w./+@(]|-[\w.]))*"  # no comment, no mapping, no mark at its start
_ITEM = r"[\w.+][\w./+@-]*(?: [\w./+@-]+)*"
_QUOTED = r"\"[\w \[\]{}()|/.,;:#@!?'&*=+<>~%$^`-]*\""
_SIMPLE_LINE = re.compile(rf"({_NAME}):(?: +(?:({_PLAIN})|({_QUOTED})|\[({_ITEM}(?:, {_ITEM})*)?\]))? *")
_SIMPLE_ITEM = re.compile(rf"( *)- (?:({_PLAIN})|({_QUOTED})) *")


def _plain(text: str):
    """The value of a plain scalar, by the loader's own rules."""
    for tag, pattern in _Loader.yaml_implicit_resolvers.get(text[0], ()):
        if pattern.match(text):
            return _Loader.yaml_constructors[tag](_Loader(""), yaml.ScalarNode(tag, text))
    return text


def simple(fm: str) -> dict | None:
    """The mapping of a frontmatter in which each line is a key with a scalar or a flow list of scalars, or an item of a
    key's list; None for any other text, which is the YAML library's.  It is the same mapping, forty times as fast."""
    out: dict = {}
    key = indent = None  # the key whose list may go on, and how its items stand
    for line in fm.removesuffix("\n").split("\n"):
        if len(line) > 1000:
            return None
        if m := _SIMPLE_LINE.fullmatch(line):
            name, plain, quoted, flow = m.groups()
            if name in out or _plain(name) is not name:
                return None
            key = indent = None
            if plain is not None:
                out[name] = _plain(plain)
            elif quoted is not None:
                out[name] = quoted[1:-1]
            elif line.rstrip(" ").endswith("]"):
                out[name] = [_plain(x) for x in flow.split(", ")] if flow else []
            else:
                out[name], key = None, name
        elif key is not None and (m := _SIMPLE_ITEM.fullmatch(line)) and indent in (None, len(m[1])):
            indent = len(m[1])
            if out[key] is None:
                out[key] = []
            out[key].append(_plain(m[2]) if m[2] is not None else m[3][1:-1])
        else:
            return None
    return out


def parsed(fm: str | None):
    """What a frontmatter text says, by YAML's rules; errors are the library's."""
    found = simple(fm) if fm else None
    return yaml.load(fm or "", _Loader) if found is None else found  # noqa: S506 - a safe loader


def load(fm: str | None) -> dict | None:
    """The mapping of a frontmatter text; None if it is malformed or no mapping.  Empty text is empty."""
    try:
        value = parsed(fm)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None
    if value is None:
        return {}
    return {k: unfold(v) for k, v in value.items()} if isinstance(value, dict) else None


def scalar(value) -> str | None:
    """Text of a string, number or boolean; None for anything else."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return json.dumps(value)
    return None


def listed(value) -> list[str]:
    """A scalar or a list of scalars as a list of texts."""
    items = value if isinstance(value, list) else [value]
    return [t for t in map(scalar, items) if t is not None]


def tokens(value) -> list[tuple[str, str, float | None]]:
    """(kind, text, number) of every scalar in a value, lists taken apart; null and mappings have none."""
    if isinstance(value, list):
        return [t for v in value for t in tokens(v)]
    if isinstance(value, bool):
        return [("bool", scalar(value), None)]
    if isinstance(value, int):
        return [("int", str(value), float(value))]
    if isinstance(value, float):
        return [("float", scalar(value), value)]
    return [("string", value, None)] if isinstance(value, str) else []


UNIVERSAL = ("type", "summary", "tags", "links", "created", "updated")
_RFC3339 = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})")


def instant(text) -> datetime | None:
    """The instant of an RFC 3339 string (other scalars are no times), as naive UTC."""
    if not isinstance(text, str) or not _RFC3339.fullmatch(text):
        return None
    try:
        t = datetime.fromisoformat(text.upper().replace("Z", "+00:00"))
        return (t - t.utcoffset()).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None


def record(path: str, fm: dict) -> dict:
    """A file's catalogue row: typed fields, and the rest as canonical JSON and tokens."""
    folders = path.split("/")
    rest = {k: v for k, v in fm.items() if isinstance(k, str) and k not in UNIVERSAL}
    if folders[0] == "records":
        rest.setdefault("meta-type", "fact")
    summary = scalar(fm.get("summary"))
    return {
        "type": scalar(fm.get("type")) or "",
        "summary": summary if summary else "(no summary)",
        "tags": listed(fm["tags"]) if fm.get("tags") is not None else [],
        "links": listed(fm["links"]) if fm.get("links") is not None else [],
        "created_raw": fm["created"] if instant(fm.get("created")) else None,
        "created": instant(fm.get("created")),
        "updated_raw": fm["updated"] if instant(fm.get("updated")) else None,
        "updated": instant(fm.get("updated")),
        "fields_json": json.dumps(dict(sorted(rest.items())), ensure_ascii=False, separators=(",", ":"), default=str),
        "tokens": {k: [dict(zip(("kind", "text", "num"), t)) for t in tokens(v)] for k, v in rest.items()},
    }


_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})(.*)$")


class Fence:
    """Whether lines lie in a code fence: as many marks of the opening kind close it."""

    def __init__(self) -> None:
        self.open: str | None = None

    def inside(self, line: str) -> bool:
        """Takes a line; true for a fence's own lines too."""
        m = _FENCE.match(line)
        if self.open is None:
            if m and not (m[2][0] == "`" and "`" in m[3]):
                self.open = m[2]
                return True
            return False
        if m and m[2][0] == self.open[0] and len(m[2]) >= len(self.open) and not m[3].strip():
            self.open = None
        return True


_LINK = re.compile(r"\[\[([^\[\]\n]*?)\]\]")


def _links(line: str):
    for m in _LINK.finditer(line):
        target, bar, alias = m[1].partition("|")
        target = target.strip()
        if target and not target.startswith("["):
            yield target, (alias.strip() if bar else None), m


_KEY = re.compile(r"([^\s#\[\]{}:-][^:]*?)\s*:(?:\s|$)")
_WIKI = re.compile(r"\[\[([^\[\]|]+?)(?:\|([^\[\]]*))?\]\]")


def wiki_links(text: str) -> list[dict]:
    """Every ``[[target|display]]`` of a text as written, fences or not, with its line and column (in characters, from
    1), whether its target begins with a layer and whether it has the extension."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        for m in _WIKI.finditer(line):
            own = m[1].strip()
            out.append({"target": m[1], "display": m[2], "line": n, "column": m.start() + 1, "is_full_path": "/" in own and own.split("/")[0] in LAYERS, "has_extension": own.endswith(".md")})
    return out


def link_fields(raw: str | None) -> list[tuple[str, str, str | None]]:
    """(key, target, display) of each field that is a link or a list of links; of a summary's links, all.

    Lists of unquoted links, which YAML reads as nested lists, are left out.
    """
    try:
        front = parsed(raw)
    except (yaml.YAMLError, ValueError, RecursionError):
        return []
    if not isinstance(front, dict):
        return []
    out = [("summary", x["target"], x["display"]) for x in wiki_links(front["summary"])] if isinstance(front.get("summary"), str) else []
    for key, value in front.items():
        value = unfold(value) if isinstance(value, list) and len(value) == 1 else value
        if key in ("type", "id", "created", "updated", "summary", "status", "tags", "meta-type"):
            continue
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, str) and (m := _WIKI.fullmatch(item.strip())):
                out.append((str(key), m[1], m[2]))
    return out


def canonical(target: str) -> str:
    target = target.strip().replace("\\", "/")
    while target.startswith("./"):
        target = target[2:]
    return target.lstrip("/").removesuffix(".md").strip()


def edges(text: str) -> list[dict]:
    """Every link of a file: frontmatter lines, then body lines outside code fences, duplicates kept.

    ``start`` and ``end`` are byte offsets into the body (null in frontmatter);
    ``key`` is the field that a frontmatter line belongs to (null in the body).
    """
    import unicodedata

    state, fm, body, body_line = split(text)
    out = []

    def add(region, line, start, end, target, alias, raw, key=None):
        out.append({
            "target": target, "dst_key": unicodedata.normalize("NFC", canonical(target)), "region": region, "line": line,
            "start": start, "end": end, "raw": raw, "alias": alias, "key": key,
        })

    if state == OK:
        key = None
        for n, line in enumerate(fm.split("\n"), 2):
            if found := _KEY.match(line):
                key = found[1].strip("\"'")
            for target, alias, m in _links(line):
                add("fm", n, None, None, target, alias, m[0], key)
    fence, at = Fence(), 0
    for n, line in enumerate(body.split("\n"), body_line):
        if not fence.inside(line.rstrip("\r")):
            for target, alias, m in _links(line):
                start = at + len(line[: m.start()].encode())
                add("body", n, start, start + len(m[0].encode()), target, alias, m[0])
        at += len(line.encode()) + 1
    return out


_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")


def headings(body: str, first_line: int = 1) -> list[tuple[int, str, int]]:
    """(level, text, line) of ATX headings outside code fences."""
    fence, out = Fence(), []
    for n, line in enumerate(body.splitlines(), first_line):
        if not fence.inside(line) and (m := _HEADING.match(line)):
            text = (m[2] or "").strip()
            out.append((len(m[1]), "" if re.fullmatch("#+", text) else text, n))
    return out


def sections(text: str) -> list[dict]:
    """Sections of second level and below: heading, level, file line, body up to the next of its level or above."""
    _, _, body, body_line = split(text)
    lines = body.splitlines(keepends=True)
    found = headings(body, body_line)
    out = []
    for k, (level, name, line) in enumerate(found):
        if level < 2:
            continue
        end = next((n for lv, _, n in found[k + 1 :] if lv <= level), body_line + len(lines))
        out.append({"heading": name, "level": level, "line": line, "body": "".join(lines[line - body_line + 1 : end - body_line]).strip("\n")})
    return out


def first_h1(text: str) -> str | None:
    return next((t for level, t, _ in headings(split(text)[2]) if level == 1 and t), None)


def first_paragraph(body: str) -> str:
    """The first paragraph that is no heading (of either style), nor a leading code fence."""
    fence, taken = Fence(), []
    lines = body.splitlines()
    for k, line in enumerate(lines):
        if fence.inside(line):
            if taken:
                break
            continue
        if not line.strip():
            if taken:
                break
            continue
        if _HEADING.match(line):
            if taken:
                break
            continue
        if k + 1 < len(lines) and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", lines[k + 1]) and not taken:
            continue
        if re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line):
            if taken:
                break
            continue
        taken.append(line.strip())
    return " ".join(taken)


def reduced(value) -> str:
    """A field as a summary shows it: a link by its display or last component, a list joined by commas."""
    if isinstance(value, list):
        return ", ".join(x for x in map(reduced, value) if x)
    text = scalar(value)
    if text is None:
        return ""
    m = re.fullmatch(r"\s*\[\[([^\]|]*)(?:\|([^\]]*))?\]\]\s*", text)
    return (m[2] or m[1].rstrip("/").split("/")[-1]).strip() if m else text


def render_template(template: str, fields: dict) -> str:
    """``{field}`` by its reduced value; a brace without a field stays."""
    return re.sub(r"\{([\w-]+)\}", lambda m: reduced(fields.get(m[1])), template)


def default_summary(template: str | None, fields: dict, body: str, most: int = 200) -> str:
    text = render_template(template, fields) if template else ""
    text = " ".join((text if text.strip() else first_paragraph(body)).split())
    return text[:most]


ORDER = ("type", "meta-type", "id", "created", "updated", "summary")
LAST = ("status", "tags")


def render(fm: dict, body: str) -> str:
    """Canonical file text: known keys first, others sorted, status and tags last."""
    keys = [k for k in ORDER if k in fm] + sorted(k for k in fm if k not in ORDER + LAST) + [k for k in LAST if k in fm]

    def flow(v) -> str:
        if isinstance(v, str):
            plain = yaml.load(v, _Loader) if re.fullmatch(r"[\w./@+ -]+", v) and v == v.strip() and not re.match(r"[-?] ", v) else None
            return v if plain == v else json.dumps(v, ensure_ascii=False)
        if isinstance(v, dict):
            return "{" + ", ".join(f"{flow(str(k))}: {flow(x)}" for k, x in v.items()) + "}"
        if isinstance(v, list):
            return "[" + ", ".join(map(flow, v)) + "]"
        return json.dumps(v)

    out = ["---\n"]
    for k in keys:
        v = fm[k]
        if isinstance(v, list) and v and k != "tags":
            out.append(f"{k}:\n" + "".join(f"  - {flow(x)}\n" for x in v))
        else:
            out.append(f"{k}: {flow(v)}\n")
    return "".join(out) + "---\n" + body


def rewrite_links(text: str, old: str, new: str) -> str:
    """Retargets ``[[old]]`` to ``[[new]]`` in frontmatter and outside code fences; displays and all else stay."""
    import unicodedata

    same = unicodedata.normalize("NFC", canonical(old))

    def put(m: re.Match) -> str:
        target, bar, alias = m[1].partition("|")
        return f"[[{canonical(new)}{bar}{alias}]]" if unicodedata.normalize("NFC", canonical(target)) == same else m[0]

    state, fm, _, body_line = split(text)
    fence, out = Fence(), []
    for n, line in enumerate(text.split("\n"), 1):
        fenced = n >= body_line and fence.inside(line.rstrip("\r"))
        out.append(line if fenced else _LINK.sub(put, line))
    return "\n".join(out)
