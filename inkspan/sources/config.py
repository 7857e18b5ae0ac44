"""The store's configuration: the sections of its configuration file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..schema import CONFIG_TYPE
from . import frontmatter as fm

SHAPES = ("string", "int", "bool", "date", "email", "currency", "url")
SECTIONS = ("Agent instructions", "Policies", "Schemas", "Folders")


@dataclass
class FieldSpec:
    name: str
    required: bool = False
    shape: str | None = None
    link_prefix: str | None = None
    default: str | None = None
    enum: list[str] | None = None
    unknown: list[str] = field(default_factory=list)  # modifiers that mean nothing


@dataclass
class Schema:
    line: int = 1
    fields: list[FieldSpec] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    summary_template: str | None = None
    shard: str | None = None


@dataclass
class Config:
    frontmatter: dict = field(default_factory=dict)
    instructions: str = ""
    frozen: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    schemas: dict[str, Schema] = field(default_factory=dict)
    folders: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    problems: list[tuple[str, str, int, str]] = field(default_factory=list)  # severity, code, line, message


def _bullet(line: str) -> str | None:
    m = re.match(r"^\s*[-*]\s+(.*\S)\s*$", line)
    return m[1] if m else None


def _listed(text: str) -> str:
    """A policy bullet's path or type, without its backticks and remark."""
    m = re.match(r"`([^`]+)`", text)
    return (m[1] if m else re.split(r"\s+(?:—|-)\s+", text)[0]).strip()


def _field(text: str) -> FieldSpec:
    m = re.match(r"^([^()]*?)\s*(?:\((.*)\))?\s*(?:—.*)?$", text)
    spec = FieldSpec((m[1] if m else text).strip(" `"))
    modifiers = m[2] if m and m[2] else ""
    # ``enum: a, b`` takes the rest of the parenthesis.
    if e := re.search(r"(?:^|,)\s*enum\s*:\s*(.*)$", modifiers):
        spec.enum = [v.strip() for v in e[1].split(",") if v.strip()]
        modifiers = modifiers[: e.start()]
    for one in (x.strip() for x in modifiers.split(",")):
        if one == "required":
            spec.required = True
        elif one in SHAPES:
            spec.shape = one
        elif one.startswith("link to "):
            spec.link_prefix = one[8:].strip().strip("`").rstrip("/") + "/"
        elif one.startswith("default "):
            spec.default = one[8:].strip()
        elif one:
            spec.unknown.append(one)
    return spec


def schema_problems(kind: str, schema: Schema) -> list[tuple[str, str, int, str]]:
    """What is doubtful in a type's fields: none or repeated names, unknown modifiers, unique keys that may be missing."""
    out, seen = [], set()
    for spec in schema.fields:
        if not spec.name:
            out.append(("warning", "CONFIG_SCHEMA_FIELD", schema.line, f"{kind}: a field without a name"))
            continue
        if spec.name in seen:
            out.append(("warning", "CONFIG_SCHEMA_FIELD", schema.line, f"{kind}: {spec.name} is declared more than once"))
        seen.add(spec.name)
        out += [("info", "CONFIG_SCHEMA_FIELD", schema.line, f"{kind}: {spec.name} has the unknown modifier {x!r}") for x in spec.unknown]
    required = {f.name for f in schema.fields if f.required}
    for name in dict.fromkeys(k for key in schema.unique for k in key):
        if name not in required:
            out.append(("warning", "CONFIG_SCHEMA_FIELD", schema.line, f"{kind}: the unique key field {name} is {'not required' if name in seen else 'not declared'}"))
    return out


def parse(text: str, kind: str = CONFIG_TYPE) -> Config:
    """Reads a configuration file whose frontmatter states the type ``kind``; what it does not know is noted in
    ``problems`` and otherwise passed over."""
    config = Config()
    state, raw, body, line = fm.split(text)
    front = fm.load(raw) if state == fm.OK else None
    config.frontmatter = front or {}
    if fm.scalar(config.frontmatter.get("type")) != kind:
        config.problems.append(("error", "CONFIG_BAD_TYPE", 1, f"the frontmatter's type must be {kind}"))
    for name in ("scope", "owner"):
        if not fm.scalar(config.frontmatter.get(name)):
            config.problems.append(("error", "CONFIG_MISSING_FIELD", 1, f"the frontmatter has no {name}"))
    section = sub = ""
    prose: list[str] = []
    for n, own in enumerate(body.splitlines(), line):
        if m := re.match(r"^##\s+(.*?)\s*$", own):
            section, sub = m[1], ""
            if section not in SECTIONS:
                config.problems.append(("warning", "CONFIG_UNKNOWN_SECTION", n, f"unknown section {section!r}"))
            continue
        if m := re.match(r"^###\s+(.*?)\s*$", own):
            sub = m[1].strip("`")
            if section == "Schemas":
                config.schemas.setdefault(sub, Schema(line=n))
            continue
        if section == "Agent instructions":
            prose.append(own)
        item = _bullet(own)
        if item is None:
            continue
        if section == "Policies" and sub == "Frozen pages":
            config.frozen.append(_listed(item))
        elif section == "Policies" and sub == "Ignored types":
            config.ignored.append(_listed(item))
        elif section == "Schemas" and sub:
            schema = config.schemas[sub]
            key, colon, value = item.partition(":")
            if colon and key.strip() in ("unique", "summary_template", "shard"):
                value = value.strip()
                if key.strip() == "unique":
                    schema.unique.append([v.strip() for v in value.split(",") if v.strip()])
                elif key.strip() == "shard":
                    schema.shard = value if value in ("by-date", "flat") else schema.shard
                else:
                    schema.summary_template = value.strip("\"'")
            else:
                schema.fields.append(_field(item))
        elif section == "Folders":
            path, _, remark = item.partition(" — ") if " — " in item else item.partition(" - ")
            path, bar, display = path.strip().strip("`").partition("|")
            config.folders[path.strip().strip("`").rstrip("/")] = (display.strip(" `") if bar else None, remark.strip() or None)
    for name, schema in config.schemas.items():
        config.problems += schema_problems(name, schema)
    config.instructions = "\n".join(prose).strip()
    return config
