"""Paths inside a store (Column to Column), and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LAYERS, META_FILES

#: The folder of each canonical type.
TYPE_FOLDERS = {
    "email": "sources/emails",
    "transcript": "sources/transcripts",
    "pdf-source": "sources/docs",
    "note": "sources/notes",
    "contact": "records/contacts",
    "company": "records/companies",
    "expense": "records/expenses",
    "invoice": "records/invoices",
    "meeting": "records/meetings",
    "decision": "records/decisions",
    "profile": "records/profiles",
    "project": "records/projects",
    "concept": "records/concepts",
    "synthesis": "records/synthesis",
}
FOLDER_TYPES = {folder: kind for kind, folder in TYPE_FOLDERS.items()}
#: Types that are kept in year and month folders unless a schema says otherwise.
SHARDED = ("email", "transcript", "pdf-source", "note", "expense", "invoice", "meeting", "order", "ticket", "transaction")


def parts(path: Column) -> Column:
    """Components of a path: ordering by them is the store's order."""
    return F.split(path, "/")


def layer(path: Column) -> Column:
    first = F.element_at(parts(path), 1)
    return F.when(first.isin(*LAYERS), first)


def type_folder(path: Column) -> Column:
    """Layer and folder of a path; null for a file directly in its layer."""
    p = parts(path)
    return F.when(F.size(p) >= 3, F.array_join(F.slice(p, 1, 2), "/"))


def is_content(path: Column) -> Column:
    """Markdown under a layer that is no generated or hidden file."""
    p = parts(path)
    name = F.element_at(p, -1)
    return (
        layer(path).isNotNull() & (F.size(p) >= 2) & path.endswith(".md") & ~name.isin(*META_FILES)
        & ~F.exists(p, lambda x: x.startswith("."))
    )


def is_safe(path: Column) -> Column:
    """Relative, of plain components only."""
    return ~F.exists(parts(path), lambda x: x.isin("", ".", "..")) & ~path.rlike(r"^[A-Za-z]:|^\\|\\")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(parts(path), -1), r"\.md$", "")


def bare(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def infer_type(path: Column) -> Column:
    """The type that a file's folder stands for; null for loose files."""
    folder = type_folder(path)
    known = F.coalesce(*[F.when(folder == f, F.lit(t)) for f, t in FOLDER_TYPES.items()])
    return F.when(folder.isNotNull(), F.coalesce(known, F.element_at(parts(path), 2)))


def default_folder(kind: Column) -> Column:
    known = F.coalesce(*[F.when(kind == t, F.lit(f)) for t, f in TYPE_FOLDERS.items()])
    return F.coalesce(known, F.concat(F.lit("records/"), kind))


def layer_for_type(kind: str) -> str:
    return TYPE_FOLDERS.get(kind, f"records/{kind}").split("/")[0]


def glob_regex(glob: str) -> str:
    """An anchored regex of a path glob: ``*`` within a component, ``**`` for any number of whole ones.

    Every other character stands for itself.  A leading ``./`` or ``/`` and a
    final ``.md`` do not matter.
    """
    glob = re.sub(r"\.md$", "", re.sub(r"^(?:\./|/)+", "", glob.strip()))
    out = []
    pieces = [p for k, p in enumerate(glob.split("/")) if not (p == "**" and glob.split("/")[k - 1 : k] == ["**"])]
    for k, piece in enumerate(pieces):
        last = k == len(pieces) - 1
        if piece == "**" and last and out:
            out[-1] = out[-1].removesuffix("/") + "(?:/.*)?"  # no component at all, too
            continue
        if piece == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
            continue
        body = "".join("[^/]*" if c == "*" else re.escape(c) for c in piece)
        out.append(body + ("" if last else "/"))
    return "^" + "".join(out) + r"(?:\.md)?$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    clean = F.regexp_replace(path, r"^(?:\./|/)+", "")
    found = F.lit(False)
    for g in globs:
        found = found | clean.rlike(glob_regex(g))
    return found


def media_type(path: Column) -> Column:
    """Media type by a name's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [F.lit(x) for item in MEDIA_TYPES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), F.lit("application/octet-stream"))


#: Media types by extension.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "heic": "image/heic",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "mp3": "audio/mpeg",
    "m4a": "audio/mp4",
    "wav": "audio/wav",
    "mp4": "video/mp4",
    "mov": "video/quicktime",
    "webm": "video/webm",
    "txt": "text/plain",
    "csv": "text/csv",
    "md": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "json": "application/json",
    "xml": "application/xml",
    "zip": "application/zip",
    "gz": "application/gzip",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "epub": "application/epub+zip",
    "eml": "message/rfc822",
}
