"""The relations that every operator reads or writes."""

from __future__ import annotations

FILES = (
    "path string, parts array<string>, layer string, type_folder string, is_loose boolean, size long, "
    "content binary, text string, utf8_ok boolean, fm_state string, fm_yaml string, body string, body_line int"
)
TOKEN = "struct<kind:string,text:string,num:double>"
RECORDS = (
    "path string, parts array<string>, layer string, type_folder string, type string, summary string, "
    "tags array<string>, links array<string>, created_raw string, created timestamp, updated_raw string, "
    f"updated timestamp, fields_json string, tokens map<string,array<{TOKEN}>>"
)
EDGES = (
    "src string, target string, dst_key string, region string, line int, start int, end int, raw string, alias string, key string"
)
LOG = "ts timestamp, ym string, kind string, object string, note string, file string, ordinal long"
ISSUES = (
    "severity string, code string, file string, line int, key string, message string, suggestion string, "
    "related array<string>"
)
ASSETS = "path string, sha256 string, bytes long, media_type string, wrappers array<string>, required boolean"
LAYERS = ("sources", "records")
#: The titles of generated pages.
INDEX_TITLE, LOG_TITLE = "Knowledge base index", "Curator log"
#: The kinds of log entries, and of these the ones that change an object.
KINDS = ("ingest", "create", "update", "delete", "rename", "link", "validate", "index-rebuild", "contradiction")
MUTATING = ("ingest", "create", "update", "delete", "rename", "link")
#: What a record may be.
META_TYPES = ("fact", "operational", "conclusion")
#: The name of a store's configuration file and the type that its frontmatter states, unless a caller passes others.
CONFIG_FILE, CONFIG_TYPE = "STORE.md", "store"
META_FILES = ("index.md", CONFIG_FILE, "log.md")
