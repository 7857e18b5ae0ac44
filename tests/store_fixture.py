"""A small store of our own, with one file for each thing that tests look at."""

import os

DB = """---
type: store
scope: team
owner: Ada
---

# Lab

## Agent instructions

Be brief.

## Policies

### Frozen pages
- `records/notes/plan.md` — signed.

### Ignored types
- `temp`

## Schemas

### contact
- name (required, string)
- email (required, email)
- company (link to records/companies/)
- tier (enum: gold, silver)
- country (default NZ)
- unique: email
- summary_template: {name} of {company}

### company
- name (required)
- founded (date)
- turnover (currency)

## Folders
- records/companies|Firms — who we work with
"""


def record(kind, summary="A line", body="", **fields):
    head = {"type": kind, "created": "2026-01-02T03:04:05Z", "updated": "2026-01-02T03:04:05Z", "summary": summary} | fields
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items() if v is not None) + "---\n" + body


FILES = {
    "STORE.md": DB,
    "records/companies/acme.md": record("company", "Makes anvils", "# Acme\n\nSee [[records/contacts/eve]].\n", name="Acme", founded="1999-05-06", turnover='"$1,234.50"', tags="[big, old]", updated="2026-03-01T00:00:00+02:00"),
    "records/companies/_hidden-name.md": record("company", "Underscore", name="U", founded="yes", turnover="1234.00"),
    "records/companies/a-b.md": record("company", "Hyphen", name="AB"),
    "records/companies/a/x.md": record("company", "Nested", name="AX", updated="2026-02-01T00:00:00Z"),
    "records/contacts/eve.md": record("contact", "Eve of Acme", "Hello [[records/companies/acme|Acme]] and [[nobody]] and [[records/none/gone]].\n\n```\n[[records/companies/a-b]]\n```\n", name="Eve", email="eve@acme.com", company="[[records/companies/acme]]", id="e1", tier="gold"),
    "records/contacts/bob.md": record("contact", "Bob", "Nothing here.\n", name="Bob", email="eve@acme.com", company='"[[records/people/x]]"', id="e1", tier="tin"),
    "records/contacts/zed.md": record("contact", None, "", name="Zed", email="zed@@acme.com", created="2026-01-01", **{"meta-type": "guess"}),
    "records/notes/plan.md": record("note", "Plan", "## One\ntext\n### Deep\nmore\n## Two\nend [[records/contacts/eve.md]]\n", big="12345678901234567890123", code="012", when="12:30:00", flag="yes", n="7", x="1e3"),
    "records/notes/bad.md": "---\ntype: note\n  broken: [\n---\nbody\n",
    "records/loose.md": record("note", "Loose", "A kickoff line\nno\nKickoff again\n"),
    "sources/emails/2026/01/mail.md": record("email", "Mail", "kickoff at nine\n", date="2026-01-05"),
    "sources/emails/2026/01/temp.md": record("temp", "Temp"),
    "log.md": "---\ntype: log\n---\n\n# Log\n\n## [2026-01-02 10:00] create | records/contacts/eve\nMade Eve.\n\\## [not a header]\n\n## [2026-01-02 09:00] update | records/companies/acme\nLate.\n\n## [2026-01-03 10:00] validate\nPASS\n\n## [2026-01-04 08:00] dance | records/x\nOdd.\n",
    "log/2025-12.md": "---\ntype: log\n---\n\n## [2025-12-30 10:00] ingest | sources/emails/2026/01/mail\nOld.\n",
    "assets/a.pdf": "pdf bytes",
}


def build(root):
    for name, text in FILES.items():
        full = os.path.join(root, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)
    os.makedirs(os.path.join(root, ".git"), exist_ok=True)
    with open(os.path.join(root, ".git", "x.md"), "w") as f:
        f.write("hidden")
    return str(root)
