"""Operator 2: main-text extraction from HTML by tree scoring.

A page is parsed into a tree (end tags may be missing).  Each paragraph-like
block passes points for its length and its commas to its ancestors, fewer with
each level, and every container's points are discounted by its share of link
text.  The best container is kept with those siblings that score near it or
read like its paragraphs; what is by its element, role or name no main text
(menus, banners, adverts, forms, scripts, comments) counts nowhere, and
names that an article may use too (notice, header, legal) lower its points.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest, quoted, table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that never hold main text (a form does if an article, a main element or a first heading is in it).
DROPPED = set("script style noscript template iframe nav footer aside form button select option textarea input svg canvas object embed "
              "head title menu dialog audio video map label fieldset legend xmp noembed noframes".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that a class or an id does not rule out.
WHOLE = HEADINGS | {"html", "body", "main", "#root"}
#: Elements whose start ends an open paragraph, and elements that end an open one of their kind.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}
ENDS_OWN = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "tablist", "toolbar"}
_WORD = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-]|\d)"
#: Whole words of a class or id that name something beside the main text wherever it stands.
BAD_NAME = re.compile(_WORD % (
    r"ads?|adverts?|advertisement|advertising|adsense|sponsored|sponsor|promo|promoted|promotion|cookies?|consent|gdpr|"
    r"popup|modal|newsletter|subscribe|subscription|signup|signin|login|paywall|nav|navbar|navigation|menu|menus|breadcrumbs?|pagination|pager|"
    r"sidebar|related|recommended|recommendations|trending|share|sharing|social|footer|footnav|masthead|topbar|comments?|commentlist|disqus|replies|respond|copyright"), re.I)
#: Names that do so outside the best container, or where most of the text is links; elsewhere they only lower points.
DOUBTED_NAME = re.compile(_WORD % r"banner|notices?|alert|overlay|side|rail|aside|widgets?|popular|toolbar|header|reply|discussion|skip|legal|disclaimer|hidden|teasers?", re.I)
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　]+")
#: Containers whose own text of OWN characters or more makes points for themselves, not only for what is around them.
BARE, OWN = {"article", "main", "body", "#root", "div", "section", "center", "td"}, 140


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent", "bad", "doubted", "under", "score", "chars", "linked", "commas", "own", "own_linked", "own_commas")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node | str] = []
        self.bad = self.doubted = self.under = False
        self.score = 0.0
        self.chars = self.linked = self.commas = self.own = self.own_linked = self.own_commas = 0


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t\r") else {}


def _mark(root: Node) -> None:
    """Marks what is by its element, role or name no main text (``bad``), or may be none (``doubted``)."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        tag, attrs = node.tag, node.attrs
        if tag in DROPPED:
            node.bad = not (tag == "form" and any(k.tag in ("article", "main", "h1") for k in _below(node)))
        elif tag == "header" and not inside:
            node.bad = True
        elif attrs and tag not in ("html", "body"):
            node.bad = (
                "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in BAD_ROLE
                or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))
            )
            if not node.bad and tag not in WHOLE and (tag in BLOCK or tag in ("span", "a")):
                name = f"{attrs.get('class', '')} {attrs.get('id', '')}"
                if name != " ":
                    node.bad = bool(BAD_NAME.search(name)) and (tag != "article" or inside)
                    node.doubted = bool(DOUBTED_NAME.search(name)) or tag == "article" and bool(BAD_NAME.search(name))
        if not node.bad:
            inside = inside or tag == "article"
            stack += [(k, inside) for k in node.kids if isinstance(k, Node)]


def _below(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        for kid in stack.pop().kids:
            if isinstance(kid, Node):
                yield kid
                stack.append(kid)


def parse(page: str) -> Node:
    """The tree of a page.  End tags may be missing, stray ones are passed over."""
    root = here = Node("#root", {}, None)
    at = 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            here.kids.append(text)
        if not m:
            _mark(root)
            return root
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            up = here
            while up.tag != tag and up.parent is not None:
                # A block's end is not looked for beyond a cell, nor an inline end beyond a block.
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root
                    break
                up = up.parent
            if up.parent is not None:
                here = up.parent
            continue
        attrs = _attributes(m[3] or "")
        if tag in ENDS_P:
            up = here
            while up.parent is not None and up.tag != "p" and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in ENDS_OWN:
            ended, limit = ENDS_OWN[tag]
            up, found = here, None
            while up.parent is not None and up.tag not in limit:
                if up.tag in ended:
                    found = up
                up = up.parent
            if found is not None:
                here = found.parent
        node = Node(tag, attrs, here)
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)|\\Z", re.I).search(page, at)
            at = end.end()
        elif tag not in VOID and not (m[3] or "").endswith("/") or tag in BLOCK:
            here = node


def _measure(root: Node) -> list[Node]:
    """Counts text, link text and commas of every element, and of its text outside blocks; returns elements in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.under = node.doubted or node.parent is not None and node.parent.under
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.bad)
    for node in reversed(order):
        for kid in node.kids:
            if isinstance(kid, str):
                n = len(kid.strip())
                commas = kid.count(",") + kid.count("、") + kid.count("،")
                node.chars += n
                node.commas += commas
                node.own += n
                node.own_commas += commas
            elif not kid.bad:
                node.chars += kid.chars
                node.linked += kid.linked
                node.commas += kid.commas
                if kid.tag not in BLOCK:
                    node.own += kid.own
                    node.own_linked += kid.own_linked
                    node.own_commas += kid.own_commas
        if node.tag == "a":
            node.linked, node.own_linked = node.chars, node.own
    return order


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _up(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def best(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order; none for a page without text.

    Every block with text of its own passes points; a page where no container
    scores (all its text is links, say) is its own best container.
    """
    order = _measure(root)
    if not root.chars:
        return []
    containers: list[Node] = []
    for node in order:
        if not node.own or node.tag not in BLOCK and node is not root or 2 * node.own_linked > node.own:
            continue
        points = 1 + node.own_commas + min(node.own / 100, 3)
        if node.under:
            points *= 0.3
        itself = node.parent is None or node.tag in BARE and (node.own >= OWN or node.tag in ("article", "main", "body"))
        up, at = (node if itself else node.parent), 0
        while up is not None and at < 6:
            if not up.score:
                containers.append(up)
                up.score = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0}.get(up.tag, 0.001) * (0.3 if up.under else 1)
                if up.tag in ("ul", "ol", "dl", "td", "th", "li"):
                    up.score = -3.0
            up.score += points * (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)[at]
            up, at = up.parent, at + 1
    if not containers:
        return [root]
    value = {id(n): n.score * (1 - density(n)) for n in containers}
    top = max(containers, key=lambda n: value[id(n)])
    # What is around the best container and no more link-laden belongs to the text, up to its article or main
    # element, or else as far as the text around it is no other block of the page's own.
    around = next((x for x in _up(top) if x.tag in ("article", "main")), None)
    if around is not None and density(around) <= 0.5:
        top = around
    inside, above = {id(x) for x in _below(top)}, {id(x) for x in _up(top)}
    for node in order:
        if node.doubted and id(node) not in above and (2 * node.linked > node.chars or id(node) not in inside):
            node.bad = True
    while around is None and top.parent is not None and top.parent.tag not in ("body", "html", "#root"):
        rest = [k for k in top.parent.kids if isinstance(k, Node) and k is not top and not k.bad and k.chars]
        if any(2 * k.linked > k.chars for k in rest):
            break
        top = top.parent
    if top.parent is None:
        return [top]
    least = max(10.0, 0.2 * value.get(id(top), 0.0))
    kept: list[Node] = []
    for kid in top.parent.kids:
        if kid is top:
            kept.append(kid)
        elif isinstance(kid, Node) and not kid.bad and kid.chars:
            near = value.get(id(kid), 0.0) >= least
            if kid.tag == top.tag == "article":  # by what their texts earned, not by what an article begins with
                near = kid.score - 25 >= 0.2 * (top.score - 25)
            elif kid.attrs.get("class") and kid.attrs.get("class") == top.attrs.get("class") and top.tag != "main":
                near |= value.get(id(kid), 0.0) > 0.05 * value.get(id(top), 0.0)
            prose = kid.tag == "p" and around is not top and (kid.chars > 80 and density(kid) < 0.25 or kid.chars > 20 and kid.linked == 0)
            title = kid.tag == "h1" and density(kid) < 0.5
            if near or prose or title:
                kept.append(kid)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """The text of each block in page order: references decoded, white space made one space, trimmed."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.bad:
            if item.tag in BLOCK:
                close()
        elif item.tag in ("br", "wbr", "img"):
            run.append(" " if item.tag != "wbr" else "")
        else:
            if item.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(item.kids))
    close()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds; empty for null, empty and textless pages."""
    return "\n".join(blocks(best(parse(page)))) if page else ""


def extract(pages: DataFrame, html_column: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the main text of each whole page, to the columns ``keep`` (default: all).

    Null, empty and textless pages give the empty text; repeated rows repeat;
    a column of the name ``text`` (whatever its letters' case) is replaced; an
    empty table gives no rows; of containers that score alike the first on the
    page is taken; a page of any length is parsed whole, by one task, in time
    and memory in proportion to it.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() != text.lower()]
    rows = modest(pages).select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.col(quoted(html_column)).alias("html"))
    kinds = "".join(f"k{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return rows.mapInArrow(run, kinds + "text string").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(text))


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))


#: The same for pages that mark their article as such and hold no other parts in it: its blocks, tags and references.
OP2_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(regexp_replace(coalesce(html, ''), '[ \t\n\r\f\v]+', ' ', 'g'), '<article>(.*)$', 1, 's'), '</article>.*$', '', 's') AS h FROM pages),
b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<!--.*?-->', '', 'gs'), '</?(p|h1|li|ul)>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS u FROM a),
c AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;?', '&', 'g') AS t FROM b),
d AS (
  SELECT page_id, url, array_to_string([x FOR x IN [trim(regexp_replace(y, ' +', ' ', 'g')) FOR y IN string_split(t, chr(1))] IF x <> ''], chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
