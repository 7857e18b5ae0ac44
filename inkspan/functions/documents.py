"""Text of office documents, books and pages (plain Python, run inside UDFs), within fixed budgets."""

from __future__ import annotations

import contextlib
import io
import posixpath
import re
import zipfile
from datetime import datetime, timedelta
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

DOCUMENT_MOST, ENTRY_MOST, INFLATED_MOST, OUTPUT_MOST = 128 << 20, 32 << 20, 64 << 20, 64 << 20
ENTRIES_MOST, CELLS_MOST, DEPTH_MOST = 20_000, 2_000_000, 2_000
#: What one document may take: seconds by the clock, and bytes of address space beyond what the process has.
SECONDS, ADDRESSES = 20, 2 << 30


class ExtractError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@contextlib.contextmanager
def guarded(seconds: float = SECONDS, addresses: int = ADDRESSES):
    """Limits on one document's time and memory; what exceeds them fails its own row and no other.

    The clock and the address space are the process's own, so this holds in a
    worker's main thread; elsewhere only the memory is limited.
    """
    import resource
    import signal
    import threading

    def stop(*_):
        raise ExtractError("EXTRACT_TIMEOUT", f"the document took more than {seconds:g} seconds")

    timed = threading.current_thread() is threading.main_thread()
    soft, hard = resource.getrlimit(resource.RLIMIT_AS)
    have = 0
    try:
        with open("/proc/self/statm") as f:
            have = int(f.read().split()[0]) * resource.getpagesize()
    except OSError:
        pass
    limit = have + addresses if have else soft
    limit = min(x for x in (limit, hard, soft) if x != resource.RLIM_INFINITY) if have or soft != resource.RLIM_INFINITY else soft
    before = signal.signal(signal.SIGALRM, stop) if timed else None
    try:
        resource.setrlimit(resource.RLIMIT_AS, (limit, hard))
        if timed:
            signal.setitimer(signal.ITIMER_REAL, seconds)
        yield
    except MemoryError:
        raise ExtractError("EXTRACT_RESOURCE_LIMIT", "the document took more memory than it may") from None
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
        resource.setrlimit(resource.RLIMIT_AS, (soft, hard))


class Package:
    """A zip archive whose entries are read within the budgets."""

    def __init__(self, raw: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile as e:
            raise ExtractError("EXTRACT_PARSE_ERROR", str(e)) from None
        infos = self.zip.infolist()
        if len(infos) > ENTRIES_MOST:
            raise ExtractError("EXTRACT_PARSE_ERROR", "too many entries")
        if any(i.flag_bits & 1 for i in infos):
            raise ExtractError("DOCUMENT_ENCRYPTED", "the archive is encrypted")
        self.names = {i.filename for i in infos}
        self.left = INFLATED_MOST

    def read(self, name: str) -> bytes:
        try:
            with self.zip.open(name) as f:
                raw = f.read(min(ENTRY_MOST, self.left) + 1)
        except (KeyError, zipfile.BadZipFile, NotImplementedError, EOFError, OSError) as e:
            raise ExtractError("EXTRACT_PARSE_ERROR", f"{name}: {e}") from None
        if len(raw) > min(ENTRY_MOST, self.left):
            raise ExtractError("EXTRACT_PARSE_ERROR", "the archive inflates past its budget")
        self.left -= len(raw)
        return raw

    def xml(self, name: str) -> ET.Element:
        raw = self.read(name)
        if b"<!ENTITY" in raw:  # entities of its own could grow without bound
            raise ExtractError("EXTRACT_PARSE_ERROR", f"{name} declares entities")
        try:
            return ET.fromstring(raw)
        except ET.ParseError as e:
            raise ExtractError("EXTRACT_PARSE_ERROR", f"{name}: {e}") from None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx(raw: bytes) -> tuple[str, dict]:
    """Runs of text; paragraphs end lines, tabs and breaks stay."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        name = _local(e.tag)
        if name == "t":
            out.append(e.text or "")
        elif name == "tab" and _local(e.tag) != "tabs":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        if name != "tabs":
            for kid in e:
                walk(kid)
        if name == "p":
            out.append("\n")

    walk(Package(raw).xml("word/document.xml"))
    return "".join(out), {}


def serial_date(serial: float, base_1904: bool = False) -> str:
    """A spreadsheet's day number as an ISO date or time."""
    start = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 30)
    t = start + timedelta(seconds=round(serial * 86400))
    return t.strftime("%Y-%m-%d") if serial == int(serial) else t.strftime("%Y-%m-%dT%H:%M:%S")


def _number(text: str) -> str:
    try:
        v = float(text)
    except ValueError:
        return text
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def xlsx(raw: bytes) -> tuple[str, dict]:
    """Sheets apart by a blank line, rows as tab-joined cells; whole numbers without ``.0``, dates as ISO."""
    p = Package(raw)
    shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in p.xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in p.names else []
    dated: list[bool] = []
    if "xl/styles.xml" in p.names:
        styles = p.xml("xl/styles.xml")
        own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter() if _local(n.tag) == "numFmt"}
        xfs = next((x for x in styles if _local(x.tag) == "cellXfs"), [])
        for xf in xfs:
            k = int(xf.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(k, "")).lower()
            dated.append(14 <= k <= 22 or 45 <= k <= 47 or bool(re.search("[ymdhs]", code)))
    book = p.xml("xl/workbook.xml")
    late = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book)
    links = {r.get("Id"): r.get("Target") for r in p.xml("xl/_rels/workbook.xml.rels")}
    names, texts, cells = [], [], 0
    for sheet in (e for e in book.iter() if _local(e.tag) == "sheet"):
        names.append(sheet.get("name"))
        ident = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
        target = posixpath.normpath(posixpath.join("xl", links[ident])) if not links[ident].startswith("/") else links[ident][1:]
        lines = []
        for row in (e for e in p.xml(target).iter() if _local(e.tag) == "row"):
            line: list[str] = []
            for c in (e for e in row if _local(e.tag) == "c"):
                cells += 1
                if cells > CELLS_MOST:
                    raise ExtractError("EXTRACT_PARSE_ERROR", "too many cells")
                ref = re.match("[A-Z]+", c.get("r", ""))
                if ref:
                    col = 0
                    for ch in ref[0]:
                        col = col * 26 + ord(ch) - 64
                    if col - 1 > len(line):
                        cells += col - 1 - len(line)
                        line += [""] * min(col - 1 - len(line), 16384)
                v = next((e.text or "" for e in c if _local(e.tag) == "v"), "")
                kind = c.get("t", "n")
                if kind == "s":
                    v = shared[int(v)] if v else ""
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                elif kind == "b":
                    v = "TRUE" if v == "1" else "FALSE"
                elif kind == "n" and v:
                    style = int(c.get("s", 0))
                    v = serial_date(float(v), late) if style < len(dated) and dated[style] else _number(v)
                line.append(v)
            lines.append("\t".join(line).rstrip("\t"))
        texts.append("\n".join(lines))
    return "\n\n".join(texts), {"sheets": str(len(names)), "sheet_names": ", ".join(names)}


def ods(raw: bytes) -> tuple[str, dict]:
    names, texts, cells = [], [], 0
    for sheet in (e for e in Package(raw).xml("content.xml").iter() if _local(e.tag) == "table"):
        attrs = {_local(k): v for k, v in sheet.attrib.items()}
        names.append(attrs.get("name", ""))
        lines = []
        for row in (e for e in sheet.iter() if _local(e.tag) == "table-row"):
            line: list[str] = []
            for c in (e for e in row if _local(e.tag) in ("table-cell", "covered-table-cell")):
                own = {_local(k): v for k, v in c.attrib.items()}
                n = int(own.get("number-columns-repeated", 1))
                kind = own.get("value-type")
                text = "\n".join("".join(x.itertext()) for x in c if _local(x.tag) == "p")
                v = {"float": lambda: _number(own.get("value", text)), "boolean": lambda: own.get("boolean-value", "").upper(), "date": lambda: own.get("date-value", text)}.get(kind, lambda: text)()
                if v == "":
                    n = min(n, 16384)
                cells += n
                if cells > CELLS_MOST:
                    raise ExtractError("EXTRACT_PARSE_ERROR", "too many cells")
                line += [v] * n
            lines.append("\t".join(line).rstrip("\t"))
        texts.append("\n".join(lines).rstrip("\n"))
    return "\n\n".join(texts), {"sheets": str(len(names)), "sheet_names": ", ".join(names)}


_SKIPPED = {"script", "style", "head", "title", "template", "noscript"}
_LINED = set("p div section article header footer main aside nav h1 h2 h3 h4 h5 h6 ul ol li table tr blockquote pre form figure dl dt dd hr address".split())


class _Plain(HTMLParser):
    """Text of a page: list markers kept, headings and links bare."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.size = self.skip = self.depth = 0
        self.lists: list[int | None] = []

    def put(self, text: str) -> None:
        self.size += len(text)
        if self.size > OUTPUT_MOST:
            raise ExtractError("EXTRACT_PARSE_ERROR", "the text exceeds its budget")
        self.out.append(text)

    def line(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.put("\n")

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        if tag in _LINED:
            self.line()
            self.depth += 1
            if self.depth > DEPTH_MOST:
                raise ExtractError("EXTRACT_PARSE_ERROR", "the page nests too deep")
        if tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            n = self.lists[-1] if self.lists else None
            if n is not None:
                self.lists[-1] = n + 1
            self.put("* " if n is None else f"{n + 1}. ")
        elif tag == "br":
            self.put("\n")
        elif tag in ("td", "th") and self.out and not self.out[-1].endswith("\n"):
            self.put("\t")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in _LINED:
            self.depth = max(0, self.depth - 1)
            self.line()
            if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote"):
                self.put("\n")

    def handle_data(self, data):
        if self.skip:
            return
        text = re.sub(r"\s+", " ", data)
        if self.out and self.out[-1][-1:] in "\n\t " or not self.out:
            text = text.lstrip(" ")
        if text:
            self.put(text)


def html(raw: bytes) -> tuple[str, dict]:
    p = _Plain()
    p.feed(raw.decode("utf-8", "replace"))
    p.close()
    return "".join(p.out), {}


def zip_path(base: str, target: str) -> str:
    """A percent-encoded reference resolved inside an archive."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(target.split("#")[0]))).lstrip("/")


def epub(raw: bytes) -> tuple[str, dict]:
    """The chapters of a book in the order of its spine."""
    p = Package(raw)
    root = next((e.get("full-path") for e in p.xml("META-INF/container.xml").iter() if _local(e.tag) == "rootfile"), None)
    if not root:
        raise ExtractError("EXTRACT_PARSE_ERROR", "the book names no package")
    package = p.xml(root)
    items = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item"}
    title = next((e.text for e in package.iter() if _local(e.tag) == "title" and e.text), None)
    texts: dict[str, str] = {}
    out = []
    for ref in (e.get("idref") for e in package.iter() if _local(e.tag) == "itemref"):
        if ref in items:
            name = zip_path(root, items[ref])
            if name not in texts:
                texts[name] = html(p.read(name))[0].strip("\n")
            out.append(texts[name])
            if sum(map(len, out)) > OUTPUT_MOST:
                raise ExtractError("EXTRACT_PARSE_ERROR", "the text exceeds its budget")
    return "\n\n".join(out), {"chapters": str(len(out))} | ({"title": title} if title else {})


def pdf(raw: bytes) -> tuple[str, dict]:
    """The text layer; scanned pages have none."""
    from . import pdf as P

    try:
        found, pages = P.text(raw)
    except P.Encrypted as e:
        raise ExtractError("DOCUMENT_ENCRYPTED", str(e)) from None
    except P.Damaged as e:
        raise ExtractError("EXTRACT_PARSE_ERROR", str(e)) from None
    return found, {"pages": str(pages)}


READERS = {"docx": docx, "xlsx": xlsx, "xlsm": xlsx, "ods": ods, "epub": epub, "html": html, "htm": html, "xhtml": html, "pdf": pdf}


def normalized(text: str) -> str:
    """Unix line ends, no trailing blanks, one blank line at most, one final line feed; empty stays empty."""
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")
    return out + "\n" if out else ""


def extract(name: str, raw: bytes | None) -> dict:
    """Text and metadata of one document, or the code of what went wrong."""
    try:
        reader = READERS.get(name.rsplit(".", 1)[-1].lower() if "." in name else "")
        if reader is None:
            raise ExtractError("UNSUPPORTED_FORMAT", f"no reader for {name}")
        if raw is None:
            raise ExtractError("IO_ERROR", "no content")
        if len(raw) > DOCUMENT_MOST:
            raise ExtractError("EXTRACT_PARSE_ERROR", "the document is too large")
        with guarded():
            text, meta = reader(raw)
            text = normalized(text)
        return {"text": text, "metadata": meta, "error_code": None, "error": None}
    except ExtractError as e:
        return {"text": None, "metadata": {}, "error_code": e.code, "error": str(e)}
    except Exception as e:  # a damaged document fails its own row only
        return {"text": None, "metadata": {}, "error_code": "EXTRACT_PARSE_ERROR", "error": f"{type(e).__name__}: {e}"}
