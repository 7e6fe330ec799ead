"""Files to elements: HTML and DOCX by the standard library, PDF where pymupdf is installed.

Files arrive as rows (document_id, source_type, content) from Spark's binaryFile
source, so any store works; each task parses its own rows, and a file that can't be
parsed becomes a failure row instead of ending the job.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import DocumentParseError
from docloom.functions import ids
from docloom.operators.corpus import logical_title, parse_layout

ELEMENTS = "document_id string, ordinal int, kind string, text string, page_number int, section_hint string, tag string, table_html string, error string"
#: Suffixes of the file types that can be read.
TYPES = {"pdf": "pdf", "docx": "docx", "html": "html", "htm": "html"}


def scan_corpus(spark: SparkSession, root: str, fail_on_unsupported: bool = False) -> DataFrame:
    """A row for each file below root: document_id, relative_path, split, domain, source_type, logical_title, checksum_sha256, size_bytes, content; supported says whether its type can be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    rows = files.select(
        F.col("path").alias("source_uri"), *(c.alias(n) for n, c in parse_layout(path, re.sub("^file:/*", "/", root)).items()), F.try_element_at(kinds, suffix).alias("source_type"),
        logical_title(path).alias("logical_title"), F.sha2("content", 256).alias("checksum_sha256"), F.col("length").alias("size_bytes"), "content",
    )
    rows = rows.withColumn("document_id", ids.document_id(F.col("checksum_sha256"), F.col("relative_path"))).withColumn("supported", F.col("source_type").isNotNull() & F.col("split").isNotNull())
    if fail_on_unsupported:
        rows = rows.filter(F.when(F.col("supported"), True).otherwise(F.raise_error(F.concat(F.lit("unsupported file "), "source_uri")).cast("boolean")))
    return rows


class Node:
    """An element of a parsed page."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings()
            elif c.strip():
                yield c.strip()

    def text(self) -> str:
        return " ".join(self.strings())

    def inside(self, names: set[str]) -> bool:
        p = self.parent
        while p is not None and p.name not in names:
            p = p.parent
        return p is not None


class _Tree(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
    DROPPED = {"script", "style", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        node = self.at
        while node is not None and node.name not in self.DROPPED:
            node = node.parent
        if node is None:
            self.at.children.append(data)


_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table", "header", "footer", "hr"}
_HOLDERS = {"table", "li", "header", "footer"}
_KINDS = {"li": "list_item", "table": "table", "header": "header", "footer": "footer"}


def table_text(rows: list[list[str]]) -> str:
    """Stripped cells with tabs between them, a line each row; nothing around the whole."""
    return "\n".join("\t".join((c or "").strip() for c in row) for row in rows).strip()


def table_markup(rows: list[list[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape((c or '').strip())}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def parse_html(content: bytes, strict_header: bool = False, page_breaks: bool = True) -> list[tuple]:
    """(kind, text, page, section_hint, tag, table_html) of a page's blocks in their order.

    Blocks within lists, tables, headers and footers belong to them. A header counts
    as a title and names the section, as any tag that begins with h; strict_header
    makes it a header.
    """
    tree = _Tree()
    tree.feed(content.decode("utf-8"))
    tree.close()
    out, section = [], None
    for node in (n for n in tree.root.walk() if n.name in _BLOCKS):
        if node.name not in _HOLDERS and node.inside(_HOLDERS):
            continue
        style = node.attrs.get("style", "").replace(" ", "").lower()
        classes = node.attrs.get("class", "").split()
        if (node.name == "hr" and any("page-break" in c for c in classes)) or "page-break-before:always" in style or "page-break-after:always" in style:
            if page_breaks:
                out.append(("page_break", "", None, section, node.name, None))
            continue
        text, markup = node.text(), None
        if not text:
            continue
        if node.name[0] == "h" and not (strict_header and node.name == "header"):
            kind, section = "title", text
        elif node.name in _KINDS:
            kind = _KINDS[node.name]
        else:
            kind = "caption" if "caption" in classes or re.match(r"(figure|table)\s+\d+", text, re.I) else "text"
        if kind == "table":
            rows = [[c.text() for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in node.walk() if r.name == "tr"]
            text, markup = table_text(rows) or text, table_markup(rows)
        out.append((kind, text, None, section, node.name, markup))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(p: ElementTree.Element) -> str:
    return "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br") and not (x.tag == f"{_W}br" and x.get(f"{_W}type") == "page"))


def classify(text: str) -> str:
    """functions.text.classify_text() for a plain text."""
    if re.match(r"(figure|table)\s+\d+[\s:.-]", text, re.I):
        return "caption"
    return "list_item" if re.match(r"(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][.)]\s+)", text) else "text"


def parse_docx(content: bytes, page_breaks: bool = True) -> list[tuple]:
    """As parse_html(): paragraphs and tables of the body by their styles, pages counted at breaks, then headers and footers without page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        parts = [(k, ElementTree.fromstring(z.read(n))) for k in ("header", "footer") for n in sorted(z.namelist()) if re.fullmatch(rf"word/{k}\d*\.xml", n)]
    out, section, page = [], None, 1
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            text = _paragraph(block).strip()
            ref = block.find(f"{_W}pPr/{_W}pStyle")
            style = styles.get(ref.get(f"{_W}val"), ref.get(f"{_W}val")) if ref is not None else "Normal"
            if text:
                low = style.lower()
                if low.startswith(("heading", "title")):
                    kind, section = "title", text
                else:
                    kind = "list_item" if low.startswith("list") else "caption" if low.startswith("caption") else classify(text)
                out.append((kind, text, page, section, style, None))
            breaks = any(x.tag == f"{_W}lastRenderedPageBreak" or (x.tag == f"{_W}br" and x.get(f"{_W}type") == "page") for x in block.iter())
            if page_breaks and breaks:
                out.append(("page_break", "", page, section, None, None))
                page += 1
        elif block.tag == f"{_W}tbl":
            rows = [["\n".join(_paragraph(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in block.findall(f"{_W}tr")]
            if text := table_text(rows):
                out.append(("table", text, page, section, None, table_markup(rows)))
    for kind, tree in parts:
        out += [(kind, text, None, section, None, None) for p in tree.iter(f"{_W}p") if (text := _paragraph(p).strip())]
    return out


def overlaps(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    """Whether two boxes (x0, y0, x1, y1) share an area."""
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def parse_pdf(content: bytes, ocr: Callable[[bytes], str] | None = None, ocr_mode: str = "disabled", least_chars: int = 20) -> list[tuple]:
    """As parse_html(): each page's tables and the text blocks beside them, from top to bottom; pages without text go to ocr (mode fallback, or always)."""
    try:
        import pymupdf
    except ImportError as e:
        raise DocumentParseError("reading PDF needs pymupdf") from e
    out, section = [], None
    if ocr_mode != "disabled" and ocr is None:
        raise DocumentParseError("an OCR mode needs an OCR function")
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, 1):
            if number > 1:
                out.append(("page_break", "", number - 1, section, None, None))
            try:
                tables = page.find_tables().tables
            except Exception:  # tables are a bonus: text goes on without
                tables = []
            found = [(t.bbox[1], 0, table_text(t.extract()), "table", tuple(t.bbox), table_markup(t.extract())) for t in tables]
            boxes = [f[4] for f in found]
            for b in page.get_text("dict")["blocks"]:
                spans = [s for line in b.get("lines", ()) for s in line["spans"]]
                text = " ".join(s["text"].strip() for s in spans if s["text"].strip())
                if not text or any(overlaps(b["bbox"], x) for x in boxes):
                    continue
                size, bold = max(s["size"] for s in spans), any(s["flags"] & 16 for s in spans)
                heading = (size >= 14 and len(text) <= 180) or (bold and len(text) <= 100)
                top, bottom = b["bbox"][1] <= 0.06 * page.rect.height, b["bbox"][3] >= 0.94 * page.rect.height
                kind = "title" if heading else "header" if top else "footer" if bottom else classify(text)
                found.append((b["bbox"][1], 1, text, kind, tuple(b["bbox"]), None))
            for _, _, text, kind, _, markup in sorted(found, key=lambda f: f[:3]):
                section = text if kind == "title" else section
                out.append((kind, text, number, section, None, markup))
            native = sum(len(f[2]) for f in found)
            if ocr and (ocr_mode == "always" or (ocr_mode == "fallback" and native < least_chars)):
                text = ocr(page.get_pixmap(dpi=200).tobytes("png")).strip()
                if text:
                    out.append(("ocr_text", text, number, section, None, None))
                elif not native:
                    raise DocumentParseError(f"page {number} has no text, nor by OCR")
    return out


PARSERS: dict[str, Callable[[bytes], list[tuple]]] = {"html": parse_html, "docx": parse_docx, "pdf": parse_pdf}


def parse(files: DataFrame, parsers: dict[str, Callable[[bytes], list[tuple]]] | None = None) -> DataFrame:
    """ELEMENTS of files (document_id, source_type, content); a file that fails is one row with error (its kind and message)."""
    by_type = PARSERS | (parsers or {})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        for part in parts:
            out: list[tuple] = []
            for name, kind, content in part.itertuples(index=False):
                try:
                    if kind not in by_type:
                        raise DocumentParseError(f"no parser for {kind}")
                    found = by_type[kind](bytes(content))
                    out += [(name, i, k, text, page, section, tag, markup, None) for i, (k, text, page, section, tag, markup) in enumerate(found)]
                except Exception as e:
                    out.append((name, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"ordinal": "Int32", "page_number": "Int32"})

    return files.select("document_id", "source_type", "content").mapInPandas(run, ELEMENTS)


def with_element_ids(elements: DataFrame, config_fingerprint: str = "") -> DataFrame:
    rows = elements.filter("error is null").drop("error")
    return rows.withColumn("element_id", ids.element_id(F.col("document_id"), F.col("ordinal"), F.col("kind"), F.col("text"), F.col("page_number"), F.lit(config_fingerprint)))


def failures(elements: DataFrame, most: int | None = None) -> DataFrame:
    """document_id, error of the files that failed; over most of them is an error."""
    rows = elements.filter("error is not null").select("document_id", "error")
    if most is not None and len(rows.take(most + 1)) > most:
        raise DocumentParseError(f"more than {most} files failed")
    return rows
