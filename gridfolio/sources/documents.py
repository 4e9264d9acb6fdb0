"""Document sources: files by extension to text blocks and table grids, in partitions, with failures set aside."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are read, and rows above which a sheet's table is flagged.
EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "html", "htm", "md", "txt"]
MAX_SHEET_ROWS = 5000
BLOCK = "struct<position:int,kind:string,text:string,page:int>"
GRID = "struct<table_index:int,headers:array<string>,rows:array<array<string>>,oversized:boolean>"
PARSED = f"path string, blocks array<{BLOCK}>, tables array<{GRID}>, error string"
_NS = {"w": "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "a": "{http://schemas.openxmlformats.org/drawingml/2006/main}", "s": "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"}


class _Blocks(HTMLParser):
    """Lines of text, headings and tables of an HTML page."""

    SKIP = {"script", "style", "noscript", "template"}
    LINE = {"p", "div", "li", "br", "tr", "section", "article", "header", "footer", "ul", "ol", "table", "body", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.buffer, self.kind, self.skip, self.cell = "", "text", 0, None

    def flush(self):
        if text := re.sub(r"\s+", " ", self.buffer).strip():
            self.blocks.append((self.kind, text))
        self.buffer = ""

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.LINE:
            self.flush()
            self.kind = "heading" if re.fullmatch("h[1-6]", tag) else "text"
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = ""

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(re.sub(r"\s+", " ", self.cell).strip())
            self.cell = None
        if tag in self.LINE:
            self.flush()
            self.kind = "text"

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell += data
        else:
            self.buffer += data


def _grid(i: int, cells: list[list[str]]) -> dict:
    return {"table_index": i, "headers": cells[0], "rows": cells[1:], "oversized": len(cells) - 1 > MAX_SHEET_ROWS}


def parse_html(data: bytes) -> tuple[list, list]:
    page = data.decode("utf-8", "replace")
    own = _Blocks()
    own.feed(page if re.search(r"<body", page, re.I) else f"<html><body>{page}</body></html>")
    own.close()
    own.flush()
    return [(k, t, 1) for k, t in own.blocks], [t for t in own.tables if any(map(any, t))]


def parse_markdown(data: bytes) -> tuple[list, list]:
    blocks, tables, table, paragraph = [], [], [], []

    def end():
        if paragraph:
            blocks.append(("text", " ".join(paragraph), 1))
            paragraph.clear()
        if table:
            tables.append(list(table))
            table.clear()

    for line in data.decode("utf-8", "replace").splitlines():
        if re.match(r"\s*\|.*\|\s*$", line):
            if paragraph:
                end()
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                table.append(cells)
        elif m := re.match(r"#{1,6}\s+(.*)", line):
            end()
            blocks.append(("heading", m[1].strip(), 1))
        elif line.strip():
            if table:
                end()
            paragraph.append(line.strip())
        else:
            end()
    end()
    return blocks, tables


def parse_text(data: bytes) -> tuple[list, list]:
    return [("text", t, 1) for p in re.split(r"\n\s*\n", data.decode("utf-8", "replace")) if (t := re.sub(r"\s+", " ", p).strip())], []


def parse_docx(data: bytes) -> tuple[list, list]:
    """Paragraphs with pages counted by page-break marks, and tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_NS['w']}body")
    w, blocks, tables, page = _NS["w"], [], [], 1
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            page += sum(1 for b in e.iter(f"{w}br") if b.get(f"{w}type") == "page") + sum(1 for _ in e.iter(f"{w}lastRenderedPageBreak"))
            style = e.find(f"{w}pPr/{w}pStyle")
            heading = style is not None and (style.get(f"{w}val") or "").lower().startswith(("heading", "title"))
            if text := said(e).strip():
                blocks.append(("heading" if heading else "text", text, page))
        elif e.tag == f"{w}tbl":
            tables.append([[said(c).strip() for c in r.findall(f"{w}tc")] for r in e.findall(f"{w}tr")])
    return blocks, tables


def parse_pptx(data: bytes) -> tuple[list, list]:
    deck, a, blocks, tables = zipfile.ZipFile(io.BytesIO(data)), _NS["a"], [], []
    names = sorted((n for n in deck.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    for page, name in enumerate(names, 1):
        root = ElementTree.fromstring(deck.read(name))
        said = lambda e: "".join(t.text or "" for t in e.iter(f"{a}t")).strip()
        tables += [[[said(c) for c in r.iter(f"{a}tc")] for r in t.iter(f"{a}tr")] for t in root.iter(f"{a}tbl")]
        inside = {id(p) for t in root.iter(f"{a}tbl") for p in t.iter(f"{a}p")}
        blocks += [("text", t, page) for p in root.iter(f"{a}p") if id(p) not in inside and (t := said(p))]
    return blocks, tables


def parse_xlsx(data: bytes) -> tuple[list, list]:
    """One table per sheet; blank rows are left out, ragged rows stay ragged."""
    book, s = zipfile.ZipFile(io.BytesIO(data)), _NS["s"]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in e.iter(f"{s}t")) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{s}si")]
    tables = []
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        grid = []
        for row in ElementTree.fromstring(book.read(name)).iter(f"{s}row"):
            cells: list[str] = []
            for c in row.findall(f"{s}c"):
                letters = re.match("[A-Z]*", c.get("r") or "")[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v = c.find(f"{s}v")
                raw = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{s}t"))
                cells.append(shared[int(raw)] if c.get("t") == "s" and raw else raw)
            if any(cells):
                grid.append(cells)
        if grid:
            tables.append(grid)
    return [], tables


#: Readers by extension. A reader of PDF pages is injected: none is at hand offline.
READERS: dict[str, Callable[[bytes], tuple[list, list]]] = {
    "html": parse_html, "htm": parse_html, "md": parse_markdown, "txt": parse_text, "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx,
}


def parsed(files: DataFrame, readers: dict[str, Callable] | None = None) -> DataFrame:
    """path, blocks, tables, error of (path, content): each file by the reader of its extension; a failure is a row with an error."""
    known = READERS | (readers or {})

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                extension = path.rpartition(".")[2].lower()
                try:
                    if extension not in known:
                        raise ValueError(f"no reader for .{extension}")
                    blocks, tables = known[extension](bytes(content))
                    rows = [{"position": i, "kind": k, "text": t, "page": p} for i, (k, t, p) in enumerate(blocks)]
                    out.append((path, rows, [_grid(i, t) for i, t in enumerate(tables)], None))
                except Exception as e:
                    out.append((path, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "blocks", "tables", "error"])

    return files.select("path", "content").mapInPandas(run, PARSED)


def read(spark: SparkSession, folder: str, readers: dict[str, Callable] | None = None) -> DataFrame:
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), readers)


def admitted(files: DataFrame, name: str = "path") -> DataFrame:
    """Adds extension and admitted: rejected files stay as rows, to be recorded as failed."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumns({"extension": extension, "admitted": extension.isin(*EXTENSIONS)})


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per line of text of an HTML page, in built-in functions: id, position, text.

    Scripts and styles go, block elements end lines, other tags are removed; entities stay as they are written.
    """
    body = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    body = F.regexp_replace(body, r"(?i)</?(p|div|li|h[1-6]|tr|ul|ol|table|section|article|nav|footer|header|title|body|head|html)\b[^>]*>|<br\s*/?>", "\n")
    lines = F.transform(F.split(F.regexp_replace(body, r"<[^>]*>", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return pages.select(F.col(id_col), F.posexplode(F.filter(lines, lambda x: x != "")).alias("position", "text"))


def first_pages(blocks: DataFrame, n: int, page: str = "page") -> DataFrame:
    return blocks.where(F.col(page) <= n)
