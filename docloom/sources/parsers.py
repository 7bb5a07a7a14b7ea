"""Files, pages and repositories read as documents.

Each parser is a plain function from content to a record; :func:`parse_files` runs them
over a binary scan, one file at a time, and turns failures into rows with an error.
"""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MATH_SYMBOLS

#: Source type by a file's ending.
SUFFIXES = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "ppt": "pptx", "md": "markdown", "txt": "text"}
PARSED = "text string, title string, page_count int, has_images boolean, has_tables boolean, has_equations boolean, is_slide_format boolean, complexity string, tables array<array<array<string>>>, metadata map<string,string>"
Record = dict


def detect_source_type(path: Column) -> Column:
    """The source type of a path by its ending, null where none is known."""
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def _record(text: str, **given) -> Record:
    base = {"title": None, "page_count": 1, "has_images": False, "has_tables": False, "has_equations": False, "is_slide_format": False, "complexity": "text_only", "tables": [], "metadata": {}}
    return {"text": text} | base | given


def table_markdown(rows: list[list[str | None]]) -> str:
    """Rows of cells as a Markdown table; the first is the header."""
    if not rows or not rows[0]:
        return ""
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).strip().replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def markdown_tables(text: str) -> list[list[list[str]]]:
    """The tables of a Markdown text that have at least two rows, without their rule lines."""
    out, rows = [], []
    for line in [*(x.strip() for x in text.splitlines()), ""]:
        if len(line) > 1 and line[0] == line[-1] == "|":
            cells = [c.strip() for c in line.split("|") if c.strip()]
            if cells and not all(set(c) <= set("-:") for c in cells):
                rows.append(cells)
        else:
            out += [rows] if len(rows) > 1 else []
            rows = []
    return out


def parse_text(content: bytes, markdown: bool) -> Record:
    """A text file: Markdown as it is, plain text with its paragraphs set apart."""
    text = content.decode("utf-8", "ignore")
    lines = len(text.splitlines())
    common = {"page_count": max(1, lines // 50), "metadata": {"line_count": str(lines), "is_markdown": str(markdown).lower()}}
    if markdown:
        tables = markdown_tables(text)
        return _record(text, has_images="![" in text, has_equations="$" in text, has_tables=bool(tables), tables=tables, **common)
    body = "\n\n".join(p.strip() for p in text.split("\n\n") if p.strip())
    return _record(body, has_equations=any(c in text for c in MATH_SYMBOLS), **common)


_VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Elements that hold nothing of the content, and those that are read.
DROPPED = ("script", "style", "nav", "footer", "header", "aside", "form", "iframe")
READ = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "code", "table")


class _Node:
    def __init__(self, tag: str, parent: _Node | None) -> None:
        self.tag, self.parent, self.children = tag, parent, []

    def walk(self) -> Iterator[_Node]:
        for c in self.children:
            if isinstance(c, _Node):
                yield c
                yield from c.walk()

    def find(self, tag: str) -> _Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def runs(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, _Node):
                yield from c.runs()
            else:
                yield c

    def text(self) -> str:
        return "".join(s for s in (x.strip() for x in self.runs()) if s)

    def raw(self) -> str:
        return "".join(self.runs())


class _Tree(HTMLParser):
    """The elements of a page as written; an end tag closes up to its start, one without a start is ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.here.children.append(_Node(tag, self.here))

    def handle_endtag(self, tag: str) -> None:
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def _rows(table: _Node) -> list[list[str]]:
    cells = [[c.text() for c in tr.walk() if c.tag in ("td", "th")] for tr in table.walk() if tr.tag == "tr"]
    return [r for r in cells if r]


def _element(node: _Node) -> str:
    if node.tag == "table":
        rows = _rows(node)
        return table_markdown(rows) if len(rows) > 1 else ""
    text = node.text()
    if not text or node.tag == "p":
        return text
    if node.tag[0] == "h":
        return "#" * int(node.tag[1]) + " " + text
    if node.tag == "pre":
        inner = node.find("code") or node
        return f"```\n{inner.raw().strip()}\n```"
    return f"`{text}`" if node.tag == "code" else f"- {text}"


def parse_html(html: str, url: str) -> Record:
    """A page's content in Markdown: of its main, article or body element, without what surrounds it.

    Elements are read in document order, nested ones too, so text within several of them
    occurs several times; runs within an element are joined without a blank.
    """
    tree = _Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    title = root.find("title")

    def prune(node: _Node) -> None:
        node.children = [c for c in node.children if not (isinstance(c, _Node) and c.tag in DROPPED)]
        for c in node.children:
            if isinstance(c, _Node):
                prune(c)

    prune(root)
    main = root.find("main") or root.find("article") or root.find("body") or root
    nodes = [n for n in main.walk() if n.tag in READ and not (n.tag == "code" and n.parent is not None and n.parent.tag == "pre")]
    parts = [p for p in map(_element, nodes) if p]
    tables = [r for r in (_rows(n) for n in nodes if n.tag == "table") if len(r) > 1]
    name = (title.text() if title is not None else "") or url
    meta = {"url": url, "title": name, "paragraph_count": str(len(parts))}
    return _record("\n\n".join(parts), title=name, has_tables=bool(tables), complexity="full_pipeline" if tables else "text_only", tables=tables, metadata=meta)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def parse_docx(content: bytes) -> Record:
    """A Word file: headings by style, then its tables; needs only the standard library."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    body = _xml(archive, "word/document.xml").find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    parts, count = [], 0
    for p in body.findall(f"{_W}p"):
        count += 1
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") if style is not None else "").lower()
        text = said(p).strip()
        level = 1 if name == "title" else min(4, int(m[1])) if (m := re.match(r"heading\s*(\d)", name)) else 0
        if text:
            parts.append("#" * level + " " + text if level else text)
    tables = [[[said(c).strip() for c in row.findall(f"{_W}tc")] for row in t.findall(f"{_W}tr")] for t in body.iter(f"{_W}tbl")]
    tables = [t for t in tables if t]
    images = sum(n.startswith("word/media/") for n in archive.namelist())
    text = "\n\n".join(parts + [table_markdown(t) for t in tables])
    kind = "full_pipeline" if tables or images else "text_only"
    return _record(text, page_count=max(1, count // 30), has_images=images > 0, has_tables=bool(tables), has_equations=any(c in text for c in MATH_SYMBOLS), complexity=kind, tables=tables, metadata={"image_count": str(images)})


def parse_pptx(content: bytes) -> Record:
    """A slide file: a section per slide with title, text, tables and notes; needs only the standard library."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
    said = lambda node: "\n".join(s for s in ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in node.iter(f"{_A}p")) if s)
    slides, tables, images = [], [], 0
    for n, name in enumerate(names, 1):
        slide, parts = _xml(archive, name), [f"## Slide {n}"]
        for shape in slide.iter(f"{_P}sp"):
            text = said(shape)
            kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
            if text:
                parts.append(f"### {text}" if kind is not None and kind.get("type") in ("title", "ctrTitle") else text)
        for table in slide.iter(f"{_A}tbl"):
            rows = [[said(c) for c in tr.iter(f"{_A}tc")] for tr in table.iter(f"{_A}tr")]
            if rows:
                tables.append(rows)
                parts.append(table_markdown(rows))
        images += sum(1 for _ in slide.iter(f"{_P}pic"))
        notes = _xml(archive, f"ppt/notesSlides/notesSlide{n}.xml")
        if notes is not None and (text := said(notes)):
            parts.append("\n".join(f"> {x}" for x in text.split("\n")))
        slides.append("\n\n".join(parts))
    return _record("\n\n---\n\n".join(slides), page_count=len(names), has_images=images > 0, has_tables=bool(tables), is_slide_format=True, complexity="slide_mode", tables=tables, metadata={"image_count": str(images)})


#: Mean words of a page below which a PDF is slides.
SLIDE_WORDS = 120


#: Tabs and blanks of a page above which it is taken to hold a table.
_TABS, _GAPS = 4, 15


def pdf_complexity(pages: list[str], images: int) -> str:
    """How a PDF is read: as slides, as text only, or with its tables and figures."""
    if pages and sum(len(p.split()) for p in pages) / len(pages) < SLIDE_WORDS:
        return "slide_mode"
    hints = any(p.count("\t") > _TABS or p.count("   ") > _GAPS for p in pages)
    return "full_pipeline" if images or hints else "text_only"


_COLUMNS = re.compile(r"\t+| {3,}")


def page_tables(page: str) -> list[list[list[str]]]:
    """The tables of a page's text: two lines or more, one under another, of as many cells set apart by tabs or three blanks."""
    out, rows = [], []
    for line in [*page.split("\n"), ""]:
        cells = [c.strip() for c in _COLUMNS.split(line.strip())]
        if len(cells) > 1 and (not rows or len(cells) == len(rows[0])):
            rows.append(cells)
            continue
        out += [rows] if len(rows) > 1 else []
        rows = [cells] if len(cells) > 1 else []
    return out


def pdf_record(pages: list[str], images: int = 0, tables: list[tuple[int, list[list[str]]]] | None = None, sizes: list[tuple[int, int, int]] | None = None) -> Record:
    """A PDF's pages put together; ``tables`` are (page, rows), ``sizes`` (page, width, height) of its images."""
    kind, tables = pdf_complexity(pages, images), [t for t in tables or [] if len(t[1]) > 1]
    label = "Slide" if kind == "slide_mode" else "Page"
    body = [f"## {label} {n}\n\n{p.strip()}" for n, p in enumerate(pages, 1) if p.strip()]
    if kind == "full_pipeline":
        body += [f"**Table (page {n})**\n\n{table_markdown(rows)}" for n, rows in tables]
        body += [f"[Figure on page {n}: {w} x {h}]" for n, w, h in sizes or [] if min(w, h) >= 100]
    text = "\n\n---\n\n".join(body)
    return _record(text, page_count=len(pages), has_images=images > 0, has_tables=bool(tables), has_equations=any(c in text for c in MATH_SYMBOLS), is_slide_format=kind == "slide_mode", complexity=kind, tables=[t for _, t in tables])


def parse_pdf(content: bytes) -> Record:
    """A PDF by the optional library pypdf; without it an ImportError that says so."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF files needs the optional package pypdf") from e
    pages = list(PdfReader(io.BytesIO(content)).pages)
    sizes = [(n, *i.image.size) for n, p in enumerate(pages, 1) for i in p.images]
    texts = [p.extract_text(extraction_mode="layout") or "" for p in pages]
    return pdf_record(texts, len(sizes), [(n, rows) for n, t in enumerate(texts, 1) for rows in page_tables(t)], sizes)


PARSERS: dict[str, Callable[[bytes], Record]] = {
    "markdown": lambda b: parse_text(b, True),
    "text": lambda b: parse_text(b, False),
    "docx": parse_docx,
    "pptx": parse_pptx,
    "pdf": parse_pdf,
}


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of the files under a folder; a scan, nothing is read until it is needed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content", "length")


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as documents: (path, source_type, error, parsed columns), and ``modificationTime`` if they have it.

    A file of an unknown type or one that can't be read gives a row with its error.
    """
    kept = [c for c in ("modificationTime",) if c in files.columns]
    rows = files.select("path", detect_source_type(F.col("path")).alias("source_type"), "content", *kept)
    columns = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", PARSED)]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, content, *more in pdf.itertuples(index=False):
                try:
                    if kind is None:
                        raise ValueError("unsupported file type")
                    got, error = PARSERS[kind](bytes(content)), None
                except Exception as e:
                    got, error = dict.fromkeys(columns), f"{type(e).__name__}: {e}"
                out.append((path, kind, *more, error, *(got[c] for c in columns)))
            yield pd.DataFrame(out, columns=["path", "source_type", *kept, "error", *columns])

    return rows.mapInPandas(parse, f"path string, source_type string, {''.join(f'{c} timestamp, ' for c in kept)}error string, {PARSED}")


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) as documents (url, parsed columns); a null page has empty text."""
    columns = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", PARSED)]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse_html(h or "", u or "") for u, h in zip(pdf["url"], pdf["html"])]
            yield pd.DataFrame([(u, *(r[c] for c in columns)) for u, r in zip(pdf["url"], rows)], columns=["url", *columns])

    return pages.select("url", "html").mapInPandas(parse, f"url string, {PARSED}")


def repository_name(url: Column) -> Column:
    """Owner and repository of an address, as ``owner/repo``; null where it has none."""
    pattern = r"github\.com[/:]([^/\s]+)/([^/\s#?]+?)(?:\.git)?(?:[/#?].*)?$"
    owner, repo = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return F.when((owner != "") & (repo != ""), F.concat_ws("/", owner, repo))


def docstrings(source: str, path: str) -> list[tuple[str, str]]:
    """(name, docstring) of a module, its classes and functions; none for source that can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) and (doc := ast.get_docstring(node)):
            out.append((path if isinstance(node, ast.Module) else node.name, doc))
    return out


#: How a README is named, and the bounds of a repository scan.
READMES = ("README.md", "readme.md", "README.rst", "README.txt", "README")
MOST_FILES, MOST_BYTES = 50, 100_000


def parse_repository(files: DataFrame, root: str) -> DataFrame:
    """(text, title, n_files) of a checkout scanned as ``files``: its README, then docstrings by file.

    The first 50 Python files below 100,000 bytes count, in the order of their paths; that
    bound is the operator's own, so its one row stays small. Nothing found is an error.
    """
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = files.select(rel.alias("path"), "content", "length")
    readme = rows.where(F.col("path").isin(*READMES)).select("path", "content", F.lit(0).alias("kind"))
    python = rows.where(F.endswith("path", F.lit(".py")) & (F.col("length") < MOST_BYTES)).orderBy("path").limit(MOST_FILES).select("path", "content", F.lit(1).alias("kind"))

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        names = pdf[pdf["kind"] == 0]
        for name in READMES:
            hit = names[names["path"] == name]
            if len(hit):
                parts.append(bytes(hit["content"].iloc[0]).decode("utf-8", "ignore"))
                break
        code = pdf[pdf["kind"] == 1].sort_values("path")
        for path, content in zip(code["path"], code["content"]):
            found = docstrings(bytes(content).decode("utf-8", "ignore"), path)
            if found:
                parts.append(f"## {path}\n\n" + "\n\n".join(f"**{name}**\n\n{doc}" for name, doc in found))
        if not parts:
            raise ValueError("the repository has neither a README nor docstrings")
        return pd.DataFrame({"text": ["\n\n".join(parts)], "title": [root.rstrip("/").rsplit("/", 1)[-1]], "n_files": [len(code)]})

    return readme.unionByName(python).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(joined, "text string, title string, n_files int")


def model_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(id, owned_by, active, context_window) of a model list in JSON, one row per model."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("data").alias("m")).select("m.*")
