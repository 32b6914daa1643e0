"""Reviewed HTML: documents whose pages, articles and text nodes carry their origin.

A document is parsed to a small element tree, the tree is checked and walked, and each text node becomes a block row.
One task reads one document; a broken document gives one row with its error code instead of blocks, so it stops
nothing else. ``render`` is the inverse for blocks of plain documents.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of documents, or rows, of a frame that leaves a task.
FRAME_BYTES, FRAME_ROWS = 1 << 20, 1 << 12
# Fixed values of the format.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
SKIPPED = ["script", "style"]
NODE_TAGS = ["p", "h2", "h3", "h4", "td", "th", "footer"]
STATUSES = ["SUCCEEDED", "PARTIAL_SUCCESS"]
ROOT = ["data-review-html-version", "data-job-id", "data-review-revision-id", "data-review-generation", "data-conversion-status"]

BLOCKS = (
    "doc_id string, sha256 string, job_id string, revision_id string, generation int, status string, error_code string, "
    "page_number int, page_order int, block_order int, node_id string, kind string, text string, element_id string, "
    "table_id string, cell struct<row:int,column:int,row_span:int,column_span:int>, ocr array<struct<block_id:string,order:int>>"
)
PAGES = "doc_id string, error_code string, page_number int, html_id string, fragment string, readable_text string, elements map<string,string>, ambiguous array<string>"


class HtmlError(ValueError):
    """A document that breaks the format, by its code."""


class Element:
    """A tag with its attributes and contents: elements and texts."""

    def __init__(self, tag: str, attrs: dict[str, str], at: int = 0):
        self.tag, self.attrs, self.parts, self.at, self.end = tag, attrs, [], at, at

    def walk(self) -> Iterator[Element]:
        yield self
        for p in self.parts:
            if isinstance(p, Element):
                yield from p.walk()


class _Tree(HTMLParser):
    """Builds the tree; tags must balance and origin attributes may occur once."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.lines = [0]
        for m in re.finditer("\n", text):
            self.lines.append(m.end())
        self.feed(text)
        self.close()
        if len(self.open) > 1:
            raise HtmlError("TRUNCATED_HTML" if self.open[1].tag == "html" else "MALFORMED_HTML")

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        names = [k for k, _ in attrs if k.startswith("data-") or k in ("id", "class", "rowspan", "colspan")]
        if len(set(names)) < len(names):
            raise HtmlError("DUPLICATE_ATTRIBUTE")
        e = Element(tag, {k: v or "" for k, v in attrs}, self._place())
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if len(self.open) < 2 or self.open[-1].tag != tag:
            raise HtmlError("MALFORMED_HTML")
        self.open.pop().end = self._place() + len(tag) + 3

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def _need(e: Element, *names: str, code: str = "MISSING_STRUCTURAL_PROVENANCE") -> list[str]:
    got = [e.attrs.get(n, "") for n in names]
    if not all(got):
        raise HtmlError(code)
    return got


def _whole(text: str, least: int, code: str) -> int:
    if not re.fullmatch(r"\s*[+-]?\d+\s*", text) or int(text) < least:
        raise HtmlError(code)
    return int(text)


def root_facts(tree: Element) -> dict:
    """The document's job, revision, generation and status."""
    roots = [p for p in tree.parts if isinstance(p, Element) and p.tag == "html"]
    if len(roots) != 1:
        raise HtmlError("MALFORMED_HTML" if roots else "MISSING_HTML_METADATA")
    a = roots[0].attrs
    if "data-review-html-version" in a and a["data-review-html-version"] != "1":
        raise HtmlError("UNSUPPORTED_HTML_VERSION")
    if any(n not in a for n in ROOT):
        raise HtmlError("MISSING_HTML_METADATA")
    _, job, revision, generation, status = (a[n] for n in ROOT)
    if not job or not revision or status not in STATUSES:
        raise HtmlError("INVALID_HTML_METADATA")
    return {"job_id": job, "revision_id": revision, "generation": _whole(generation, 0, "INVALID_HTML_METADATA"), "status": status}


def _silent(e: Element) -> bool:
    return e.tag in SKIPPED or e.attrs.get("data-generated") == "true"


def _classes(e: Element) -> list[str]:
    return e.attrs.get("class", "").split()


def _is_page(e: Element) -> bool:
    return e.tag == "section" and "page" in _classes(e)


def _node_text(e: Element) -> str:
    out = []
    for p in e.parts:
        if isinstance(p, str):
            out.append(p)
        elif p.tag == "br":
            out.append("\n")
        else:
            raise HtmlError("UNSUPPORTED_SOURCE_ELEMENT")
    return "".join(out)


def _references(text: str | None) -> list[dict]:
    names = text.split(" ") if text else []
    if "" in names:
        raise HtmlError("INVALID_HTML_METADATA")
    return [{"block_id": n, "order": k} for k, n in enumerate(names)]


def _block(e: Element, article: Element | None, table: Element | None) -> dict:
    (node_id,) = _need(e, "data-node-id")
    cell = None
    if e.tag in ("td", "th"):
        if table is None:
            raise HtmlError("MISSING_STRUCTURAL_PROVENANCE")
        numbers = [_whole(x, 0, "INVALID_PAGE_STRUCTURE") for x in _need(e, "data-row", "data-column", "rowspan", "colspan")]
        kind, cell = "TABLE_CELL", dict(zip(("row", "column", "row_span", "column_span"), numbers, strict=True))
    elif e.tag == "footer":
        kind = "FOOTER"
    elif article is not None and article.attrs["data-element-id"] == node_id:
        kind = article.attrs["data-kind"]
    else:
        kind = "TITLE"
    return {
        "node_id": node_id, "kind": kind, "text": _node_text(e), "cell": cell,
        "element_id": article.attrs["data-element-id"] if article is not None else None,
        "table_id": table.attrs["data-table-id"] if cell else None, "ocr": _references(e.attrs.get("data-source-id")),
    }


def _page_blocks(e: Element, article: Element | None = None, table: Element | None = None) -> Iterator[dict]:
    for p in e.parts:
        if isinstance(p, str):
            if article is not None and p.strip():
                raise HtmlError("INVALID_PAGE_STRUCTURE")
        elif p.tag in VOID:
            if "data-node-id" in p.attrs:
                raise HtmlError("UNSUPPORTED_SOURCE_ELEMENT")
        elif _silent(p):
            continue
        elif _is_page(p):
            raise HtmlError("MALFORMED_HTML")
        elif p.tag == "article" and "element" in _classes(p):
            _need(p, "data-element-id", "data-kind")
            yield from _page_blocks(p, p, table)
        elif p.tag == "table":
            if article is None:
                raise HtmlError("INVALID_PAGE_STRUCTURE")
            if _need(p, "data-table-id")[0] != article.attrs["data-element-id"]:
                raise HtmlError("INVALID_PAGE_STRUCTURE")
            yield from _page_blocks(p, article, p)
        elif p.tag in NODE_TAGS:
            if article is None:
                raise HtmlError("INVALID_PAGE_STRUCTURE")
            yield _block(p, article, table)
        elif "data-node-id" in p.attrs:
            raise HtmlError("UNSUPPORTED_SOURCE_ELEMENT")
        else:
            yield from _page_blocks(p, article, table)


def _page_sections(tree: Element) -> list[tuple[int, Element]]:
    """The pages in document order, numbered as they say."""

    def find(e: Element) -> Iterator[Element]:
        for p in e.parts:
            if isinstance(p, Element) and not _silent(p):
                if _is_page(p):
                    yield p
                else:
                    if "data-node-id" in p.attrs:
                        raise HtmlError("INVALID_PAGE_STRUCTURE")
                    yield from find(p)

    pages = []
    for p in find(tree):
        number = _whole(_need(p, "data-page")[0], 1, "INVALID_PAGE_STRUCTURE")
        if p.attrs.get("id") != f"source-page-{number}":
            raise HtmlError("INVALID_PAGE_STRUCTURE")
        pages.append((number, p))
    if len({n for n, _ in pages}) < len(pages):
        raise HtmlError("DUPLICATE_PAGE")
    return pages


def parse(text: str) -> tuple[dict, list[tuple[int, list[dict]]]]:
    """A document's root facts and its pages' blocks."""
    if "<html" not in text.lower():
        raise HtmlError("MISSING_HTML_METADATA")
    tree = _Tree(text).root
    facts = root_facts(tree)
    pages = [(n, list(_page_blocks(p))) for n, p in _page_sections(tree)]
    ids = [b["node_id"] for _, blocks in pages for b in blocks]
    if len(set(ids)) < len(ids):
        raise HtmlError("DUPLICATE_NODE_ID")
    return facts, pages


def block_rows(doc_id: str, content: bytes) -> list[dict]:
    """All blocks of a document, or one row with its error code."""
    head = {"doc_id": doc_id, "sha256": hashlib.sha256(content).hexdigest(), "error_code": None}
    try:
        facts, pages = parse(content.decode("utf-8"))
    except UnicodeDecodeError:
        return [head | {"error_code": "INVALID_ENCODING"}]
    except HtmlError as why:
        return [head | {"error_code": str(why)}]
    return [
        head | facts | {"page_number": n, "page_order": k, "block_order": i} | b
        for k, (n, blocks) in enumerate(pages)
        for i, b in enumerate(blocks)
    ]


def _readable(e: Element) -> tuple[str, list[tuple[str, str]]]:
    """Text of a page as it reads, and of each element with an identifier."""
    named: list[tuple[str, str]] = []

    def text(p) -> str:
        if isinstance(p, str):
            return p
        if p.tag == "br":
            return "\n"
        if p.tag in SKIPPED:
            return ""
        inner = "".join(text(x) for x in p.parts)
        for key in ("id", "data-node-id", "data-element-id"):
            if p.attrs.get(key):
                named.append((p.attrs[key], inner.strip()))
        around = " " if p.tag in ("td", "th") else "\n" if p.tag in ("p", "h1", "h2", "h3", "h4", "tr", "table", "article", "section", "footer", "li", "div") else ""
        return around + inner + around

    whole = "".join(text(p) for p in e.parts)
    return re.sub(r"[ \t]*\n\s*", "\n", whole).strip(), named


def page_rows(doc_id: str, content: bytes) -> list[dict]:
    """Each page's exact fragment, readable text and texts by identifier; ambiguous identifiers apart."""
    try:
        text = content.decode("utf-8")
        tree = _Tree(text).root
        root_facts(tree)
        pages = _page_sections(tree)
        if not pages:
            raise HtmlError("NO_PAGES")
    except (HtmlError, UnicodeDecodeError) as why:
        return [{"doc_id": doc_id, "error_code": str(why) if isinstance(why, HtmlError) else "INVALID_ENCODING"}]
    out = []
    for n, p in pages:
        readable, named = _readable(p)
        by: dict[str, list[str]] = {}
        for k, v in named:
            by.setdefault(k, []).append(v)
        plain = {k: max(v, key=len) for k, v in by.items() if len(v) == 1 or len(v) == 2 and (v[0] in v[1] or v[1] in v[0])}
        out.append(
            {"doc_id": doc_id, "error_code": None, "page_number": n, "html_id": p.attrs["id"], "fragment": text[p.at : p.end],
             "readable_text": readable, "elements": plain, "ambiguous": sorted(set(by) - set(plain))}
        )
    return out


def _rows(files: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in re.split(r",\s*(?![^<]*>)", schema)]
        frame = lambda rows: pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
        for b in batches:
            rows, size = [], 0
            for d, c in zip(b["doc_id"], b["content"], strict=True):
                rows += make(d, bytes(c))
                size += len(c)
                if size >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                    yield frame(rows)
                    rows, size = [], 0
            yield frame(rows)

    return files.select("doc_id", "content").mapInPandas(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and content of HTML files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def read_blocks(files: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, content), broken ones as one row with error_code."""
    return _rows(files, block_rows, BLOCKS)


def read_pages(files: DataFrame) -> DataFrame:
    """Prepared pages of documents (doc_id, content)."""
    return _rows(files, page_rows, PAGES)


def render(facts: dict, pages: list[tuple[int, list[dict]]]) -> str:
    """A reviewed HTML document whose blocks read back as given (paragraphs, cells and footers)."""
    safe = lambda x: html.escape(str(x), quote=True)
    values = ["1", facts["job_id"], facts["revision_id"], facts["generation"], facts["status"]]
    out = ["<!doctype html>\n<html " + " ".join(f'{n}="{safe(v)}"' for n, v in zip(ROOT, values, strict=True)) + ">\n<body><main>"]
    for number, blocks in pages:
        out.append(f'<section class="page" id="source-page-{number}" data-page="{number}">')
        at = 0
        while at < len(blocks):
            b, end = blocks[at], at + 1
            while end < len(blocks) and blocks[end]["element_id"] == b["element_id"]:
                end += 1
            group = blocks[at:end]
            kind = next((g["kind"] for g in group if g["node_id"] == b["element_id"]), "table" if b.get("cell") else b["kind"])
            out.append(f'<article class="element" data-kind="{safe(kind)}" data-element-id="{safe(b["element_id"])}">')
            cells = [g for g in group if g.get("cell")]
            for g in group:
                refs = " ".join(r["block_id"] for r in g.get("ocr") or [])
                source = f' data-source-id="{safe(refs)}"' if refs else ""
                text = "<br>".join(safe(t) for t in g["text"].split("\n"))
                if not g.get("cell"):
                    tag = "footer" if g["kind"] == "FOOTER" else "p"
                    out.append(f'<{tag} data-node-id="{safe(g["node_id"])}"{source}>{text}</{tag}>')
                    continue
                if g is cells[0]:
                    out.append(f'<table data-table-id="{safe(b["element_id"])}"><tbody>')
                c = g["cell"]
                out.append(
                    f'<tr><td rowspan="{c["row_span"]}" colspan="{c["column_span"]}" data-row="{c["row"]}" data-column="{c["column"]}" '
                    f'data-node-id="{safe(g["node_id"])}"{source}>{text}</td></tr>'
                )
                if g is cells[-1]:
                    out.append("</tbody></table>")
            out.append("</article>")
            at = end
        out.append("</section>")
    return "\n".join([*out, "</main></body>\n</html>\n"])
