"""EPUB packages as tables, and books of chapters as EPUB files.

Packages are read from `binaryFile` rows: one task opens one archive, nothing is
shuffled.  Writing gives the archives as a binary column, byte for byte the same
for the same book.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from html import escape
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioforge.functions.text import BLOCKS

#: Media types of spine documents with text.
TEXT_TYPES = ("application/xhtml+xml", "text/html", "application/xml")
#: Fixed value: the time of every entry of an archive that is written.
STAMP = (1980, 1, 1, 0, 0, 0)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in ("script", "style")
        if tag in BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        # a line break written as <br> has no end; one written as <br/> has
        elif tag in BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out.append(data)


def xhtml_text(markup: str) -> str:
    """The text of a page by the same rules as `functions.text.html_to_text`, for any entity."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    text = re.sub(r"\r\n?", "\n", "".join(parser.out))
    text = re.sub(r"[ \t\f\v]+", " ", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


class Package(NamedTuple):
    title: str | None
    author: str | None
    #: Archive path and text of each document, in reading order.
    spine: list[tuple[str, str]]
    #: Archive path and title of each navigation entry; None if there is no navigation.
    nav: list[tuple[str, str]] | None


def resolve(base: str, href: str) -> str | None:
    """Archive path of a link from the document `base`, without its fragment; None outside the archive."""
    target = unquote(href.split("#", 1)[0])
    if not target:
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(base), target))
    return None if path.startswith(("../", "/")) or path == ".." else path


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _all(node, name: str) -> list:
    return [x for x in node.iter() if _local(x) == name]


def _first_text(node, name: str) -> str | None:
    found = (" ".join((x.text or "").split()) for x in _all(node, name))
    return next((x for x in found if x), None)


def _nav_entries(content: str, path: str) -> list[tuple[str, str]]:
    root = ElementTree.fromstring(content)
    if _local(root) == "ncx":
        points = [(_all(p, "content"), _first_text(p, "text")) for p in _all(root, "navPoint")]
        pairs = [(c[0].get("src", ""), t) for c, t in points if c]
    else:
        navs = _all(root, "nav")
        kind = lambda n: next((v for k, v in n.attrib.items() if k.rpartition("}")[2] == "type"), "")
        tocs = [n for n in navs if "toc" in kind(n).split()] or navs
        chosen = next((n for n in tocs if _all(n, "a")), None)
        pairs = [(a.get("href", ""), " ".join("".join(a.itertext()).split())) for a in _all(chosen, "a")] if chosen is not None else []
    return [(target, title or href) for href, title in pairs if (target := resolve(path, href))]


def parse(content: bytes) -> Package:
    """A package: container, then its metadata, manifest, spine and navigation."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
        opf = _all(container, "rootfile")[0].get("full-path")
        package = ElementTree.fromstring(archive.read(opf))
        items = {x.get("id"): x for x in _all(package, "item")}
        spine = []
        for ref in _all(package, "itemref"):
            item = items.get(ref.get("idref"))
            if item is None or (item.get("media-type") or "").strip().lower() not in TEXT_TYPES:
                continue
            path = resolve(opf, item.get("href", ""))
            if path in archive.namelist():
                spine.append((path, xhtml_text(archive.read(path).decode("utf-8", "replace"))))
        navs = [x for x in items.values() if "nav" in (x.get("properties") or "").split()]
        ncx = [x for x in items.values() if x.get("media-type") == "application/x-dtbncx+xml"]
        nav = None
        for item in [*navs[:1], *ncx[:1]][:1]:
            path = resolve(opf, item.get("href", ""))
            try:
                nav = _nav_entries(archive.read(path).decode("utf-8", "replace"), path)
            except (ElementTree.ParseError, KeyError):
                nav = []
        return Package(_first_text(package, "title"), _first_text(package, "creator"), spine, nav)


def chapters_of(package: Package) -> list[tuple[str, str]]:
    """Title and text of each chapter: from navigation entries whose documents only move forward, else one for each document."""
    texts = [t for _, t in package.spine]
    places = {path: k for k, (path, _) in enumerate(package.spine)}
    starts: list[tuple[int, str]] = []
    for path, title in package.nav or []:
        at = places.get(path)
        if at is not None and (not starts or at > starts[-1][0]):
            starts.append((at, title))
    if not starts:
        return [(f"Chapter {k + 1}", t) for k, t in enumerate(x for x in texts if x.strip())]
    ends = [s for s, _ in starts[1:]] + [len(texts)]
    return [(title, "\n\n".join(t for t in texts[a:b] if t.strip()).strip() or title) for (a, title), b in zip(starts, ends, strict=True)]


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `book_title`, `author`, `chapter_index`, `title`, `text` of every chapter of the EPUB files in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                package = parse(content.as_py())
                rows = [(source, package.title, package.author, k + 1, *c) for k, c in enumerate(chapters_of(package))]
                columns = zip(*rows, strict=True) if rows else [()] * 6
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "book_title", "author", "chapter_index", "title", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, book_title string, author string, chapter_index long, title string, text string")


def build(title: str, author: str | None, language: str, identifier: str, chapters: Sequence[tuple[str, str]]) -> bytes:
    """An EPUB 3 archive with an EPUB 2 table of contents."""
    names = [f"chapter_{k:03d}.xhtml" for k in range(1, len(chapters) + 1)]
    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{escape(language)}"><head><title>{escape(head)}</title></head><body>{body}</body></html>\n'
    paragraphs = lambda text: "".join(f"<p>{escape(p.strip())}</p>" for p in re.split(r"\n\s*\n", text) if p.strip())
    manifest = "".join(f'<item id="c{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names, 1))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(1, len(names) + 1))
    creator = f"<dc:creator>{escape(author)}</dc:creator>" if author else ""
    opf = (
        '<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title>{creator}<dc:language>{escape(language)}</dc:language><meta property="dcterms:modified">1980-01-01T00:00:00Z</meta></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{manifest}</manifest><spine toc="ncx">{refs}</spine></package>\n'
    )
    links = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    points = "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for k, (n, (t, _)) in enumerate(zip(names, chapters, strict=True), 1))
    files = [
        ("META-INF/container.xml", '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'),
        ("OEBPS/content.opf", opf),
        ("OEBPS/nav.xhtml", page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>')),
        ("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>\n'),
        *((f"OEBPS/{n}", page(t, f"<h1>{escape(t)}</h1>{paragraphs(b)}")) for n, (t, b) in zip(names, chapters, strict=True)),
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(zipfile.ZipInfo("mimetype", STAMP), "application/epub+zip", zipfile.ZIP_STORED)
        for name, content in files:
            archive.writestr(zipfile.ZipInfo(name, STAMP), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def build_epubs(books: DataFrame) -> DataFrame:
    """`book_id` and `content` of each book; `books` has `book_id`, `title`, `author`, `language`, `identifier`, `chapters` (array of title, text)."""
    kind = books.schema["book_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(t, a, n, i, [(c["title"], c["text"] or "") for c in cs]) for t, a, n, i, cs in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["book_id", "content"])

    return books.select("book_id", "title", "author", "language", "identifier", "chapters").mapInArrow(run, f"book_id {kind}, content binary")
