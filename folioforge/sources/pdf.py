"""PDF files: a small writer for translated books, and pages and outlines where there is a reader.

Text comes from `pdfinfo` and `pdftotext` on the executors or else from `pypdf`,
outlines from `pypdf`; without them there is an error that says so.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import strip

#: An A4 page, its margin, and the width of a character as a share of the type size.
WIDTH, HEIGHT, MARGIN, CHAR = 595, 842, 56, 0.56
BODY, HEAD, LEAD = 11.0, 16.0, 1.4


def printable(text: str) -> str:
    """What Latin-1 has; a tab is four spaces, a line end or hard space one, anything else a question mark."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = text.replace("\t", "    ").replace(" ", " ").replace("\n", " ")
    return "".join(c if " " <= c <= "ÿ" else "?" for c in text)


def wrap(text: str, width: float, size: float) -> list[str]:
    """Lines of whole words, greedily; a longer word is cut."""
    most = max(12, int(width / (size * CHAR)))
    lines: list[str] = []
    line = ""
    for word in text.split():
        while len(word) > most:
            if line:
                lines.append(line)
                line = ""
            lines.append(word[:most])
            word = word[most:]
        if line and len(line) + 1 + len(word) > most:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return [*lines, line] if line else lines


def layout(title: str, chapters: Sequence[tuple[str, str]]) -> list[list[tuple[float, float, str]]]:
    """Pages of lines, each with its size and its height above the page's foot; a chapter begins a page."""
    pages: list[list[tuple[float, float, str]]] = [[(HEAD, HEIGHT - MARGIN - HEAD, printable(title))]]
    for heading, body in chapters:
        pages.append([])
        top = HEIGHT - MARGIN
        blocks = [(HEAD, wrap(printable(heading), WIDTH - 2 * MARGIN, HEAD))]
        blocks += [(BODY, wrap(printable(p), WIDTH - 2 * MARGIN, BODY)) for p in re.split(r"\n\s*\n", body) if p.strip()]
        for size, lines in blocks:
            for line in lines:
                if top - size * LEAD < MARGIN:
                    pages.append([])
                    top = HEIGHT - MARGIN
                top -= size * LEAD
                pages[-1].append((size, top, line))
            top -= size * 0.6
    return pages


def build(title: str, chapters: Sequence[tuple[str, str]]) -> bytes:
    """A PDF file, byte for byte the same for the same book."""
    quote = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    pages = layout(title, chapters)
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        stream = "\n".join(f"BT /F1 {size:g} Tf {MARGIN} {y:.2f} Td ({quote(t)}) Tj ET" for size, y, t in page).encode("latin-1")
        kids.append(len(objects) + 1)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {len(objects) + 2} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def build_pdfs(books: DataFrame) -> DataFrame:
    """`book_id` and `content` of each book; `books` has `book_id`, `title`, `chapters` (array of title, text)."""
    kind = books.schema["book_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(t, [(c["title"], c["text"] or "") for c in cs]) for t, cs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["book_id", "content"])

    return books.select("book_id", "title", "chapters").mapInArrow(run, f"book_id {kind}, content binary")


def tool(name: str, *arguments: str) -> str | None:
    """What a PDF tool prints, or None where it isn't installed."""
    if not shutil.which(name):
        return None
    done = subprocess.run([name, *arguments], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"{name} failed: {done.stderr.decode('utf-8', 'replace').strip() or 'unknown error'}")
    return done.stdout.decode("utf-8", "replace")


def page_count(info: str) -> int:
    """The number of pages by what `pdfinfo` prints."""
    found = re.search(r"^Pages:\s+([0-9]+)\s*$", info, re.MULTILINE)
    if not found:
        raise ValueError("the page count isn't in what pdfinfo printed")
    return int(found[1])


def pages_of(content: bytes) -> list[str]:
    """Text of every page, blank ones included: by the tools, else by a PDF library, else there is an error."""
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        info = tool("pdfinfo", f.name)
        text = None if info is None else tool("pdftotext", "-enc", "UTF-8", f.name, "-")
    if info is not None and text is not None:
        pages = text.split("\f")
        n = page_count(info)
        return [x.strip() for x in (pages + [""] * n)[:n]]
    try:
        from pypdf import PdfReader
    except ImportError:
        raise RuntimeError("reading PDF files needs pdfinfo and pdftotext, or pypdf, on the executors") from None
    return [(page.extract_text() or "").replace("\f", "\n").strip() for page in PdfReader(io.BytesIO(content)).pages]


def outline_of(items: Sequence[object], page_of: Callable[[object], int | None], level: int = 0) -> Iterator[tuple[int, str, int | None]]:
    """Level, title and page of an outline's items in reading order; a list holds what lies below the item before it."""
    for item in items:
        if isinstance(item, list):
            yield from outline_of(item, page_of, level + 1)
        else:
            yield level, str(getattr(item, "title", "") or ""), page_of(item)


def _read_outline(content: bytes) -> list[tuple[int, str, int | None]]:
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))

    def page_of(item: object) -> int | None:
        try:
            return reader.get_destination_page_number(item)
        except Exception:  # an item may point outside the file or nowhere; it has no target then
            return None

    return list(outline_of(reader.outline or [], page_of))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def _rows(kinds: dict[str, pa.DataType], make: Callable[[bytes], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches of `path`, `content` that gives the rows made of each file, a batch for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(source, *r) for r in make(content.as_py())]
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return run


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `page` (from 0), `text` of every page of the PDF files in a folder."""
    kinds = {"path": pa.string(), "page": pa.int64(), "text": pa.string()}
    return _files(spark, path).mapInArrow(_rows(kinds, lambda content: list(enumerate(pages_of(content)))), "path string, page long, text string")


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the PDF files' outlines as `operators.outlines` takes them, with `path`; needs `pypdf` on the executors."""
    kinds = {"path": pa.string(), "pos": pa.int64(), "level": pa.int64(), "title": pa.string(), "page": pa.int64()}
    return _files(spark, path).mapInArrow(_rows(kinds, lambda content: [(k, *x) for k, x in enumerate(_read_outline(content))]), "path string, pos long, level long, title string, page long")


def full_text(pages: DataFrame) -> DataFrame:
    """`path` and `text` of whole files, pages joined by line ends; a file without text is an error."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    text = strip(F.array_join("t", "\n"))
    refused = F.raise_error(F.concat(F.lit("no text in PDF "), F.col("path"))).cast("string")
    return pages.groupBy("path").agg(ordered.alias("t")).select("path", F.when(text == "", refused).otherwise(text).alias("text"))
