"""Outlines, keys, events and exports against plain Python."""

import hashlib
import io
import json
import random
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folioforge.operators import outlines, requests
from folioforge.sources import exports, pdf

ENTRIES, PAGES = "book_id long, pos long, level long, title string, page long", "book_id long, page long, text string"


def plain_units(entries, pages):
    """Chapters and units of one book by loops."""
    tops, top = [], None
    for _, level, title, page in entries:
        usable = bool(title and title.split()) and page is not None
        if level == 0:
            top = (" ".join(title.split()), page, []) if usable else None
            tops += [top] if top else []
        elif top and usable:
            top[2].append((" ".join(title.split()), page))
    kept = []
    for t in tops:
        if t[1] >= 0 and (not kept or t[1] > kept[-1][1]):
            kept.append(t)
    chapters, units = [], []
    for k, (title, page, subs) in enumerate(kept):
        stop = min(len(pages), kept[k + 1][1] if k + 1 < len(kept) else len(pages))
        if page >= stop:
            continue
        whole = "\n\n".join(pages[page:stop]).strip()
        chapters.append((k + 1, title, whole or title))
        rising = []
        for s in subs:
            if page <= s[1] and (not rising or s[1] > rising[-1][1]):
                rising.append(s)
        rising = [s for s in rising if s[1] < stop]
        if not rising:
            units.append((k + 1, None, None, whole or title, 0, len(whole or title)))
        cursor = 0
        for i, (name, at) in enumerate(rising):
            end = rising[i + 1][1] if i + 1 < len(rising) else stop
            text = "\n\n".join(pages[at:end]).strip() or name
            found = whole.find(text, cursor)
            start = found if found >= 0 else cursor
            cursor = max(cursor, start + len(text))
            units.append((k + 1, i + 1, name, text, start, start + len(text)))
    return chapters, units


def test_chapters_and_units(spark):
    rng = random.Random(5)
    entries, pages, chapters, units = [], [], set(), set()
    for book in range(60):
        texts = [rng.choice(["", " \n", "same page", "same page", f"page {k}\u00a0", "é😀 x"]) for k in range(rng.choice([0, 1, 4, 9]))]
        own = [(k, rng.choice([0, 0, 1, 2]), rng.choice([None, " ", "A  b", f"T{k}"]), rng.choice([None, -1, *range(11)])) for k in range(rng.choice([0, 3, 8]))]
        if rng.random() < 0.6:  # pages that mostly rise
            own = [(k, level, f"T{k}", k + rng.choice([0, 0, 1])) for k, level, _, _ in own]
        entries += [(book, *x) for x in own]
        pages += [(book, k, t) for k, t in enumerate(texts)]
        a, b = plain_units(own, texts)
        chapters |= {(book, *x) for x in a}
        units |= {(book, k, *x) for k, x in enumerate(b, 1)}
    entries, pages = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(pages, PAGES)
    got = outlines.units(entries, pages).select("book_id", "order_index", "chapter_index", "subchapter_index", "subchapter_title", "text", "char_start", "char_end")
    assert {tuple(r) for r in outlines.chapters(entries, pages).collect()} == chapters and len(chapters) > 20
    assert {tuple(r) for r in got.collect()} == units and any(u[3] == 2 for u in units)


def test_empty_outlines(spark):
    none, pages = spark.createDataFrame([], ENTRIES), spark.createDataFrame([(1, 0, None)], PAGES)
    assert not outlines.units(none, pages).collect() and not outlines.chapters(none, pages.where("false")).collect()
    one = spark.createDataFrame([(1, 0, 0, "T", 0)], ENTRIES)
    assert [r["text"] for r in outlines.chapters(one, pages).collect()] == ["T"]


def test_identity_key(spark):
    texts = ["", None, "a  b\n", 'q"\\/', "é😀\x7f\x00\x08", "\x1c x\u3000y\x85", "plain"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = rows.select("k", requests.identity_key({"source_text": F.col("t"), "b": F.lit("é")}, provider=" P ", model=" M ", operation="Op").alias("x")).collect()
    for k, key in got:
        value = texts[k] if texts[k] is None else " ".join(texts[k].split())
        document = json.dumps({"b": "é", "source_text": value}, separators=(",", ":"), sort_keys=True)
        assert key == f"response:p:M:op:{hashlib.sha256(document.encode()).hexdigest()}"


def test_pdf_readers(spark, monkeypatch):
    assert pdf.page_count("Title: x\nPages:          12\nSize: 3\n") == 12
    with pytest.raises(ValueError):
        pdf.page_count("Pages: many")
    item = lambda title, page: SimpleNamespace(title=title, page=page)
    nested = [item("A", 0), [item("B", 1), [item("C", None)]], item(None, 2)]
    assert list(pdf.outline_of(nested, lambda x: x.page)) == [(0, "A", 0), (1, "B", 1), (2, "C", None), (0, "", 2)]
    monkeypatch.setattr(pdf, "tool", lambda name, *_: "Pages: 3\n" if name == "pdfinfo" else " one \f\ftwo\f")
    assert pdf.pages_of(b"%PDF") == ["one", "", "two"]
    pages = spark.createDataFrame([("a", 0, ""), ("a", 1, "x"), ("a", 2, "y "), ("b", 0, " ")], "path string, page long, text string")
    assert pdf.full_text(pages.where("path = 'a'")).collect()[0]["text"] == "x\ny"
    with pytest.raises(Exception, match="no text in PDF b"):
        pdf.full_text(pages).collect()


def test_reader_exports(spark):
    shape = "book_id long, title string, author string, language string, identifier string, chapters array<struct<title: string, text: string>>, stem string, mode string, indices string"
    books = spark.createDataFrame([(1, "T", None, "cs", "i", [("One", "text")], "My Book", "all", None), (2, "U", "A", "", "j", [], None, "range", "1,3")], shape)
    got = {(r["book_id"], r["format"]): r for r in exports.reader_exports(books, ["pdf", "epub"]).collect()}
    assert got[1, "epub"]["name"] == "reader/my-book.cs.all.translated.epub" and got[2, "pdf"]["name"] == "reader/document.lang.chapters-1-3.translated.pdf"
    assert bytes(got[1, "pdf"]["content"]).startswith(b"%PDF") and "OEBPS/chapter_001.xhtml" in zipfile.ZipFile(io.BytesIO(got[1, "epub"]["content"])).namelist()
    assert exports.reader_exports(books, []).collect() == []
    with pytest.raises(ValueError):
        exports.reader_exports(books, ["html"])
