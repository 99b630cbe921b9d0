"""PDF outlines as tables: their hierarchy, and the chapters and units that they cut from pages.

`entries` are an outline's items in reading order: `book_id`, `pos`, `level` (0 at
the top), `title` and `page` (from 0; null: no target).  `pages` are a book's pages,
blank ones included: `book_id`, `page` (from 0, without gaps) and `text`.  Everything
is a window or a group by `book_id`, so texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import collapse_title, strip


def hierarchy(entries: DataFrame) -> DataFrame:
    """Usable entries, each with its chapter (`parent`, the position of the top entry above it).

    All that lies below a top entry belongs to it, however deep.  An entry without a
    title or a target is dropped, a top one with everything below it.
    """
    upto = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    titled = entries.withColumn("title", collapse_title(F.col("title")))
    usable = F.col("title").isNotNull() & F.col("page").isNotNull()
    top = F.last(F.when(F.col("level") == 0, F.struct(F.col("pos"), usable.alias("usable"))), ignorenulls=True).over(upto)
    kept = titled.withColumn("top", top).where(usable & F.col("top.usable"))
    return kept.select("book_id", F.col("top.pos").alias("parent"), "pos", "level", "title", "page")


def nodes(entries: DataFrame) -> DataFrame:
    """Chapters whose pages increase, numbered, each with its subchapters (array of pos, page, title) whose pages increase from its own."""
    in_book = Window.partitionBy("book_id").orderBy("pos")
    top = F.col("level") == 0
    before = F.max(F.when(top, F.col("page"))).over(in_book.rowsBetween(Window.unboundedPreceding, -1))
    rising = top & (F.col("page") >= 0) & (F.col("page") > F.coalesce(before, F.lit(-1)))
    marked = hierarchy(entries).withColumn("rising", rising)
    chapter = F.last(F.when(top, F.struct("rising", "page", "title")), ignorenulls=True).over(in_book.rowsBetween(Window.unboundedPreceding, 0))
    held = marked.withColumn("chapter", chapter).where(F.col("chapter.rising") & (F.col("page") >= F.col("chapter.page")))
    earlier = F.max(F.when(~top, F.col("page"))).over(Window.partitionBy("book_id", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("earlier", earlier).where(top | F.col("earlier").isNull() | (F.col("page") > F.col("earlier")))
    subs = F.sort_array(F.collect_list(F.when(~top, F.struct("pos", "page", "title"))))
    grouped = held.groupBy("book_id", "parent").agg(F.first("chapter").alias("chapter"), subs.alias("subs"))
    index = F.row_number().over(Window.partitionBy("book_id").orderBy("parent")).cast("long")
    return grouped.select("book_id", index.alias("chapter_index"), F.col("chapter.title").alias("title"), F.col("chapter.page").alias("page"), "subs")


def _joined(texts: Column) -> Column:
    return strip(F.array_join(texts, "\n\n"))


def _or_title(text: Column, title: Column) -> Column:
    return F.when(text == "", title).otherwise(text)


def _with_pages(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Each chapter that has pages with their texts in order: its mark is filled forward over the pages that follow."""
    marks = nodes(entries).select("book_id", "page", F.lit(None).cast("string").alias("text"), F.struct("chapter_index", "title", "page", "subs").alias("node"))
    texts = pages.select("book_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("book_id").orderBy("page", F.col("text").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.unionByName(texts, allowMissingColumns=True).withColumn("node", F.last("node", ignorenulls=True).over(w))
    held = filled.where("text IS NOT NULL AND node IS NOT NULL").withColumn("chapter_index", F.col("node.chapter_index"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return held.groupBy("book_id", "chapter_index").agg(F.first("node").alias("node"), ordered.alias("texts"))


def chapters(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """`book_id`, `chapter_index`, `title` and `text` of an outline's chapters; one without text has its title for text."""
    title = F.col("node.title")
    return _with_pages(entries, pages).select("book_id", "chapter_index", title.alias("title"), _or_title(_joined(F.col("texts")), title).alias("text"))


def units(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Subchapters, or chapters without any, as units to plan from, in order, with their place in the chapter's text.

    The place is the first occurrence at or after the end of the unit before, else
    that end; pages of a chapter before its first subchapter are in no unit.  The
    fold appends two numbers for each subchapter of one chapter.
    """
    first, count = F.col("node.page"), F.size("texts")
    valid = F.filter("node.subs", lambda s: s["page"] < first + count)
    cut = _with_pages(entries, pages).withColumn("subs", valid).withColumn("chapter_text", _joined(F.col("texts")))

    def unit(s: Column, i: Column) -> Column:
        after = F.coalesce(F.try_element_at("subs", (i + 2).cast("int"))["page"], first + count)
        text = _joined(F.slice("texts", (s["page"] - first + 1).cast("int"), (after - s["page"]).cast("int")))
        return F.struct((i + 1).cast("long").alias("subchapter_index"), s["title"].alias("subchapter_title"), _or_title(text, s["title"]).alias("text"))

    whole = F.struct(F.lit(None).cast("long").alias("subchapter_index"), F.lit(None).cast("string").alias("subchapter_title"), _or_title(F.col("chapter_text"), F.col("node.title")).alias("text"))
    parts = cut.withColumn("parts", F.when(F.size("subs") == 0, F.array(whole)).otherwise(F.transform("subs", unit)))

    def place(done: Column, part: Column) -> Column:
        found = F.call_function("locate", part["text"], F.col("chapter_text"), done["cursor"] + 1)
        start = F.when(found > 0, found - 1).otherwise(done["cursor"])
        end = start + F.length(part["text"])
        return F.struct(F.greatest(done["cursor"], end).alias("cursor"), F.concat(done["places"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("places"))

    empty = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<start: int, end: int>>").alias("places"))
    placed = parts.withColumn("places", F.aggregate("parts", empty, place, lambda s: s["places"]))
    rows = placed.select("book_id", "chapter_index", F.col("node.title").alias("chapter_title"), F.inline(F.arrays_zip("parts", "places")))
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index", "parts.subchapter_index")).cast("long")
    return rows.select(
        "book_id", order.alias("order_index"), "chapter_index", "chapter_title", "parts.subchapter_index", "parts.subchapter_title", "parts.text",
        F.col("places.start").cast("long").alias("char_start"), F.col("places.end").cast("long").alias("char_end"),
    )


def status(books: DataFrame, entries: DataFrame, pages: DataFrame) -> DataFrame:
    """`status` of each of `books`: its outline gives chapters, is missing (no usable top entry), or is invalid (none on a page that there is)."""
    first = nodes(entries).groupBy("book_id").agg(F.min("page").alias("first"))
    counted = pages.groupBy("book_id").agg(F.count("*").alias("n_pages"))
    joined = books.select("book_id").join(first, "book_id", "left").join(counted, "book_id", "left")
    reached = F.col("first") < F.coalesce("n_pages", F.lit(0))
    return joined.select("book_id", F.when(F.col("first").isNull(), "outline_missing").when(reached, "pdf_outline").otherwise("outline_invalid").alias("status"))
