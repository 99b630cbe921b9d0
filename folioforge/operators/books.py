"""Books: chapters from headings, outlines and reading orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import collapse_title, strip

#: A heading line: the word, an arabic or roman number on it or the next line, and a title after a separator.
CHAPTER = r"(?imdU)^(\s*(?:chapter|kapitola)\s+(?:\d+|[ivxlcdm]+)(?:[ \t]*[:.\-][ \t]*[^\n]+|[ \t]+[^\n]+)?)\s*$"
SUBCHAPTER = r"(?imdU)^(\s*(?:\d+\.\d+(?:\.\d+)*|(?:section|subchapter)\s+\d+)(?:[ \t]*[:.\-][ \t]*[^\n]+|[ \t]+[^\n]+)?)\s*$"
#: Marks a cut; where a text has the first character itself, it is followed by the third, so no text has a cut.
MARK, CUT, PLAIN = "\ue000", "\ue000\ue001", "\ue000\ue002"


def from_documents(docs: DataFrame, chapters: int = 8) -> DataFrame:
    """Books of `chapters` documents, each under a heading line."""
    book = F.expr(f"doc_id div {chapters}")
    numbered = docs.select(book.alias("book_id"), "doc_id", "lang", "text", F.row_number().over(Window.partitionBy(book).orderBy("doc_id")).alias("n"))
    line = F.concat(F.lit("Chapter "), F.col("n").cast("string"), F.lit(": "), F.col("lang"), F.lit("\n"), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("doc_id", line.alias("t"))))
    return numbered.groupBy("book_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def _pieces(text: Column, heading: str) -> Column:
    """The text before the first heading, then for each heading its line and what follows, cut apart."""
    unified = F.replace(strip(F.regexp_replace(text, r"\r\n?", "\n")), F.lit(MARK), F.lit(PLAIN))
    pieces = F.split(F.regexp_replace(unified, heading, f"{CUT}$1{CUT}"), CUT)
    return F.transform(pieces, lambda x: F.replace(x, F.lit(PLAIN), F.lit(MARK)))


def split_chapters(books: DataFrame) -> DataFrame:
    """`book_id`, `chapter_index`, `title`, `text`; text before the first heading is a chapter of its own."""
    cut = books.where(strip(F.col("text")) != "").select("book_id", _pieces(F.col("text"), CHAPTER).alias("p"))
    lead = strip(F.col("p")[0])
    titled = F.expr("transform(sequence(1, greatest(1, (size(p) - 1) div 2)), k -> struct(get(p, 2 * k - 1) AS title, get(p, 2 * k) AS text))")
    named = F.filter(titled, lambda x: x["title"].isNotNull())
    first = F.struct(F.lit("Chapter 1").alias("title"), lead.alias("text"))
    rows = cut.select("book_id", F.posexplode(F.when(lead == "", named).otherwise(F.concat(F.array(first), named))).alias("k", "c"))
    title = collapse_title(F.col("c.title"))
    body = strip(F.col("c.text"))
    return rows.select("book_id", (F.col("k") + 1).cast("long").alias("chapter_index"), title.alias("title"), F.when(body == "", title).otherwise(body).alias("text"))


def split_subchapters(chapters: DataFrame) -> DataFrame:
    """Units of each chapter; without headings the chapter is one, and text before the first heading is dropped."""
    cut = chapters.select("book_id", "chapter_index", "text", _pieces(F.col("text"), SUBCHAPTER).alias("p"))
    titled = F.expr("transform(sequence(1, (size(p) - 1) div 2), k -> struct(p[2 * k - 1] AS title, p[2 * k] AS text))")
    one = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("text").alias("text")))
    rows = cut.select("book_id", "chapter_index", F.posexplode(F.when(F.size("p") >= 3, titled).otherwise(one)).alias("k", "c"))
    title, body = collapse_title(F.col("c.title")), strip(F.col("c.text"))
    return rows.select("book_id", "chapter_index", (F.col("k") + 1).cast("long").alias("subchapter_index"), title.alias("title"), F.when(body == "", F.coalesce(title, body)).otherwise(body).alias("text"))


def choose_split(books: DataFrame) -> DataFrame:
    """Where each book's chapters and structure come from, and why a better source was passed over.

    `books` has `format` (pdf, epub or another), `outline` and `nav` (how many
    chapters each gives; null: it failed), their `outline_status` and
    `nav_status`, and `units` (of the outline's structure; null: it failed).
    """
    from_outline = (F.col("format") == "pdf") & (F.coalesce("outline", F.lit(0)) > 0)
    from_nav = (F.col("format") == "epub") & (F.coalesce("nav", F.lit(0)) > 0)
    source = F.when(from_outline, "pdf_outline").when(from_nav, "epub_nav").otherwise("text_heuristic")
    failed = lambda n, status, kind: F.when(F.col(n).isNull(), kind).otherwise(F.col(status))
    reason = (
        F.when(from_outline | from_nav, "")
        .when(F.col("format") == "pdf", failed("outline", "outline_status", "outline_invalid"))
        .when(F.col("format") == "epub", failed("nav", "nav_status", "nav_invalid"))
        .otherwise("outline_unsupported_for_format")
    )
    chosen = books.withColumn("source", source).withColumn("reason", reason)
    has_units = (F.col("source") == "pdf_outline") & (F.coalesce("units", F.lit(0)) > 0)
    structure = F.when(has_units, "pdf_outline").when(F.col("source") == "epub_nav", "epub_nav").otherwise("text_heuristic")
    return chosen.withColumn("structure", structure)


def outline(lines: DataFrame) -> DataFrame:
    """Outline entries (`book_id`, `pos`, `page`) from order lines."""
    return lines.groupBy(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("pos")).agg((F.max("l_partkey") % 20).cast("long").alias("page"))


def increasing(entries: DataFrame, order: str = "pos", value: str = "page") -> DataFrame:
    """Entries above all before them: a greedy choice, as rejected entries never raise the maximum."""
    before = Window.partitionBy("book_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("top", F.max(value).over(before)).where(f"top IS NULL OR {value} > top").drop("top")


def outline_pages(entries: DataFrame, pages: int) -> DataFrame:
    """Pages of each chapter, from its page to the next chapter's; ranges are laid out, not joined."""
    w = Window.partitionBy("book_id").orderBy("pos")
    ranged = entries.select("book_id", F.row_number().over(w).cast("long").alias("chapter_index"), "page", F.lead("page", 1, pages).over(w).alias("next"))
    return ranged.where("next > page").select("book_id", "chapter_index", (F.col("next") - F.col("page")).cast("long").alias("pages"), F.col("page").cast("long").alias("first_page"), (F.col("next") - 1).cast("long").alias("last_page"))


def spine_chapters(pages: DataFrame) -> DataFrame:
    """Chapters of a reading order from navigation hits: increasing starts are filled forward, so no range join is needed."""
    book = F.col("page_id") % 25
    spine = pages.select(book.alias("book_id"), "page_id", F.row_number().over(Window.partitionBy(book).orderBy("page_id")).cast("long").alias("pos"))
    hits = spine.where("page_id % 3 <> 1").withColumn("rank", F.struct(F.col("page_id") % 7, F.col("page_id")))
    starts = increasing(hits, order="rank", value="pos").select("book_id", "pos", F.lit(1).alias("start"))
    marked = spine.join(starts, ["book_id", "pos"], "left")
    upto = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chapters = marked.withColumn("chapter_index", F.sum("start").over(upto)).where("chapter_index IS NOT NULL")
    return chapters.groupBy("book_id", "chapter_index").agg(F.count("*").alias("documents"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))


def greedy_packs(items: Column, budget: int, *, joint: int = 2) -> Column:
    """How many packs hold the items in order, joined by `joint` characters, none above the budget if it can be helped."""
    start = F.struct(F.lit(0).alias("packs"), F.lit(0).alias("size"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["packs"] > 0) & (s["size"] + joint + F.length(x) <= budget)
        return F.struct(F.when(fits, s["packs"]).otherwise(s["packs"] + 1).alias("packs"), F.when(fits, s["size"] + joint + F.length(x)).otherwise(F.length(x)).alias("size"))

    return F.aggregate(items, start, step, lambda s: s["packs"].cast("long"))


def identifiers(docs: DataFrame) -> DataFrame:
    """Identifier of each book: the head of a digest over its format, path, language, scope and chapters."""
    book = F.expr("doc_id div 8")
    scope = F.concat(F.lit("chapter_scope_indices_csv="), F.array_join(F.transform(F.sequence(F.lit(1), F.count("*").cast("int")), lambda x: x.cast("string")), ","), F.lit(",chapter_scope_mode=all"))
    head = F.concat(F.lit("epub|books/"), F.first(book).cast("string"), F.lit(".epub|cs|"), scope, F.lit("|"))
    numbered = docs.select(book.alias("book_id"), "doc_id", F.concat(F.row_number().over(Window.partitionBy(book).orderBy("doc_id")).cast("string"), F.lit(":"), F.col("lang")).alias("t"))
    titles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), "|")
    return numbered.groupBy("book_id").agg(F.substring(F.sha2(F.concat(head, titles), 256), 1, 24).alias("identifier"))


def lay_out(turns: DataFrame, height: int) -> DataFrame:
    """Page and height used on it after each block of a conversation, by a fold that begins a new page on overflow."""
    blocks = F.sort_array(F.collect_list(F.struct("turn", (F.lit(20) + F.length("text") % 90).alias("h"))))
    empty = F.array().cast("array<struct<turn: bigint, page: bigint, used: bigint>>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        over = last["used"] + x["h"] > height
        first = F.size(done) == 0
        page = F.when(first, 1).when(over, last["page"] + 1).otherwise(last["page"]).cast("long")
        used = F.when(first | over, x["h"]).otherwise(last["used"] + x["h"]).cast("long")
        return F.concat(done, F.array(F.struct(x["turn"].alias("turn"), page.alias("page"), used.alias("used"))))

    folded = turns.groupBy("conv_id").agg(blocks.alias("b")).select("conv_id", F.aggregate("b", empty, step).alias("p"))
    return folded.select("conv_id", F.inline("p"))
