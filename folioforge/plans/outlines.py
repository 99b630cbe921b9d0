"""Queries over outlines with pages, keys of responses and events of stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.operators import outlines, requests, runs
from folioforge.plans.catalog import _sql_value, query, table

# -- books of eight conversations, whose turns are pages; their outlines have blank titles, lost targets and pages that fall

_SQL_PAGES = "SELECT book_id, n - 1 AS page, CASE WHEN (book_id + n) % 5 = 0 THEN '  ' ELSE text END AS text FROM (SELECT conv_id // 8 AS book_id, row_number() OVER (PARTITION BY conv_id // 8 ORDER BY conv_id, turn, role, text) AS n, text FROM conversations)"
_SQL_ENTRIES = (
    "SELECT book_id, page AS pos, CASE WHEN page = 0 THEN 1 ELSE (page - 1) % 4 END AS level, CASE WHEN (book_id + page) % 7 = 0 THEN ' ' ELSE '  Part ' || page || chr(10) || ' x ' END AS title,"
    " CASE WHEN (book_id + page) % 11 = 0 THEN NULL WHEN (book_id + page) % 13 = 5 THEN page - 3 WHEN (book_id + page) % 17 = 3 THEN page + 5 ELSE page END AS page FROM pages_"
)
_SQL_NODES = (
    f"WITH RECURSIVE pages_ AS MATERIALIZED ({_SQL_PAGES}), entries AS ({_SQL_ENTRIES}),"
    " clean AS (SELECT book_id, pos, level, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, page FROM entries),"
    " under AS (SELECT *, max(CASE WHEN level = 0 THEN pos END) OVER (PARTITION BY book_id ORDER BY pos) AS parent FROM clean),"
    " good AS (SELECT u.* FROM under u JOIN clean t ON t.book_id = u.book_id AND t.pos = u.parent WHERE t.title <> '' AND t.page IS NOT NULL AND u.title <> '' AND u.page IS NOT NULL),"
    " tops AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS chapter_index FROM good g WHERE level = 0 AND page >= 0 AND NOT EXISTS (SELECT 1 FROM good h WHERE h.book_id = g.book_id AND h.level = 0 AND h.pos < g.pos AND h.page >= g.page)),"
    " sized AS (SELECT book_id, count(*) AS n_pages FROM pages_ GROUP BY 1),"
    " spans AS (SELECT t.*, least(n_pages, lead(page, 1, n_pages) OVER (PARTITION BY book_id ORDER BY page)) AS stop FROM tops t JOIN sized USING (book_id)),"
    " kids AS (SELECT c.book_id, s.chapter_index, c.title, c.page, row_number() OVER (PARTITION BY c.book_id, c.parent ORDER BY c.pos) AS i, lead(c.page, 1, s.stop) OVER (PARTITION BY c.book_id, c.parent ORDER BY c.pos) AS stop"
    " FROM good c JOIN spans s ON s.book_id = c.book_id AND s.pos = c.parent WHERE c.level > 0 AND c.page >= s.page AND c.page < s.stop AND NOT EXISTS (SELECT 1 FROM good h WHERE h.book_id = c.book_id AND h.parent = c.parent AND h.level > 0 AND h.pos < c.pos AND h.page >= c.page)),"
)
_TEXT = "coalesce(nullif(regexp_replace(regexp_replace(string_agg(p.text, chr(10) || chr(10) ORDER BY p.page), '^\\s+', ''), '\\s+$', ''), ''), {0}.title)"
_SQL_CHAPTERS = _SQL_NODES + f" chapters AS (SELECT s.book_id, s.chapter_index, s.title, {_TEXT.format('s')} AS text FROM spans s JOIN pages_ p ON p.book_id = s.book_id AND p.page >= s.page AND p.page < s.stop GROUP BY s.book_id, s.chapter_index, s.title)"
#: Places are found one subchapter after the other.
_SQL_UNITS = (
    _SQL_CHAPTERS + f", texts AS (SELECT k.book_id, k.chapter_index, k.i, k.title, {_TEXT.format('k')} AS text FROM kids k JOIN pages_ p ON p.book_id = k.book_id AND p.page >= k.page AND p.page < k.stop GROUP BY k.book_id, k.chapter_index, k.i, k.title),"
    " tried AS (SELECT t.book_id, t.chapter_index, t.i, t.title, t.text, c.title AS chapter_title, c.text AS chapter_text FROM texts t JOIN chapters c USING (book_id, chapter_index)),"
    " walk AS (SELECT book_id, chapter_index, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b FROM chapters UNION ALL"
    " SELECT t.book_id, t.chapter_index, t.i, CASE WHEN strpos(substr(t.chapter_text, w.b + 1), t.text) > 0 THEN w.b + strpos(substr(t.chapter_text, w.b + 1), t.text) - 1 ELSE w.b END AS a,"
    " CASE WHEN strpos(substr(t.chapter_text, w.b + 1), t.text) > 0 THEN w.b + strpos(substr(t.chapter_text, w.b + 1), t.text) - 1 ELSE w.b END + length(t.text) AS b FROM walk w JOIN tried t ON t.book_id = w.book_id AND t.chapter_index = w.chapter_index AND t.i = w.i + 1),"
    " parts AS (SELECT t.book_id, t.chapter_index, t.chapter_title, t.i AS subchapter_index, t.title AS subchapter_title, t.text, w.a AS char_start, w.b AS char_end FROM tried t JOIN walk w USING (book_id, chapter_index, i)"
    " UNION ALL SELECT c.book_id, c.chapter_index, c.title, NULL, NULL, c.text, 0, length(c.text) FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM kids k WHERE k.book_id = c.book_id AND k.chapter_index = c.chapter_index))"
    " SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, subchapter_index) AS order_index, chapter_index, chapter_title, coalesce(subchapter_index, 0) AS subchapter_index, subchapter_title, text, char_start, char_end FROM parts"
)


def _book_pages(spark, sf_dir):
    book = F.expr("conv_id div 8")
    n = F.row_number().over(Window.partitionBy(book).orderBy("conv_id", "turn", "role", "text")).cast("long")
    turns = table(spark, sf_dir, "conversations").select(book.alias("book_id"), n.alias("n"), "text")
    return turns.select("book_id", (F.col("n") - 1).alias("page"), F.when((F.col("book_id") + F.col("n")) % 5 == 0, "  ").otherwise(F.col("text")).alias("text"))


def _book_entries(pages):
    p, k = F.col("page"), F.col("book_id") + F.col("page")
    title = F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("  Part "), p.cast("string"), F.lit("\n x ")))
    target = F.when(k % 11 == 0, None).when(k % 13 == 5, p - 3).when(k % 17 == 3, p + 5).otherwise(p)
    return pages.select("book_id", p.alias("pos"), F.when(p == 0, 1).otherwise((p - 1) % 4).alias("level"), title.alias("title"), target.alias("page"))


@query(_SQL_CHAPTERS + " SELECT book_id, chapter_index, title, text FROM chapters")
def outline_texts(spark, sf_dir):
    """Chapters of books by their outlines, with the text of their pages."""
    pages = _book_pages(spark, sf_dir)
    return outlines.chapters(_book_entries(pages), pages)


@query(_SQL_UNITS)
def outline_units(spark, sf_dir):
    """Units to plan from: subchapters of outlines with their places in the chapters' texts; a whole chapter's index is 0 here."""
    pages = _book_pages(spark, sf_dir)
    return outlines.units(_book_entries(pages), pages).withColumn("subchapter_index", F.coalesce("subchapter_index", F.lit(0)))


#: Books' outlines (level, title, page), their numbers of pages, and their statuses.
_OUTLINES = [
    ([(0, "A", 0)], 1, "pdf_outline"), ([], 3, "outline_missing"), ([(0, " ", 0), (1, "B", 0)], 3, "outline_missing"), ([(1, "B", 0)], 3, "outline_missing"), ([(0, "A", None)], 3, "outline_missing"),
    ([(0, "A", -1)], 3, "outline_missing"), ([(0, "A", 3)], 3, "outline_invalid"), ([(0, "A", 0)], 0, "outline_invalid"), ([(0, "A", 5), (0, "B", 2)], 3, "outline_invalid"), ([(0, "A", -1), (0, "B", 2)], 3, "pdf_outline"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, {_sql_value(s)})" for k, (_, _, s) in enumerate(_OUTLINES)) + ") v(book_id, status)")
def outline_status(spark, sf_dir):
    """Whether a book's outline gives chapters, is missing or doesn't fit its pages."""
    books = spark.range(len(_OUTLINES)).select(F.col("id").alias("book_id"))
    entries = spark.createDataFrame([(b, k, *e) for b, (es, _, _) in enumerate(_OUTLINES) for k, e in enumerate(es)], "book_id long, pos long, level long, title string, page long")
    pages = spark.createDataFrame([(b, k, "t") for b, (_, n, _) in enumerate(_OUTLINES) for k in range(n)], "book_id long, page long, text string")
    return outlines.status(books, entries, pages)


# -- keys and events -------------------------------------------------------------------

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CHAR = (
    "CASE WHEN c = '\"' THEN '\\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(8) THEN '\\b' WHEN unicode(c) BETWEEN 32 AND 126 THEN c"
    " WHEN unicode(c) < 65536 THEN '\\u' || printf('%04x', unicode(c)) ELSE '\\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) END"
)


@query(
    "SELECT doc_id, 'response:openai:gpt-4:translate:' || sha256('{\"source_text\":\"' || array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda c: " + _CHAR + "), '') || '\",\"target_language\":\"' || lang || '\"}') AS cache_key"
    f" FROM (SELECT doc_id, lang, trim(regexp_replace('é \"q\" \\ ' || chr(7) || chr(8) || chr(127) || '😀' || chr(160) || ' ' || coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS t FROM documents)"
)
def cache_identity(spark, sf_dir):
    """Keys of responses from canonical identities; the texts are given quotes, controls and characters of two UTF-16 units."""
    text = F.concat(F.lit('é "q" \\ \x07\x08\x7f😀\xa0 '), F.coalesce("text", F.lit("")))
    key = requests.identity_key({"target_language": F.col("lang"), "source_text": text}, provider=" OpenAI ", model=" gpt-4 ", operation="Translate")
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"))


#: Stages of runs with their errors, and the lines and places that come of them.
_RUNS = {
    1: ([("extract", None), ("clean", None)], [("INFO", "extract", "start", "1/10"), ("INFO", "extract", "complete", None), ("INFO", "clean", "start", "2/10"), ("INFO", "clean", "complete", None)]),
    2: ([("tts", "Time Out"), ("merge", None)], [("INFO", "tts", "start", "7/10"), ("ERROR", "tts", "failure error_type=Time_Out", None)]),
    3: ([("reader-export", " ")], [("INFO", "reader-export", "start", None), ("ERROR", "reader-export", "failure error_type=none", None)]),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({r}::BIGINT, {k}::BIGINT, '[phase] level={a} stage={b} event={c}', {_sql_value(d)})" for r, (_, lines) in _RUNS.items() for k, (a, b, c, d) in enumerate(lines, 1)) + ") v(run_id, seq, line, place)")
def stage_events(spark, sf_dir):
    """Log lines of the stages of runs; nothing runs after a failure."""
    return runs.stage_events(spark.createDataFrame([(r, k, *x) for r, (stages, _) in _RUNS.items() for k, x in enumerate(stages)], "run_id long, n long, stage string, error_type string"))
