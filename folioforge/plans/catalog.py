"""The query catalogue: every query as a Spark plan, with the SQL that gives its rows.

Integers are longs and lists are strings, so that results compare by value.
Derived inputs (books of eight documents, outlines, runs) are the same
expressions in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import books, media, requests, runs
from folioforge.operators.sentences import ABBREVIATIONS, BACK, FORWARD, chunk_rows, plan_rows, repair_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def sql_values(rows: list[str], name: str) -> str:
    quoted = ", ".join("('" + r.replace("'", "''") + "')" for r in rows)
    return f"(VALUES {quoted}) v({name})"


# -- cleaning --------------------------------------------------------------------

_PY = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


@query(r"SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || '12' || chr(10)), '(?m)^\s*\d+\s*$', '', 'g') AS text FROM documents")
def clean_page_numbers(spark, sf_dir):
    noisy = F.replace("text", F.lit("\n"), F.lit("\n12\n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.blank_page_numbers(noisy).alias("text"))


@query(r"SELECT doc_id, regexp_replace(replace(text, 'on', 'o-' || chr(10) || 'n'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS text FROM documents")
def clean_hyphenation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.join_hyphens(F.replace("text", F.lit("on"), F.lit("o-\nn"))).alias("text"))


@query("SELECT doc_id, translate(replace(replace(text, 'the', '“the”'), ',', '’'), '“”’', '\"\"''') AS text FROM documents")
def clean_quotes(spark, sf_dir):
    noisy = F.replace(F.replace("text", F.lit("the"), F.lit("“the”")), F.lit(","), F.lit("’"))
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_quotes(noisy).alias("text"))


@query(r"SELECT doc_id, replace(regexp_replace(replace(text, ' ', ' ' || chr(9) || ' '), '[ \t]+', ' ', 'g'), ' ' || chr(10), chr(10)) AS text FROM documents")
def clean_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_blanks(F.replace("text", F.lit(" "), F.lit(" \t "))).alias("text"))


@query(r"SELECT doc_id, regexp_replace(replace(text, '. ', ' [Fig. 3]. '), '(?i)\[\s*fig(?:ure)?\.?\s*\d+\s*\]', '', 'g') AS text FROM documents")
def clean_figure_refs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.drop_figure_refs(F.replace("text", F.lit(". "), F.lit(" [Fig. 3]. "))).alias("text"))


#: Openings of a text, and what becomes of each: merged, merged with the next line's indent, and left alone for
#: a heading of two words, a list marker before, a gap of two lines, and a list marker on the next line.
_CAPS = [("E\nVERY MOMENT IN TIME\n", "EVERY MOMENT IN TIME\n", 1), ("  T\n\n    HEKING rose\n", "    THEKING rose\n", 1)]
_CAPS += [(x, x, 0) for x in ("A\nTHE - KING\n", "1.\nA\nALPHA item\n", "A\n\n\nBCDE far below\n", "A\n- BCDE in a list\n")]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN {_sql_text(x)}" for k, (_, x, _n) in enumerate(_CAPS)) + " END || text AS text, CAST(CASE WHEN doc_id % 6 < 2 THEN 1 ELSE 0 END AS BIGINT) AS merges FROM documents")
def clean_drop_caps(spark, sf_dir):
    opening = F.element_at(F.array(*[F.lit(x) for x, _, _ in _CAPS]), (F.col("doc_id") % 6 + 1).cast("int"))
    merged = table(spark, sf_dir, "documents").select("doc_id", T.merge_drop_caps(F.concat(opening, F.col("text"))).alias("m"))
    return merged.select("doc_id", F.col("m.text").alias("text"), F.col("m.merges").cast("long").alias("merges"))


@query(
    r"SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || '7' || chr(10)), '(?m)^\s*\d+\s*$', '', 'g'),"
    r" '[ \t]+', ' ', 'g'), ' ' || chr(10), chr(10)), '^\s+', ''), '\s+$', '') AS text FROM documents"
)
def clean_pipeline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.replace("text", F.lit("\n"), F.lit("\n7\n"))).alias("text"))


_BLOCKS = "|".join(T.BLOCKS)
#: The entities that the pages have; the ampersand comes last.
_ENTITIES = "{0}"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("amp", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(
    "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + _ENTITIES.format(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<\\?.*?>', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), "
        f"'(?i)<(?:{_BLOCKS})\\b[^>]*/>', chr(10) || chr(10), 'g'), '(?i)</?(?:{_BLOCKS})\\b[^>]*>', chr(10), 'g'), '(?s)</?[A-Za-z][^>]*>', '', 'g')"
    )
    + ", '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') AS text FROM pages"
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


#: Base letters of the accented letters that the texts have; `ß` has none.
_ACCENTED, _BASE = "ÄÇÈÉÊËÍÎÑÓÔÖÙÛÜßäçèéêëíîñóôöùûü", "ACEEEEIINOOOUUU aceeeeiinooouuu"
_SLUG = f"regexp_replace(regexp_replace(lower(replace(translate({{0}}, '{_ACCENTED}', '{_BASE.replace(' ', chr(1))}'), chr(1), '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(r"SELECT doc_id, nullif(trim(regexp_replace(substr(text, 1, 60), '\s+', ' ', 'g')), '') AS title FROM documents")
def title_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_title(F.substring("text", 1, 60)).alias("title"))


@query(f"SELECT doc_id, printf('%03d_%02d_%s', doc_id % 40, doc_id % 7, coalesce(nullif({_SLUG.format('substr(text, 1, 30)')}, ''), 'part')) AS part_id FROM documents")
def slug_part_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.part_id(F.col("doc_id") % 40, F.col("doc_id") % 7, F.substring("text", 1, 30)).alias("part_id"))


@query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(substr(text, 1, 24))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'book') || '.' || lang AS basename FROM documents")
def reader_basename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(T.reader_token(F.substring("text", 1, 24)), F.lit("."), F.col("lang")).alias("basename"))


#: Titles of packaged chapters; the empty one has a default in both forms.
_TITLES = ["Český název: Úvod!", "Cafő łódź ﬁn", "a/b\\\\c", "???", "   ", "What? Why: <how>", "ǅungla №5 ½"]
#: By the compatibility decompositions of Unicode.
_SLUGS = ["cesky-nazev-uvod", "cafo-odz-fin", "a-b-c", "part", "part", "what-why-how", "dzungla-no5-12"]
_SHOWN = ["Český název- Úvod!", "Cafő łódź ﬁn", "a-b-c", "-", "Untitled Chapter", "What- Why- -how-", "ǅungla №5 ½"]


@query("SELECT n, printf('chapter_%03d_', n) || slug || '.m4a' AS file, printf('%03d - ', n) || shown || '.mp3' AS shown FROM (VALUES " + ", ".join(f"({k}::BIGINT, {_sql_text(a)}, {_sql_text(b)})" for k, (a, b) in enumerate(zip(_SLUGS, _SHOWN, strict=True), 1)) + ") v(n, slug, shown)")
def packaged_filename(spark, sf_dir):
    titles = spark.createDataFrame(list(enumerate(_TITLES, 1)), "n long, title string")
    return titles.select("n", T.packaged_name(F.col("n"), F.col("title"), "m4a", friendly=False).alias("file"), T.packaged_name(F.col("n"), F.col("title"), "mp3", friendly=True).alias("shown"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS text FROM documents")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.html_escape(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), '    '), '[\x{a0}\n]', ' ', 'g'), '[^\x20-\x{ff}]', '?', 'g') AS text FROM (SELECT doc_id, text || chr(13) || chr(10) || chr(13) || chr(127) || chr(150) || chr(160) || '…ő' AS x FROM documents)")
def latin1_sanitize(spark, sf_dir):
    odd = F.concat(F.col("text"), F.lit("\r\n\r\x7f\x96\xa0…ő"))
    return table(spark, sf_dir, "documents").select("doc_id", T.latin1(odd).alias("text"))


#: Messages, and what is shown of them: words that only look like keys stay.
_MESSAGES = [
    ("bad key sk-abcdefgh1 given", "bad key [redacted-key] given"),
    ("sk-short1 and risk-abcdefgh1 and ask-me_now", "sk-short1 and risk-abcdefgh1 and ask-me_now"),
    ("BEARER  abc.def-12345 x", "Bearer [redacted-token] x"),
    ("bearer short", "bearer short"),
    ("  a \n\t b  ", "a b"),
    ("y" * 180, "y" * 180),
    ("z" * 181, "z" * 179 + "..."),
]


@query("SELECT n, message FROM (VALUES " + ", ".join(f"({k}::BIGINT, {_sql_text(x)})" for k, (_, x) in enumerate(_MESSAGES)) + ") v(n, message) UNION ALL SELECT doc_id + 100, CASE WHEN length(x) > 180 THEN substr(x, 1, 179) || '...' ELSE x END FROM (SELECT doc_id, trim(regexp_replace('failed with [redacted-key] and Bearer [redacted-token] ' || text, '\\s+', ' ', 'g')) AS x FROM documents)")
def secret_redaction(spark, sf_dir):
    literals = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(_MESSAGES)], "n long, x string")
    key = F.format_string("failed with sk-abc%05d and bearer tok.%08d ", F.col("doc_id"), F.col("doc_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id") + 100, F.concat(key, F.col("text")))
    return literals.union(docs).select("n", T.redact(F.col("x")).alias("message"))


_WORDS = ["1", "true", "Yes", " on ", "0", "FALSE", "no", "off", "maybe", ""]


@query(f"SELECT word, CASE WHEN lower(trim(word)) IN ('1','true','yes','on') THEN true WHEN lower(trim(word)) IN ('0','false','no','off') THEN false END AS value FROM {sql_values(_WORDS, 'word')}")
def permissive_boolean(spark, sf_dir):
    return values(spark, _WORDS, "word").select("word", T.permissive_boolean(F.col("word")).alias("value"))


# -- books, chapters and outlines ------------------------------------------------------

#: A book is eight documents, each a chapter under a heading line.
_BOOK = "SELECT doc_id // 8 AS book_id, string_agg('Chapter ' || n || ': ' || lang || chr(10) || text, chr(10) ORDER BY doc_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS n FROM documents) GROUP BY 1"


@query(f"SELECT book_id, i AS chapter_index, 'Chapter ' || i || ': ' || lang AS title, {_PY.format('text')} AS text FROM (SELECT doc_id // 8 AS book_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS i, lang, text FROM documents)")
def chapter_split(spark, sf_dir):
    return books.split_chapters(books.from_documents(table(spark, sf_dir, "documents")))


@query(
    f"SELECT book_id, i + 1 AS chapter_index, 'Chapter ' || i || ': ' || lang AS title, {_PY.format('text')} AS text FROM (SELECT doc_id // 8 AS book_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS i, lang, text FROM documents)"
    " UNION ALL SELECT DISTINCT doc_id // 8, 1, 'Chapter 1', 'Opening words' FROM documents"
)
def chapter_split_preamble(spark, sf_dir):
    made = books.from_documents(table(spark, sf_dir, "documents"))
    return books.split_chapters(made.withColumn("text", F.concat(F.lit("Opening words\n"), F.col("text"))))


@query(f"SELECT doc_id AS book_id, CAST(1 AS BIGINT) AS chapter_index, k AS subchapter_index, '1.' || k || ' part' AS title, {_PY.format('text')} AS text FROM documents, (VALUES (1::BIGINT), (2)) v(k)")
def subchapter_units(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.lit(1).cast("long").alias("chapter_index"), F.concat(F.lit("lost\n1.1 part\n"), F.col("text"), F.lit("\n1.2 part\n"), F.col("text")).alias("text"))
    return books.split_subchapters(docs)


_OUTLINE = "SELECT l_orderkey AS book_id, l_linenumber AS pos, max(l_partkey) % 20 AS page FROM lineitem GROUP BY 1, 2"


@query(f"SELECT book_id, CAST(pos AS BIGINT) AS pos, CAST(page AS BIGINT) AS page FROM (SELECT *, max(page) OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ({_OUTLINE})) WHERE top IS NULL OR page > top")
def outline_running_max(spark, sf_dir):
    return books.increasing(books.outline(table(spark, sf_dir, "lineitem")))


@query(
    f"WITH kept AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS chapter_index, lead(page, 1, 20) OVER (PARTITION BY book_id ORDER BY pos) AS next FROM"
    f" (SELECT *, max(page) OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ({_OUTLINE})) WHERE top IS NULL OR page > top)"
    " SELECT book_id, chapter_index, count(*) AS pages, min(p) AS first_page, max(p) AS last_page FROM kept, range(0, 20) r(p) WHERE p >= page AND p < next GROUP BY 1, 2"
)
def outline_chapters(spark, sf_dir):
    return books.outline_pages(books.increasing(books.outline(table(spark, sf_dir, "lineitem"))), pages=20)


@query(
    "WITH spine AS (SELECT page_id % 25 AS book_id, row_number() OVER (PARTITION BY page_id % 25 ORDER BY page_id) AS pos, page_id, url FROM pages),"
    " hits AS (SELECT *, max(pos) OVER (PARTITION BY book_id ORDER BY page_id % 7, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, page_id % 7 AS rank FROM spine WHERE page_id % 3 <> 1),"
    " kept AS (SELECT * FROM hits WHERE top IS NULL OR pos > top), starts AS (SELECT *, lead(pos, 1, 1 << 30) OVER (PARTITION BY book_id ORDER BY pos) AS next, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS chapter_index FROM kept)"
    " SELECT s.book_id, s.chapter_index, count(*) AS documents, min(d.page_id) AS first_page, max(d.page_id) AS last_page FROM starts s JOIN spine d ON d.book_id = s.book_id AND d.pos >= s.pos AND d.pos < s.next GROUP BY 1, 2"
)
def spine_chapters(spark, sf_dir):
    return books.spine_chapters(table(spark, sf_dir, "pages"))


@query(
    "WITH marked AS (SELECT doc_id // 8 AS book_id, n, n - row_number() OVER (PARTITION BY doc_id // 8 ORDER BY n) AS island FROM (SELECT doc_id, doc_id % 8 + 1 AS n FROM documents WHERE doc_id % 8 NOT IN (2, 5)))"
    " SELECT book_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS label, CAST(sum(b - a + 1) AS BIGINT) AS chapters, string_agg(csv, ',' ORDER BY a) AS indices_csv, min(a) || '-' || max(b) AS span"
    " FROM (SELECT book_id, island, min(n) AS a, max(n) AS b, string_agg(n::VARCHAR, ',' ORDER BY n) AS csv FROM marked GROUP BY 1, 2) GROUP BY 1"
)
def scope_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("book_id"), (F.col("doc_id") % 8 + 1).alias("n")).where("n NOT IN (3, 6)")
    return runs.selection_labels(docs)


_SELECTIONS = ["1", "1,3", "2-4", "1-2,5", "", "3-1", "1,1", "0", "9", "1-2-3", "a", "1,,2", " 2 , 4-5 "]


@query(
    f"WITH items AS (SELECT selection, trim(unnest(string_split(selection, ','))) AS item FROM {sql_values(_SELECTIONS, 'selection')} WHERE trim(selection) <> ''),"
    r" parsed AS (SELECT selection, regexp_matches(item, '^\d+$|^\d+\s*-\s*\d+$') AS ok, TRY_CAST(trim(split_part(item, '-', 1)) AS BIGINT) AS a, coalesce(TRY_CAST(nullif(trim(split_part(item, '-', 2)), '') AS BIGINT), TRY_CAST(trim(item) AS BIGINT)) AS b FROM items),"
    " expanded AS (SELECT selection, unnest(range(a, b + 1)) AS n FROM parsed WHERE ok AND a >= 1 AND b <= 8 AND a <= b),"
    " state AS (SELECT selection, bool_and(ok AND a >= 1 AND b <= 8 AND a <= b) AS ok FROM parsed GROUP BY 1), merged AS (SELECT selection, count(*) AS n, count(DISTINCT n) AS d, string_agg(n::VARCHAR, ',' ORDER BY n) AS csv FROM expanded GROUP BY 1)"
    f" SELECT selection, CASE WHEN trim(selection) = '' THEN '1,2,3,4,5,6,7,8' WHEN s.ok AND n = d THEN csv END AS indices_csv, trim(selection) = '' OR (s.ok AND n = d) IS TRUE AS valid"
    f" FROM {sql_values(_SELECTIONS, 'selection')} LEFT JOIN state s USING (selection) LEFT JOIN merged USING (selection)"
)
def selection_parse(spark, sf_dir):
    return runs.parse_selections(values(spark, _SELECTIONS, "selection"), available=8)


# -- segmentation -----------------------------------------------------------------


def _chunk_sql(target: int) -> str:
    """Marks that end sentences with the ends of their tails, then cut after cut by recursion."""
    abbreviations = ", ".join(f"'{a}'" for a in sorted(ABBREVIATIONS))
    back = "list_filter(b, lambda x: x.mark = '{0}' AND x.place >= e + " + str(int(BACK * target)) + f" AND x.place < e + {target})[-1].stop"
    ahead = "list_filter(b, lambda x: x.mark = '{0}' AND x.place >= e + " + f"{target} AND x.place < most)[1].stop"
    found = "coalesce(" + ", ".join([back.format(m) for m in ".!?"] + [ahead.format(m) for m in ".!?"]) + ")"
    space_ahead = f"length(regexp_extract(substr(text, e + {target} + 1, most - e - {target}), '^[^\\s]*'))"
    space_back = f"length(regexp_extract(substr(text, e + 2, {target} - 1), '[^\\s]*$'))"
    forced = f"CASE WHEN {space_ahead} < most - e - {target} THEN e + {target} + {space_ahead} + 1 WHEN {space_back} < {target} - 1 THEN e + {target} - {space_back} ELSE most END"
    return (
        "WITH RECURSIVE marks AS (SELECT doc_id, i - 1 AS place, substr(text, i, 1) AS mark, substr(text, i - 1, 1) AS l, substr(text, i + 1, 1) AS r, substr(text, greatest(1, i - 8), least(9, i)) AS h, substr(text, i + 1, 200) AS tail"
        " FROM documents, LATERAL (SELECT unnest(range(1, length(text) + 1)) AS i) WHERE substr(text, i, 1) IN ('.', '!', '?')),"
        " ends AS (SELECT doc_id, list({'place': place, 'mark': mark, 'stop': place + 1 + length(regexp_extract(tail, '^[\"'')\\]}»”]*\\s*'))} ORDER BY place) AS b FROM marks"
        f" WHERE mark <> '.' OR NOT (regexp_matches(l, '^\\d$') AND regexp_matches(r, '^\\d$')) AND NOT list_contains([{abbreviations}], lower(regexp_extract(h, '([\\p{{L}}]*)\\.$', 1))) AND NOT regexp_matches(h, '(?:[A-Za-z]\\.){{2,}}$') GROUP BY 1),"
        " given AS (SELECT doc_id, text, length(text) AS n, coalesce(b, []) AS b FROM documents LEFT JOIN ends USING (doc_id)),"
        " cuts AS (SELECT doc_id, -1 AS k, 0::BIGINT AS s, 0::BIGINT AS e, '' AS how FROM given UNION ALL"
        f" SELECT doc_id, k + 1, e, CASE WHEN e + {target} >= n THEN n ELSE coalesce({found}, {forced}) END, CASE WHEN e + {target} >= n THEN 'chapter_end' WHEN {found} IS NULL THEN 'forced_split_no_sentence_boundary' ELSE 'sentence_complete' END"
        f" FROM (SELECT cuts.*, text, n, b, least(n, e + {target} + {max(1, int(FORWARD * target))}) AS most FROM cuts JOIN given USING (doc_id) WHERE e < n))"
        " SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, substr(text, s + 1, e - s) AS text, s AS char_start, e AS char_end, how AS boundary_strategy FROM cuts JOIN given USING (doc_id) WHERE k >= 0"
    )


@query(_chunk_sql(1800))
def chunk_fixed_target(spark, sf_dir):
    return chunk_rows(table(spark, sf_dir, "documents"), ["doc_id"], 1800)


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, true AS whole, true AS contiguous FROM documents WHERE text <> ''")
def chunk_invariants(spark, sf_dir):
    """Chunks joined are the text, and each begins where the one before ends."""
    made = chunk_rows(table(spark, sf_dir, "documents"), ["doc_id"], 400, repaired=True)
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    made = made.withColumn("before", F.lag("char_end", 1, 0).over(w))
    whole = made.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "").alias("joined"), F.every(F.col("before") == F.col("char_start")).alias("contiguous"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return whole.join(docs, "doc_id").select("doc_id", F.length("joined").cast("long").alias("chars"), (F.col("joined") == F.col("t")).alias("whole"), "contiguous")


@query()
def boundary_repair(spark, sf_dir):
    return repair_rows(table(spark, sf_dir, "documents"), ["doc_id"], size=300, target=400)


@query()
def segment_plan(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    unit = F.struct((F.col("turn") + 1).alias("order"), F.expr("turn div 4 + 1").alias("chapter"), F.lit("").alias("title"), F.col("text").alias("text"))
    units = turns.groupBy("conv_id").agg(F.collect_list(unit).alias("units"))
    made = plan_rows(units, ["conv_id"], 1800)
    return made.select("conv_id", "order_index", "chapter_index", "segment_index", "text", F.array_join(F.transform("source_orders", lambda x: x.cast("string")), ",").alias("source_orders"))


@query(
    "WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), fold AS (SELECT doc_id, l, 1 AS i, 1 AS pack, length(l[1]) AS size FROM p WHERE len(l) > 0"
    " UNION ALL SELECT doc_id, l, i + 1, CASE WHEN size + 2 + length(l[i + 1]) <= 900 THEN pack ELSE pack + 1 END, CASE WHEN size + 2 + length(l[i + 1]) <= 900 THEN size + 2 + length(l[i + 1]) ELSE length(l[i + 1]) END FROM fold WHERE i < len(l))"
    " SELECT doc_id, CAST(max(pack) AS BIGINT) AS packs, CAST(count(*) AS BIGINT) AS paragraphs FROM fold GROUP BY 1"
)
def paragraph_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != "")
    return docs.select("doc_id", books.greedy_packs(lines, 900).alias("packs"), F.size(lines).cast("long").alias("paragraphs")).where("paragraphs > 0")


@query(
    "WITH RECURSIVE p AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)) AS l FROM documents),"
    " ends AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) + i AS e FROM (SELECT doc_id, unnest(l) AS n, unnest(range(1, len(l) + 1)) AS i FROM p)),"
    " packed AS (SELECT doc_id, list(e ORDER BY i) AS e FROM ends GROUP BY 1),"
    # a line that begins after a place holds the words whose ends lie within 72 characters of it, one at least
    " fold AS (SELECT doc_id, e, 0::BIGINT AS line, 0::BIGINT AS done FROM packed UNION ALL"
    " SELECT doc_id, e, line + 1, greatest(done + 1, done + len(list_filter(e[done + 1:done + 73], lambda x: x - 1 - CASE WHEN done = 0 THEN 0 ELSE e[done] END <= 72))) FROM fold WHERE done < len(e))"
    " SELECT doc_id, max(line) AS lines FROM fold GROUP BY 1"
)
def word_wrap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return docs.where(F.size(words) > 0).select("doc_id", books.greedy_packs(words, 72, joint=1).alias("lines"))


# -- providers, caches, costs ---------------------------------------------------------

_KEY = "sha256('response:openai:gpt:translate:' || trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"SELECT doc_id, {_KEY} AS cache_key, min(doc_id) OVER (PARTITION BY {_KEY}) AS answered_by FROM documents")
def cache_dedupe(spark, sf_dir):
    return requests.answered(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"SELECT count(*) AS requests, count(DISTINCT {_KEY}) AS misses, count(*) - count(DISTINCT {_KEY}) AS hits, printf('%.4f', (count(*) - count(DISTINCT {_KEY})) / count(*)) AS hit_rate FROM documents")
def cache_telemetry(spark, sf_dir):
    return requests.telemetry(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"SELECT doc_id, '[cs] ' || arg_min(text, doc_id) OVER (PARTITION BY {_KEY}) AS translated, 'mock' AS provider FROM documents")
def translate_mock_join(spark, sf_dir):
    return requests.translate(table(spark, sf_dir, "documents").select("doc_id", "text"), "cs")


@query("SELECT doc_id, text AS rewritten, 'bypass' AS provider, 'deterministic-pass-through-v1' AS model FROM documents")
def rewrite_bypass(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("rewritten"), F.lit("bypass").alias("provider"), F.lit("deterministic-pass-through-v1").alias("model"))


#: Source, translated and rewritten text of a document; some have no result.
_PARTS = "(SELECT *, '[cs] ' || text AS tr, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '[narration] [cs] ' || text END AS rw FROM documents)"


def parts_of(docs: DataFrame) -> DataFrame:
    translated = F.concat(F.lit("[cs] "), F.col("text"))
    return docs.withColumn("translated", translated).withColumn("rewritten", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("[narration] "), translated)))


@query(
    "SELECT source, llm AS llm_usd, tts AS tts_usd, round(llm + tts, 6) AS total_usd FROM (SELECT source, round(a * 0.0015 / 1000 + r * 0.0008 / 1000, 6) AS llm, round(b * 0.0150 / 1000, 6) AS tts"
    " FROM (SELECT source, CAST(sum(greatest(1, length(text) + length(tr))) AS BIGINT) AS a, CAST(sum(greatest(1, length(tr) + coalesce(length(rw), 0))) AS BIGINT) AS r, CAST(sum(greatest(1, coalesce(length(rw), 0))) AS BIGINT) AS b FROM " + _PARTS + " GROUP BY 1))"
)
def cost_summary(spark, sf_dir):
    return requests.costs(parts_of(table(spark, sf_dir, "documents")), "source")


#: Status, message and provider code of failures, then their kind and whether they may pass.
_FAILURES = [
    (401, "no", None, "invalid_api_key", False), (500, "Bad API key", None, "invalid_api_key", False), (403, "forbidden", None, "http_error", False),
    (429, "You exceeded your quota", None, "insufficient_quota", False), (400, "x", "Insufficient_Quota", "insufficient_quota", False), (400, "over quota", None, "http_error", False),
    (429, "slow down", "rate_limit", "http_error", True), (404, "x", "model_not_found", "invalid_model", False), (400, "The model `m` does not exist", None, "invalid_model", False),
    (404, "path not found", None, "http_error", False), (408, "x", None, "timeout", True), (504, None, None, "timeout", True), (400, "request Timed Out", None, "timeout", True),
    (500, "oops", None, "http_error", True), (503, "", "", "http_error", True), (None, "connection reset", None, "transport", True), (None, "read timeout", None, "timeout", True),
]


def _sql_value(x) -> str:
    return "NULL" if x is None else _sql_text(x) if isinstance(x, str) else str(x).lower()


@query("SELECT n, kind, retryable FROM (VALUES " + ", ".join(f"({k}::BIGINT, {_sql_value(kind)}, {_sql_value(again)})" for k, (_s, _m, _c, kind, again) in enumerate(_FAILURES)) + ") v(n, kind, retryable)")
def http_classify(spark, sf_dir):
    rows = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(_FAILURES)], "n long, status int, message string, code string")
    return requests.classify(rows).select("n", "kind", "retryable")


@query("SELECT n, least(4.0, 0.5 * pow(2, n - 1)) AS seconds FROM range(1, 8) t(n)")
def retry_backoff(spark, sf_dir):
    return spark.range(1, 8).select(F.col("id").alias("n"), requests.backoff(F.col("id")).alias("seconds"))


@query("SELECT event_id, round((row_number() OVER w - 1) * 30.0 + max(t - (i - 1) * 30.0) OVER w, 3) AS granted FROM (SELECT *, epoch(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def rate_limit_replay(spark, sf_dir):
    return requests.grants(table(spark, sf_dir, "events"), key="event_type", seconds=30.0)


# -- documents, parts, runs ----------------------------------------------------------


@query("SELECT conv_id, c AS chapter_index, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body, count(*) AS parts FROM (SELECT *, turn // 4 + 1 AS c FROM conversations) GROUP BY 1, 2")
def translated_document(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("chapter_index", F.expr("turn div 4 + 1"))
    parts = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id", "chapter_index").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("body"), F.count("*").alias("parts"))


@query("SELECT conv_id, count(*) AS part_count, string_agg((turn // 4 + 1) || ':' || (turn % 4 + 1), ',' ORDER BY turn) AS mapping, string_agg(printf('%03d_%02d.wav', turn // 4 + 1, turn % 4 + 1), ',' ORDER BY turn) AS files FROM conversations GROUP BY 1")
def part_mapping_metadata(spark, sf_dir):
    return runs.part_mapping(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 5 = 0")
def tts_prereq_anti(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return turns.join(turns.where("(conv_id + turn) % 5 <> 0"), ["conv_id", "turn"], "left_anti")


@query(
    "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE (conv_id + turn) % 5 <> 0)"
    " SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, count(*) AS positions, count(*) FILTER (WHERE a.turn IS DISTINCT FROM b.turn) AS differing FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.i = b.i GROUP BY 1"
)
def stage_alignment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return runs.alignment(turns, turns.where("(conv_id + turn) % 5 <> 0"))


_STAGES = ["raw", "clean", "chapters", "chunks", "translations", "rewrites", "parts", "merged", "manifest"]


@query(
    f"SELECT o_orderkey AS run_id, coalesce(({_STAGES})[m + 1], 'done') AS next_stage, coalesce((o_orderkey >> (m + 1)) % (1 << greatest(0, 8 - m)) > 0, false) AS stale"
    " FROM (SELECT o_orderkey, list_min(list_filter(range(0, 9), lambda k: (o_orderkey >> k) % 2 = 0)) AS m FROM (SELECT DISTINCT o_orderkey FROM orders))"
)
def resume_topology(spark, sf_dir):
    return runs.resume(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")).distinct(), _STAGES)


#: Requests for audio formats, with their canonical names; None: not valid.
_FORMATS = {"wav": "wav", "none": "wav", "m4a": "m4a", "AAC": "m4a", " mp3 ": "mp3", "both": "both", "all": "both", "mp3,m4a": "both", "aac, MP3": "both", "wav,mp3": "mp3", "wav,m4a,aac": "m4a", "wav,": "wav", "flac": None, "m4a,ogg": None, "both,mp3": None, "none,m4a": None, " ": None, ",": None}


@query("SELECT request, name, CASE name WHEN 'both' THEN 'm4a,mp3' WHEN 'wav' THEN '' ELSE name END AS formats FROM (VALUES " + ", ".join(f"({_sql_value(a)}, {_sql_value(b)})" for a, b in _FORMATS.items()) + ") v(request, name)")
def output_format_resolve(spark, sf_dir):
    return runs.resolve_formats(values(spark, list(_FORMATS), "request"))


@query("SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN ' cli ' END), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'env' END), ''), 'default') AS value FROM documents")
def runtime_precedence(spark, sf_dir):
    cli, env = F.when(F.col("doc_id") % 4 == 0, " cli "), F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "env")
    return table(spark, sf_dir, "documents").select("doc_id", runs.first_set(cli, env, F.lit("default")).alias("value"))


@query("SELECT conv_id, chapter_index AS chapter_number, printf('chapter_%03d_chapter-%d.m4a', chapter_index, chapter_index) AS file, printf('%d/%d', chapter_index, count(*) OVER (PARTITION BY conv_id)) AS track, parts FROM (SELECT conv_id, turn // 4 + 1 AS chapter_index, count(*) AS parts FROM conversations GROUP BY 1, 2)")
def package_plan(spark, sf_dir):
    return runs.package_plan(table(spark, sf_dir, "conversations"))


@query("SELECT book_id, substr(sha256('epub|books/' || book_id || '.epub|cs|chapter_scope_indices_csv=' || csv || ',chapter_scope_mode=all|' || titles), 1, 24) AS identifier FROM (SELECT doc_id // 8 AS book_id, string_agg(n::VARCHAR, ',' ORDER BY n) AS csv, string_agg(n || ':' || lang, '|' ORDER BY doc_id) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS n FROM documents) GROUP BY 1)")
def epub_identifier(spark, sf_dir):
    return books.identifiers(table(spark, sf_dir, "documents"))


# -- samples ------------------------------------------------------------------------

_PCM = "SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(x::DOUBLE * 32767) AS BIGINT)) AS s FROM embeddings"


@query(f"SELECT vec_id, list_max(list_transform(s, lambda x: abs(x))) AS peak FROM ({_PCM})")
def pcm_peak(spark, sf_dir):
    return media.samples_of(table(spark, sf_dir, "embeddings")).select("vec_id", media.peak(F.col("samples")).alias("peak"))


@query(
    f"SELECT vec_id, array_to_string(CASE WHEN a IS NULL THEN [] ELSE s[a:b] END, ',') AS samples FROM (SELECT vec_id, s, list_min(list_filter(range(1, len(s) + 1), lambda i: abs(s[i]) > 3000)) AS a, list_max(list_filter(range(1, len(s) + 1), lambda i: abs(s[i]) > 3000)) AS b FROM ({_PCM}))"
)
def pcm_trim(spark, sf_dir):
    trimmed = media.trim_silence(F.col("samples"), 3000)
    return media.samples_of(table(spark, sf_dir, "embeddings")).select("vec_id", F.array_join(F.transform(trimmed, lambda x: x.cast("string")), ",").alias("samples"))


@query(
    f"SELECT vec_id, array_to_string(list_transform(s, lambda x: CAST(greatest(-32768, least(32767, CASE WHEN m = 0 OR abs(m - 31129) <= 1 THEN x ELSE round_even(x * (31129.0::DOUBLE / m), 0) END)) AS BIGINT)), ',') AS samples FROM (SELECT *, list_max(list_transform(s, lambda x: abs(x))) AS m FROM ({_PCM}))"
)
def pcm_normalize(spark, sf_dir):
    scaled = media.normalize(F.col("samples"))
    return media.samples_of(table(spark, sf_dir, "embeddings")).select("vec_id", F.array_join(F.transform(scaled, lambda x: x.cast("string")), ",").alias("samples"))


# -- flagship -------------------------------------------------------------------------


@query(
    "WITH RECURSIVE c AS (SELECT doc_id // 8 AS book_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS i, text FROM documents)"
    " SELECT book_id, count(*) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(greatest(1, 2 * length(text))) * 0.0015 / 1000, 6) AS translate_usd FROM (SELECT book_id, i, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM c) GROUP BY 1"
)
def book_costs(spark, sf_dir):
    """Per book: chapters, characters and the estimated cost of translating it."""
    chapters = books.split_chapters(books.from_documents(table(spark, sf_dir, "documents")))
    size = F.length("text")
    return chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum(size).cast("long").alias("chars"), F.round(F.sum(F.greatest(F.lit(1), size * 2)) * 0.0015 / 1000, 6).alias("translate_usd"))
