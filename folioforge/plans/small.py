"""Small queries of the catalogue: scopes, names, options, statuses and texts around the main operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import options as O
from folioforge.functions import text as T
from folioforge.operators import books, requests, runs
from folioforge.plans.catalog import _OUTLINE, _PARTS, _sql_value, parts_of, query, sql_values, table, values

# -- sources and structure -----------------------------------------------------------

_PATHS = ["a/b.pdf", "B.EPUB", "c.txt", "noext", "x.tar.pdf", ".pdf"]


@query(f"SELECT path, CASE WHEN regexp_matches(lower(path), '[^/]\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(path), '[^/]\\.epub$') THEN 'epub' END AS format FROM {sql_values(_PATHS, 'path')}")
def source_format_detect(spark, sf_dir):
    return values(spark, _PATHS, "path").select("path", O.source_format(F.col("path")).alias("format"))


@query("SELECT page_id, t AS media_type FROM (SELECT page_id, (['application/xhtml+xml', ' TEXT/HTML ', 'text/css', 'text/xml', 'application/xml'])[page_id % 5 + 1] AS t FROM pages) WHERE lower(trim(t)) IN ('application/xhtml+xml', 'text/html', 'application/xml')")
def media_type_filter(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["application/xhtml+xml", " TEXT/HTML ", "text/css", "text/xml", "application/xml"]))
    typed = table(spark, sf_dir, "pages").select("page_id", F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int")).alias("media_type"))
    return typed.where(O.is_text_type(F.col("media_type")))


@query("SELECT book_id, CASE WHEN nav > 0 THEN 'nav' WHEN ncx > 0 THEN 'ncx' ELSE 'none' END AS chosen, nav + ncx AS candidates FROM (SELECT page_id % 25 AS book_id, count(*) FILTER (WHERE page_id % 7 = 0) AS nav, count(*) FILTER (WHERE page_id % 3 = 0) AS ncx FROM pages GROUP BY 1)")
def nav_choice_status(spark, sf_dir):
    counted = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 25).alias("book_id")).agg(F.count_if(F.col("page_id") % 7 == 0).alias("nav"), F.count_if(F.col("page_id") % 3 == 0).alias("ncx"))
    return counted.select("book_id", F.when(F.col("nav") > 0, "nav").when(F.col("ncx") > 0, "ncx").otherwise("none").alias("chosen"), (F.col("nav") + F.col("ncx")).alias("candidates"))


#: Format, chapters of outline and navigation, their statuses and units of books, then source, reason and structure.
_BOOKS = [
    ("pdf", 3, None, "pdf_outline", None, 5, "pdf_outline", "", "pdf_outline"), ("pdf", 3, None, "pdf_outline", None, 0, "pdf_outline", "", "text_heuristic"), ("pdf", 3, None, "pdf_outline", None, None, "pdf_outline", "", "text_heuristic"),
    ("pdf", 0, 4, "outline_missing", "epub_nav", 0, "text_heuristic", "outline_missing", "text_heuristic"), ("pdf", None, None, None, None, None, "text_heuristic", "outline_invalid", "text_heuristic"),
    ("epub", None, 2, None, "epub_nav", None, "epub_nav", "", "epub_nav"), ("epub", 9, 0, "pdf_outline", "nav_missing", 9, "text_heuristic", "nav_missing", "text_heuristic"), ("epub", None, None, None, None, None, "text_heuristic", "nav_invalid", "text_heuristic"),
    ("txt", 1, 1, "pdf_outline", "epub_nav", 1, "text_heuristic", "outline_unsupported_for_format", "text_heuristic"),
]


@query("SELECT n, source, reason, structure FROM (VALUES " + ", ".join(f"({k}::BIGINT, {', '.join(map(_sql_value, x[6:]))})" for k, x in enumerate(_BOOKS)) + ") v(n, source, reason, structure)")
def structure_fallback(spark, sf_dir):
    """The first of outline, navigation and headings that gives a book chapters, why the ones before were passed over, and the structure's source."""
    rows = spark.createDataFrame([(k, *x[:6]) for k, x in enumerate(_BOOKS)], "n long, format string, outline int, nav int, outline_status string, nav_status string, units int")
    return books.choose_split(rows).select("n", "source", "reason", "structure")


#: Stored index lists, with the chapters of eight that they name; None: not valid.
_STORED = {"1": "1", " 3 ,1": "1,3", "": "1,2,3,4,5,6,7,8", "2-3": None, "1,,2": None, "1,1": None, "0": None, "9": None, "x": None, "8,7": "7,8"}


@query("SELECT csv, indices_csv, indices_csv IS NOT NULL AS valid FROM (VALUES " + ", ".join(f"({_sql_value(a)}, {_sql_value(b)})" for a, b in _STORED.items()) + ") v(csv, indices_csv)")
def stored_indices(spark, sf_dir):
    """Chapters of index lists as manifests hold them."""
    return runs.parse_indices(values(spark, list(_STORED), "csv"), available=8)


@query(
    "WITH p AS (SELECT conv_id, turn // 4 + 2 AS c, turn % 4 AS k, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS t, printf('%03d_%02d.wav', turn // 4 + 2, turn % 4 + 1) AS f, turn // 2 AS a, turn + 1 AS b FROM conversations WHERE turn // 4 <> 1),"
    " named AS (SELECT conv_id, c, dense_rank() OVER (PARTITION BY conv_id ORDER BY c) AS number, coalesce(nullif(arg_min(t, k), ''), printf('chapter-%03d', c)) AS title, string_agg(f, ',' ORDER BY k) AS files FROM p GROUP BY conv_id, c),"
    " refs AS (SELECT conv_id, c, string_agg(o::VARCHAR, ',' ORDER BY o) AS orders FROM (SELECT DISTINCT conv_id, c, unnest([a, b]) AS o FROM p) GROUP BY 1, 2)"
    " SELECT conv_id, c AS chapter_index, number, title, number || '/' || count(*) OVER (PARTITION BY conv_id) AS track, files, orders FROM named JOIN refs USING (conv_id, c)"
)
def chapter_parts(spark, sf_dir):
    """Chapters of a run in order, with the parts and source units that they hold; numbers run over the chapters that are there."""
    turns = table(spark, sf_dir, "conversations").where("turn div 4 <> 1").dropDuplicates(["conv_id", "turn"])
    c = F.expr("turn div 4 + 2")
    parts = turns.select(
        "conv_id", c.alias("chapter_index"), (F.col("turn") % 4).alias("chunk_index"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("part_title"),
        F.format_string("%03d_%02d.wav", c, F.col("turn") % 4 + 1).alias("file"), F.array(F.expr("turn div 2"), F.col("turn") + 1).alias("orders"),
    )
    return runs.chapter_parts(parts, "conv_id", numbering="sequential")


@query(
    f"WITH parents AS (SELECT * FROM (SELECT *, max(page) OVER (PARTITION BY book_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ({_OUTLINE})) WHERE top IS NULL OR page > top),"
    " children AS (SELECT book_id, pos, page, k, page + (k * 7 + book_id) % 5 - 1 AS child FROM parents, range(0, 4) t(k)),"
    " kept AS (SELECT *, max(child) OVER (PARTITION BY book_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM children WHERE child >= page)"
    " SELECT book_id, CAST(pos AS BIGINT) AS pos, count(*) AS subchapters, string_agg(child::BIGINT::VARCHAR, ',' ORDER BY k) AS pages FROM kept WHERE top IS NULL OR child > top GROUP BY 1, 2"
)
def outline_structure(spark, sf_dir):
    """Subchapters of each chapter of an outline: increasing pages, none before the chapter's own."""
    parents = books.increasing(books.outline(table(spark, sf_dir, "lineitem")))
    children = parents.select("book_id", "pos", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    children = children.withColumn("child", F.col("page") + (F.col("k") * 7 + F.col("book_id")) % 5 - 1).where("child >= page")
    before = Window.partitionBy("book_id", "pos").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    kept = children.withColumn("top", F.max("child").over(before)).where("top IS NULL OR child > top")
    pages = F.transform(F.sort_array(F.collect_list(F.struct("k", "child"))), lambda x: x["child"].cast("string"))
    return kept.groupBy("book_id", "pos").agg(F.count("*").alias("subchapters"), F.array_join(pages, ",").alias("pages"))


@query("SELECT doc_id, doc_id // 8 AS book_id, doc_id % 8 + 1 AS chapter_index FROM documents WHERE (doc_id // 8 + doc_id % 8) % 3 = 0")
def unit_scope_semi(spark, sf_dir):
    """Units of the chapters that are selected."""
    units = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 8").alias("book_id"), (F.col("doc_id") % 8 + 1).alias("chapter_index"))
    selected = units.where("(book_id + chapter_index - 1) % 3 = 0").select("book_id", "chapter_index")
    return units.join(selected, ["book_id", "chapter_index"], "left_semi").select("doc_id", "book_id", "chapter_index")


@query("SELECT conv_id, turn, CASE WHEN (turn // 4 + 1) % 2 = 1 THEN 'Part ' || (turn // 4 + 1) ELSE 'Chapter ' || (turn // 4 + 1) END AS title FROM conversations")
def chunk_title_default(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("turn div 4 + 1").alias("c"))
    titles = chunks.where("c % 2 = 1").select("conv_id", "c").distinct().withColumn("t", F.concat(F.lit("Part "), F.col("c").cast("string")))
    return chunks.join(titles, ["conv_id", "c"], "left").select("conv_id", "turn", F.coalesce("t", F.concat(F.lit("Chapter "), F.col("c").cast("string"))).alias("title"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS order_index, turn // 4 + 1 AS chapter_index, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1 AS chunk_index FROM conversations")
def chunk_numbering(spark, sf_dir):
    c = F.expr("turn div 4 + 1")
    book, chapter = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id", c).orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(book).cast("long").alias("order_index"), c.alias("chapter_index"), (F.row_number().over(chapter) - 1).cast("long").alias("chunk_index"))


# -- sentences -------------------------------------------------------------------------


@query(
    r"SELECT doc_id, count(*) FILTER (WHERE c IN ('!', '?') OR (c = '.' AND NOT (regexp_matches(b, '^\d$') AND regexp_matches(a, '^\d$')) AND NOT list_contains(['dr','mr','mrs','ms','prof','sr','jr','st','vs','etc','fig','no','al'], lower(regexp_extract(h, '([\p{L}]*)\.$', 1))) AND NOT regexp_matches(h, '(?:[A-Za-z]\.){2,}$'))) AS boundaries"
    r" FROM (SELECT doc_id, substr(text, i, 1) AS c, substr(text, i - 1, 1) AS b, substr(text, i + 1, 1) AS a, CASE WHEN i > 9 THEN substr(text, i - 8, 9) ELSE substr(text, 1, i) END AS h FROM documents, LATERAL (SELECT unnest(range(1, length(text) + 1)) AS i) WHERE substr(text, i, 1) IN ('.', '!', '?')) GROUP BY 1"
)
def sentence_candidates(spark, sf_dir):
    """How many marks of each text end a sentence."""
    import pyarrow as pa

    from folioforge.operators.sentences import apply_per_row, is_boundary

    def rows(text):
        marks = [k for k, c in enumerate(text or "") if c in ".!?"]
        return [(sum(is_boundary(text, k) for k in marks),)] if marks else []

    return apply_per_row(table(spark, sf_dir, "documents"), ["doc_id"], ["text"], [("boundaries", "long", pa.int64())], rows)


# -- costs, requests ---------------------------------------------------------------------


@query(f"SELECT doc_id, greatest(1, length(text) + length(tr)) * 0.0015::DOUBLE / 1000 AS usd FROM {_PARTS}")
def cost_translate(spark, sf_dir):
    return parts_of(table(spark, sf_dir, "documents")).select("doc_id", requests.usage(requests.billed(F.col("text"), F.col("translated")) * requests.TRANSLATE / 1000).alias("usd"))


@query(f"SELECT doc_id, greatest(1, length(tr) + coalesce(length(rw), 0)) * 0.0008::DOUBLE / 1000 AS usd FROM {_PARTS}")
def cost_rewrite(spark, sf_dir):
    return parts_of(table(spark, sf_dir, "documents")).select("doc_id", requests.usage(requests.billed(F.col("translated"), F.col("rewritten")) * requests.REWRITE / 1000).alias("usd"))


@query(f"SELECT doc_id, greatest(1, coalesce(length(rw), 0)) * 0.0150::DOUBLE / 1000 AS usd FROM {_PARTS}")
def cost_tts(spark, sf_dir):
    return parts_of(table(spark, sf_dir, "documents")).select("doc_id", requests.usage(requests.billed(F.col("rewritten")) * requests.SPEECH / 1000).alias("usd"))


@query("SELECT event_type, CAST(sum(greatest(0, CAST(trunc(value) AS BIGINT) % 4 - 1)) AS BIGINT) AS retries FROM events GROUP BY 1")
def retry_totals(spark, sf_dir):
    """Retries of each client; negative numbers count as none."""
    again = F.greatest(F.lit(0), F.col("value").cast("long") % 4 - 1)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(again).cast("long").alias("retries"))


_RESPONSES = [
    '{"choices":[{"message":{"content":" hello "}}]}',
    '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}}]}',
    '{"choices":[{"message":{"content":"  "}}]}',
    '{"choices":[]}',
    "{}",
    "not json",
    '{"choices":[{"message":{"content":"[cs] Ahoj"}}]}',
    '{"choices":[{"message":{"content":[]}}]}',
    '{"choices":[{"message":{"content":[{"type":"tool","text":"no"},{"type":"text","text":5},{"type":"text","text":" yes "},7]}}]}',
    '{"choices":[{"message":{"content":12}}]}',
    '{"choices":[{"message":{"content":null}}]}',
]
#: What each of them holds.
_CONTENTS = ["hello", "ab", None, None, None, None, "[cs] Ahoj", None, "yes", None, None]


@query("SELECT response, content FROM (VALUES " + ", ".join(f"({_sql_value(a)}, {_sql_value(b)})" for a, b in zip(_RESPONSES, _CONTENTS, strict=True)) + ") v(response, content)")
def chat_response_extract(spark, sf_dir):
    return values(spark, _RESPONSES, "response").select("response", O.chat_content(F.col("response")).alias("content"))


@query("SELECT doc_id, 'Translate the following text into cs. Keep the meaning and the paragraphs.' || chr(10) || chr(10) || text AS prompt FROM documents")
def prompt_render(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", O.translate_prompt(F.col("text"), "cs").alias("prompt"))


@query("SELECT n / 2.0 - 1 AS asked, least(4.0, greatest(0.25, n / 2.0 - 1)) AS speed FROM range(0, 14) t(n)")
def speed_clamp(spark, sf_dir):
    asked = F.col("id") / 2.0 - 1
    return spark.range(14).select(asked.alias("asked"), F.least(F.lit(4.0), F.greatest(F.lit(0.25), asked)).alias("speed"))


_STAGE_NAMES, _ERRORS = ["translate", "rewrite", "tts", "merge"], ["invalid_api_key", "insufficient_quota", "invalid_model", "timeout", "transport", "http_error", "strange"]


def _hint_sql() -> str:
    """The cases written out: kinds that have a hint of their own by stage or for all stages, and the stages' own for the others."""
    by_kind = lambda kind: "CASE stage " + " ".join(f"WHEN {_sql_value(s)} THEN {_sql_value(t)}" for (k, s), t in O.HINTS.items() if k == kind and s) + f" ELSE {_sql_value(O.HINTS[kind, None])} END"
    plain = lambda kind: _sql_value(O.HINTS[kind, None])
    return (
        f"SELECT stage, kind, CASE kind WHEN 'invalid_api_key' THEN {plain('invalid_api_key')} WHEN 'timeout' THEN {plain('timeout')} WHEN 'transport' THEN {plain('transport')}"
        f" WHEN 'insufficient_quota' THEN {by_kind('insufficient_quota')} WHEN 'invalid_model' THEN {by_kind('invalid_model')} ELSE {by_kind(None)} END AS hint"
        f" FROM (SELECT unnest({_STAGE_NAMES}) AS stage), (SELECT unnest({_ERRORS}) AS kind)"
    )


@query(_hint_sql())
def error_hint_lookup(spark, sf_dir):
    """What to do about a failure, by kind and stage."""
    rows = spark.createDataFrame([(s, k) for s in _STAGE_NAMES for k in _ERRORS], "stage string, kind string")
    return rows.select("stage", "kind", O.hint(F.col("stage"), F.col("kind")).alias("hint"))


@query("SELECT doc_id, '[narration] [cs] ' || text AS rewritten, 'mock' AS provider FROM documents")
def rewrite_mock(spark, sf_dir):
    from folioforge.operators.providers import call_provider

    translated = call_provider(table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text", F.concat(F.lit("[cs] "), F.col("text"))), "mock", "narration")
    # copies share a call, and so the same answer
    return translated.select("doc_id", F.col("answer").alias("rewritten"), F.lit("mock").alias("provider"))


# -- runs and packages -----------------------------------------------------------------


@query("SELECT conv_id, count(*) FILTER (WHERE turn % 4 = 0) AS chapters, count(*) FILTER (WHERE turn % 4 <> 0) AS merged, string_agg('c' || turn || '.m4a', ',' ORDER BY turn) FILTER (WHERE turn % 4 = 0) AS files FROM conversations GROUP BY 1")
def package_counts(spark, sf_dir):
    kind = F.col("turn") % 4 == 0
    files = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind, F.col("turn")))), lambda x: F.concat(F.lit("c"), x.cast("string"), F.lit(".m4a"))), ",")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(kind).alias("chapters"), F.count_if(~kind).alias("merged"), F.nullif(files, F.lit("")).alias("files"))


@query("SELECT o_custkey, bool_and(o_orderkey % 9 <> 0) AS all_exist, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS missing FROM orders GROUP BY 1")
def artifacts_exist(spark, sf_dir):
    exists = F.col("o_orderkey") % 9 != 0
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.every(exists).alias("all_exist"), F.count_if(~exists).alias("missing"))


_TEN = ["extract", "clean", "split", "chunk", "translate", "rewrite", "tts", "merge", "package", "manifest"]


@query(f"SELECT stage, coalesce(list_position({_TEN}, stage), 0)::VARCHAR || '/10' AS place FROM {sql_values([*_TEN, 'other'], 'stage')}")
def stage_position(spark, sf_dir):
    place = F.array_position(F.array(*map(F.lit, _TEN)), F.col("stage"))
    return values(spark, [*_TEN, "other"], "stage").select("stage", F.concat(place.cast("string"), F.lit("/10")).alias("place"))


@query(
    "SELECT doc_id, CASE WHEN csv IS NOT NULL THEN csv WHEN sel IS NOT NULL AND sel <> 'all' THEN sel ELSE '1,2,3,4,5,6,7,8' END AS scope FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2,3' END AS csv, CASE doc_id % 4 WHEN 0 THEN 'all' WHEN 1 THEN '4' END AS sel FROM documents)"
)
def resume_scope(spark, sf_dir):
    csv, sel = F.when(F.col("doc_id") % 3 == 0, "2,3"), F.when(F.col("doc_id") % 4 == 0, "all").when(F.col("doc_id") % 4 == 1, "4")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(csv, F.when(sel != "all", sel), F.lit("1,2,3,4,5,6,7,8")).alias("scope"))


#: Mode, indices and label of chapter scopes, then their token and merged path.
_SCOPES = [
    ("all", "1,2", "all", "all", "audio/merged.wav"), (" ALL ", "1,2", "1-2", "all", "audio/merged.chapters_1_2.wav"), ("selected", "1,3,5", "1,3,5", "chapters-1-3-5", "audio/merged.chapters_1_3_5.wav"),
    ("selected", "", "1-3,5", "selected", "audio/merged.chapters_1-3_5.wav"), ("selected", " , ", "x", "selected", "audio/merged.chapters_ _ .wav"), ("selected", None, None, "selected", "audio/merged.chapters_selected.wav"),
]


@query("SELECT n, token, merged FROM (VALUES " + ", ".join(f"({k}::BIGINT, {_sql_value(x[3])}, {_sql_value(x[4])})" for k, x in enumerate(_SCOPES)) + ") v(n, token, merged)")
def scope_paths(spark, sf_dir):
    """Scope token and the path of the merged file."""
    rows = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(_SCOPES)], "n long, mode string, indices string, label string")
    return rows.select("n", T.scope_token(F.col("mode"), F.col("indices")).alias("token"), T.merged_path(F.col("mode"), F.col("indices"), F.col("label")).alias("merged"))


@query(
    "SELECT event_id, string_agg(k || '=' || v, ' ' ORDER BY k) AS context FROM (SELECT event_id, 'user' AS k, user_id::VARCHAR AS v FROM events UNION ALL SELECT event_id, 'kind', 'é_' || event_type || ':a/b__c.d' FROM events UNION ALL SELECT event_id, 'attempt', CASE WHEN event_id % 3 = 0 THEN 'none' ELSE (event_id % 3)::VARCHAR END FROM events) GROUP BY 1"
)
def sorted_context(spark, sf_dir):
    attempt = F.when(F.col("event_id") % 3 == 0, "  ").otherwise((F.col("event_id") % 3).cast("string"))
    pairs = {"user": F.col("user_id").cast("string"), "kind": F.concat(F.lit(" é "), F.col("event_type"), F.lit(":a/b ,c.d ")), "attempt": attempt}
    entries = F.array_sort(F.array(*[F.concat(F.lit(f"{k}="), T.log_token(v)) for k, v in pairs.items()]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(entries, " ").alias("context"))


_NUMBERS = ["12", " 7 ", "x", "", "-3"]


@query(f"SELECT raw, coalesce(TRY_CAST(trim(raw) AS BIGINT), 0) AS number, coalesce(nullif(trim(raw), ''), 'unset') AS word FROM {sql_values(_NUMBERS, 'raw')}")
def manifest_defaults(spark, sf_dir):
    return values(spark, _NUMBERS, "raw").select("raw", F.coalesce(F.btrim("raw").try_cast("long"), F.lit(0).cast("long")).alias("number"), F.coalesce(runs.first_set(F.col("raw")), F.lit("unset")).alias("word"))


_BITRATES = ["128k", "96k", "5k", "1000k", "fast", ""]
_PROFILES = ["balanced", "voice", "music", "loud", "balanced", ""]


@query(
    "SELECT bitrate, profile, CASE WHEN bitrate <> '' THEN CASE WHEN regexp_matches(bitrate, '^\\d{2,3}k$') THEN bitrate END ELSE CASE profile WHEN 'voice' THEN '96k' WHEN 'music' THEN '160k' WHEN '' THEN '128k' WHEN 'balanced' THEN '128k' END END AS used"
    f" FROM (SELECT unnest({_BITRATES}) AS bitrate, unnest({_PROFILES}) AS profile)"
)
def packaging_options(spark, sf_dir):
    rows = spark.createDataFrame(list(zip(_BITRATES, _PROFILES, strict=True)), "bitrate string, profile string")
    return rows.select("bitrate", "profile", O.bitrate(F.col("bitrate"), F.col("profile")).alias("used"))


@query("SELECT conv_id, chapter_index, 'Chapter ' || chapter_index || '/' || n AS title, 'source=' || conv_id || ';chapter=' || chapter_index || ';scope=1-' || n AS comment FROM (SELECT conv_id, turn // 4 + 1 AS chapter_index, max(turn // 4 + 1) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)) GROUP BY ALL")
def wav_tag_context(spark, sf_dir):
    chapters = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 4 + 1").alias("chapter_index")).distinct()
    n = F.max("chapter_index").over(Window.partitionBy("conv_id")).cast("string")
    c = F.col("chapter_index").cast("string")
    return chapters.select("conv_id", "chapter_index", F.concat(F.lit("Chapter "), c, F.lit("/"), n).alias("title"), F.concat(F.lit("source="), F.col("conv_id").cast("string"), F.lit(";chapter="), c, F.lit(";scope=1-"), n).alias("comment"))


#: Requests for reader formats, what is wrong with them, their formats, and the status if EPUB alone was emitted.
_EXPORTS = [
    ("none", "", "none", "planned_only"), ("epub", "", "epub", "emitted"), ("pdf,epub", "", "epub,pdf", "partial"), ("pdf", "", "pdf", "partial"), ("epub,html,a", "a,html", None, "invalid"), ("", "", "none", "planned_only"),
    (" EPUB , PDF,", "", "epub,pdf", "partial"), ("none,epub", "none", None, "invalid"), (" , ", "empty", None, "invalid"), (None, "", "none", "planned_only"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({', '.join(map(_sql_value, x))})" for x in _EXPORTS) + ") v(request, bad, formats, status)")
def reader_export_status(spark, sf_dir):
    """Formats asked for against those emitted, here EPUB alone."""
    return O.export_status(spark.createDataFrame([(x[0],) for x in _EXPORTS], "request string"), emitted=["epub"])


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'cli' END, CASE WHEN doc_id % 4 = 0 THEN 'env' END, CASE WHEN doc_id % 3 = 0 THEN 'file' END, 'default') AS value, CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 3 ELSE 4 END::BIGINT AS source FROM documents")
def field_precedence(spark, sf_dir):
    choices = [F.when(F.col("doc_id") % k == 0, v) for k, v in ((5, "cli"), (4, "env"), (3, "file"))] + [F.lit("default")]
    first = F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in enumerate(choices, 1)])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(*choices).alias("value"), first.cast("long").alias("source"))


@query("SELECT o_orderkey, sha256('chunk_size=' || (o_orderkey % 7 * 100) || '|language=' || o_orderstatus || '|voice=' || o_orderpriority) AS config_hash, 'run-' || substr(sha256('chunk_size=' || (o_orderkey % 7 * 100) || '|language=' || o_orderstatus || '|voice=' || o_orderpriority), 1, 12) AS run_id FROM orders")
def config_hash(spark, sf_dir):
    """Digest of sorted settings; the canonical JSON form is `functions.config.digest`."""
    orders = table(spark, sf_dir, "orders")
    settings = F.concat(F.lit("chunk_size="), (F.col("o_orderkey") % 7 * 100).cast("string"), F.lit("|language="), F.col("o_orderstatus"), F.lit("|voice="), F.col("o_orderpriority"))
    return orders.select("o_orderkey", F.sha2(settings, 256).alias("config_hash")).withColumn("run_id", F.concat(F.lit("run-"), F.substring("config_hash", 1, 12)))


@query("SELECT event_id, CAST(CAST(trunc(value) AS BIGINT) * 100 + 2400 AS DOUBLE) / (CASE WHEN event_id % 2 = 0 THEN 24000 ELSE 16000 END) AS duration_seconds FROM events")
def wav_duration(spark, sf_dir):
    """Frames over rate; header parsing is `sources.wav.duration`."""
    frames, rate = F.col("value").cast("long") * 100 + 2400, F.when(F.col("event_id") % 2 == 0, 24000).otherwise(16000)
    return table(spark, sf_dir, "events").select("event_id", (frames.cast("double") / rate).alias("duration_seconds"))


@query(
    "WITH RECURSIVE l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, 20 + length(text) % 90 AS h FROM conversations),"
    " f AS (SELECT conv_id, turn, i, h AS used, 1 AS page FROM l WHERE i = 1 UNION ALL SELECT l.conv_id, l.turn, l.i, CASE WHEN used + h > 300 THEN h ELSE used + h END, CASE WHEN used + h > 300 THEN page + 1 ELSE page END FROM f JOIN l ON l.conv_id = f.conv_id AND l.i = f.i + 1)"
    " SELECT conv_id, turn, CAST(page AS BIGINT) AS page, CAST(used AS BIGINT) AS used FROM f"
)
def page_layout(spark, sf_dir):
    """Blocks set one under the other on pages of a height; a block that doesn't fit begins the next."""
    return books.lay_out(table(spark, sf_dir, "conversations"), height=300)


@query("SELECT doc_id, string_agg(upper(substr(w, 1, 1)) || lower(substr(w, 2)), ' ' ORDER BY i) AS title FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(lang || '_' || source || '_book', '_'), lambda x: x <> '') AS w FROM (SELECT doc_id, lang, replace(source, '-', '_') AS source FROM documents))) GROUP BY 1")
def title_from_stem(spark, sf_dir):
    """A title from a file's stem: separators are spaces, words begin with capitals."""
    stem = F.concat(F.col("lang"), F.lit("_"), F.col("source"), F.lit("-book"))
    return table(spark, sf_dir, "documents").select("doc_id", O.stem_title(stem).alias("title"))
