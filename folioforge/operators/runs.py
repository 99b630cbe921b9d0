"""Runs: chapter selections, stage artefacts, resuming, parts and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import log_token

FORMATS = ("m4a", "mp3")
#: The stages of a run, in order.
STAGES = ["extract", "clean", "split", "chunk", "translate", "rewrite", "tts", "merge", "package", "manifest"]


def first_set(*choices: Column) -> Column:
    """The first that isn't null or blank, without space around."""
    return F.coalesce(*[F.nullif(F.btrim(c), F.lit("")) for c in choices])


def selection_labels(chapters: DataFrame) -> DataFrame:
    """Label such as `1-3,5`, count, list and span of each book's chapters `n`: gaps and islands."""
    w = Window.partitionBy("book_id").orderBy("n")
    islands = chapters.withColumn("island", F.col("n") - F.row_number().over(w)).groupBy("book_id", "island").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    parts = F.sort_array(F.collect_list(F.struct("a", "b")))
    name = lambda x: F.when(x["a"] == x["b"], x["a"].cast("string")).otherwise(F.concat_ws("-", x["a"], x["b"]))
    grouped = islands.groupBy("book_id").agg(parts.alias("p"))
    every = F.flatten(F.transform("p", lambda x: F.sequence(x["a"], x["b"])))
    return grouped.select(
        "book_id",
        F.array_join(F.transform("p", name), ",").alias("label"),
        F.size(every).cast("long").alias("chapters"),
        F.array_join(F.transform(every, lambda x: x.cast("string")), ",").alias("indices_csv"),
        F.concat_ws("-", F.array_min(every), F.array_max(every)).alias("span"),
    )


def parse_selections(selections: DataFrame, available: int) -> DataFrame:
    """Chapters of each selection (`1`, `1,3`, `2-4`, mixed; blank: all), null where it isn't valid."""
    items = F.transform(F.split("selection", ","), lambda x: F.btrim(x))
    blank = F.btrim("selection") == ""
    shaped = F.forall("items", lambda x: x.rlike(r"^\d+$|^\d+\s*-\s*\d+$"))
    bound = lambda x, k: F.btrim(F.element_at(F.split(x, "-"), k)).try_cast("long")
    ranges = F.transform("items", lambda x: F.struct(bound(x, 1).alias("a"), bound(x, -1).alias("b")))
    inside = F.forall("r", lambda x: (x["a"] >= 1) & (x["b"] <= available) & (x["a"] <= x["b"]))
    rows = selections.select("selection", items.alias("items"), blank.alias("blank")).withColumn("r", F.when(shaped & ~F.col("blank"), ranges))
    rows = rows.withColumn("n", F.when(F.col("r").isNotNull() & inside, F.flatten(F.transform("r", lambda x: F.sequence(x["a"], x["b"])))))
    rows = rows.withColumn("n", F.when(F.size(F.array_distinct("n")) == F.size("n"), F.array_sort("n")))
    rows = rows.withColumn("n", F.when(F.col("blank"), F.sequence(F.lit(1).cast("long"), F.lit(available).cast("long"))).otherwise(F.col("n")))
    return rows.select("selection", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("indices_csv"), F.col("n").isNotNull().alias("valid"))


def parse_indices(stored: DataFrame, available: int) -> DataFrame:
    """Chapters of each stored list of indices (`csv`; blank or null: all), null where it isn't valid: no ranges, nothing twice."""
    items = F.transform(F.split("csv", ","), lambda x: F.btrim(x))
    blank = F.coalesce(F.btrim("csv") == "", F.lit(True))
    rows = stored.select("csv", blank.alias("blank"), F.when(F.forall(items, lambda x: x.rlike(r"^\d+$")), F.transform(items, lambda x: x.try_cast("long"))).alias("n"))
    inside = F.forall("n", lambda x: x.between(1, available)) & (F.size(F.array_distinct("n")) == F.size("n"))
    every = F.sequence(F.lit(1).cast("long"), F.lit(available).cast("long"))
    rows = rows.withColumn("n", F.when(F.col("blank"), every).when(inside, F.array_sort("n")))
    return rows.select("csv", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("indices_csv"), F.col("n").isNotNull().alias("valid"))


def chapter_parts(parts: DataFrame, book: str, *, numbering: str = "source") -> DataFrame:
    """Of each chapter its number, title, track and files in order, and the source units that it refers to.

    `parts` has `book`, `chapter_index`, `chunk_index`, `part_title`, `file` and
    `orders` (array).  The title is the first part's, `chapter-001` and so on
    without one; numbers are the source's or run over the chapters that are there.
    """
    by_place = F.sort_array(F.collect_list(F.struct("chunk_index", "part_title", "file")))
    chapters = parts.groupBy(book, "chapter_index").agg(by_place.alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("orders")))).alias("o"))
    own = Window.partitionBy(book)
    number = F.col("chapter_index") if numbering == "source" else F.row_number().over(own.orderBy("chapter_index"))
    title = F.coalesce(F.nullif(F.col("p")[0]["part_title"], F.lit("")), F.format_string("chapter-%03d", "chapter_index"))
    rows = chapters.withColumn("number", number.cast("long")).withColumn("total", F.count("*").over(own))
    return rows.select(
        book,
        "chapter_index",
        "number",
        title.alias("title"),
        F.concat_ws("/", "number", "total").alias("track"),
        F.array_join(F.transform("p", lambda x: x["file"]), ",").alias("files"),
        F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("orders"),
    )


def part_mapping(turns: DataFrame) -> DataFrame:
    chapter, part = F.expr("turn div 4 + 1"), F.col("turn") % 4 + 1
    rows = turns.select("conv_id", "turn", F.concat_ws(":", chapter, part).alias("m"), F.format_string("%03d_%02d.wav", chapter, part).alias("f"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "m", "f"))).alias("p"))
    return ordered.select("conv_id", F.size("p").cast("long").alias("part_count"), F.array_join(F.transform("p", lambda x: x["m"]), ",").alias("mapping"), F.array_join(F.transform("p", lambda x: x["f"]), ",").alias("files"))


def alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positions of two stages held against each other, and how many differ."""
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    a = left.select("conv_id", i.alias("i"), F.col("turn").alias("a"))
    b = right.select("conv_id", i.alias("i"), F.col("turn").alias("b"))
    both = a.join(b, ["conv_id", "i"], "full_outer")
    return both.groupBy("conv_id").agg(F.count("*").alias("positions"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))


def resume(artefacts: DataFrame, stages: list[str]) -> DataFrame:
    """The first missing stage of each run (bit k of its id: stage k exists), and whether a later one exists."""
    exists = [F.getbit("run_id", F.lit(k)) == 1 for k in range(len(stages))]
    missing = F.coalesce(*[F.when(~e, F.lit(k)) for k, e in enumerate(exists)])
    name, stale = F.lit("done"), F.lit(False)
    for k in reversed(range(len(stages))):
        later = F.lit(False)
        for e in exists[k + 1 :]:
            later = later | e
        name, stale = F.when(F.col("m") == k, stages[k]).otherwise(name), F.when(F.col("m") == k, later).otherwise(stale)
    return artefacts.withColumn("m", missing).select("run_id", name.alias("next_stage"), stale.alias("stale"))


def resolve_formats(requests: DataFrame) -> DataFrame:
    """Canonical name of a request and its formats in order; both null where it isn't valid.

    Alone, `none`, `aac`, `both` and `all` have meanings of their own; in a list
    only `wav`, `m4a`, `aac` and `mp3` have.
    """
    whole = F.lower(F.btrim("request", F.lit(" \t\n\x0b\f\r")))
    words = requests.select("request", whole.alias("w"), F.filter(F.transform(F.split(whole, ","), lambda x: F.btrim(x)), lambda x: x != "").alias("t"))
    has = lambda *names: F.arrays_overlap("t", F.array(*map(F.lit, names)))
    listed = F.col("w").contains(",") & (F.size("t") > 0) & (F.size(F.array_except("t", F.array(*map(F.lit, ("wav", "m4a", "aac", "mp3"))))) == 0)
    of_list = F.when(has("m4a", "aac") & has("mp3"), "both").when(has("mp3"), "mp3").when(has("m4a", "aac"), "m4a").otherwise("wav")
    name = F.when(F.col("w").isin("wav", "none"), "wav").when(F.col("w").isin("m4a", "aac"), "m4a").when(F.col("w") == "mp3", "mp3").when(F.col("w").isin("both", "all"), "both").when(listed, of_list)
    formats = F.when(F.col("name") == "both", ",".join(FORMATS)).when(F.col("name") == "wav", "").otherwise(F.col("name"))
    return words.withColumn("name", name).select("request", "name", formats.alias("formats"))


def package_plan(turns: DataFrame) -> DataFrame:
    """File, track and parts of each chapter to be packaged."""
    chapters = turns.groupBy("conv_id", F.expr("turn div 4 + 1").alias("chapter_number")).agg(F.count("*").alias("parts"))
    total = F.count("*").over(Window.partitionBy("conv_id"))
    n = F.col("chapter_number")
    return chapters.select("conv_id", "chapter_number", F.format_string("chapter_%03d_chapter-%d.m4a", n, n).alias("file"), F.concat_ws("/", n, total).alias("track"), "parts")


def stage_events(outcomes: DataFrame) -> DataFrame:
    """`run_id`, `seq`, `line`, `place`: log lines of stages as they begin and end, with their place among all stages where they begin.

    `outcomes` has `run_id`, `n` (order), `stage` and `error_type` (null: it went well);
    a run ends with its first failure.  A stage of another name has no place.
    """
    before = Window.partitionBy("run_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ran = outcomes.where("stage IS NOT NULL").withColumn("failed", F.coalesce(F.max(F.col("error_type").isNotNull()).over(before), F.lit(False))).where("NOT failed")
    line = lambda level, event: F.concat(F.lit(f"[phase] level={level} stage="), F.col("stage"), F.lit(f" event={event}"))
    error = F.concat(line("ERROR", "failure"), F.lit(" error_type="), log_token(F.col("error_type")))
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    place = F.when(at > 0, F.concat(at.cast("string"), F.lit(f"/{len(STAGES)}")))
    start = F.struct(F.lit(1).alias("k"), line("INFO", "start").alias("line"), place.alias("place"))
    end = F.struct(F.lit(2).alias("k"), F.when(F.col("error_type").isNull(), line("INFO", "complete")).otherwise(error).alias("line"), F.lit(None).cast("string").alias("place"))
    events = ran.select("run_id", "n", F.inline(F.array(start, end)))
    return events.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("n", "k")).cast("long").alias("seq"), "line", "place")
