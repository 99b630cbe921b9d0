"""Options, statuses and messages as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import collapse_title, strip, title_case

TEXT_TYPES = ("application/xhtml+xml", "text/html", "application/xml")
#: Bit rates of the encoding profiles.
PROFILES = {"balanced": "128k", "voice": "96k", "music": "160k"}
#: What to do about a kind of failure in a stage; a stage of None stands for the others.
HINTS = {
    ("invalid_api_key", None): "Set a valid provider key.",
    ("insufficient_quota", "rewrite"): "Check the provider's quota and try again, or pass the rewriting over.",
    ("insufficient_quota", None): "Check the provider's quota and try again.",
    ("invalid_model", "translate"): "Choose an available model for translation.",
    ("invalid_model", "rewrite"): "Choose an available model for rewriting, or pass the rewriting over.",
    ("invalid_model", "tts"): "Choose an available model for speech.",
    ("invalid_model", None): "Choose a valid model of the provider.",
    ("timeout", None): "Try again; if it keeps timing out, check the network.",
    ("transport", None): "Check the connection and try again.",
    (None, "translate"): "Check key, model and provider of the translation and try again.",
    (None, "rewrite"): "Check key, model and provider of the rewriting, or pass it over.",
    (None, "tts"): "Check key, model, voice and provider of the speech and try again.",
    (None, None): "Check the provider's configuration and try again.",
}


def source_format(path: Column) -> Column:
    """By the suffix of a named file; null for others."""
    suffix = F.regexp_extract(F.lower(path), r"[^/]\.(pdf|epub)$", 1)
    return F.nullif(suffix, F.lit(""))


def is_text_type(media_type: Column) -> Column:
    return F.lower(F.btrim(media_type)).isin(*TEXT_TYPES)


def chat_content(response: Column) -> Column:
    """The message of a chat response, one string or its text parts joined; null if there is none."""
    path = "$.choices[0].message.content"
    tree = F.try_parse_json(response)
    items = F.try_variant_get(tree, path, "array<variant>")
    kind = lambda p: F.schema_of_variant(p)
    field = lambda p, name: F.try_variant_get(p, name, "variant")
    texts = F.filter(items, lambda p: (F.try_variant_get(p, "$.type", "string") == "text") & (kind(field(p, "$.text")) == "STRING"))
    joined = F.array_join(F.transform(texts, lambda p: F.try_variant_get(p, "$.text", "string")), "")
    whole = F.try_variant_get(tree, path, "variant")
    return F.nullif(strip(F.when(items.isNotNull(), joined).when(kind(whole) == "STRING", F.try_variant_get(tree, path, "string"))), F.lit(""))


def translate_prompt(text: Column, language: str) -> Column:
    return F.concat(F.lit(f"Translate the following text into {language}. Keep the meaning and the paragraphs.\n\n"), text)


def hint(stage: Column, kind: Column) -> Column:
    """By kind and stage, else by kind, else by stage, else the last resort."""
    known = {k for k, _ in HINTS if k}
    out = F.lit(HINTS[None, None])
    for (k, s), text in sorted(HINTS.items(), key=lambda x: (x[0][0] is not None, x[0][1] is not None)):
        fits = ~F.coalesce(kind.isin(*known), F.lit(False)) if k is None else kind == k
        out = F.when(fits if s is None else fits & (stage == s), text).otherwise(out)
    return out


def bitrate(asked: Column, profile: Column) -> Column:
    """The bit rate asked for if it is one, else the profile's; null if neither is valid."""
    named = F.create_map(*[F.lit(x) for pair in PROFILES.items() for x in pair])
    wanted = F.when(profile == "", "balanced").otherwise(profile)
    return F.when(asked != "", F.when(asked.rlike(r"^\d{2,3}k$"), asked)).otherwise(named[wanted])


def export_status(requests: DataFrame, emitted: list[str]) -> DataFrame:
    """Reader formats asked for, what is wrong with a request, and whether all, some or none of them were emitted.

    Null, blank and `none` ask for nothing; a list of commas alone, and `none`
    beside others, are wrong (`empty`, `none`), as are words that name no format.
    """
    known = F.array(F.lit("epub"), F.lit("pdf"))
    whole = F.lower(strip(F.coalesce("request", F.lit(""))))
    words = requests.select("request", whole.alias("w"), F.filter(F.transform(F.split(whole, ","), lambda x: strip(x)), lambda x: x != "").alias("t"))
    nothing = F.col("w").isin("", "none")
    unknown = F.array_join(F.array_sort(F.array_except("t", known)), ",")
    bad = F.when(nothing, "").when(F.size("t") == 0, "empty").when(F.array_contains("t", "none") & (F.size(F.array_distinct("t")) > 1), "none").otherwise(unknown)
    words = words.withColumn("bad", bad).withColumn("f", F.when(F.col("bad") == "", F.filter(known, lambda x: F.array_contains("t", x))))
    made = F.array(*map(F.lit, sorted(emitted))) if emitted else F.array().cast("array<string>")
    status = F.when(F.col("bad") != "", "invalid").when(F.size("f") == 0, "planned_only").when(F.array_sort("f") == made, "emitted").when(F.size(made) > 0, "partial").otherwise("planned_only")
    csv = F.when(F.col("bad") == "", F.when(F.size("f") == 0, "none").otherwise(F.array_join("f", ",")))
    return words.select("request", csv.alias("formats"), "bad", status.alias("status"))


def stem_title(stem: Column) -> Column:
    """A title from a file's stem: separators are spaces, words begin with capitals."""
    return F.coalesce(title_case(collapse_title(F.regexp_replace(stem, "[_-]", " "))), F.lit("Translated Document"))
