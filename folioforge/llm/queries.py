"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import table
from folioforge.llm.oracles import parity_join_sql, quality_rules_sql, source_mixing_sql


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioforge.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled as good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.llm.quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), trusted_labels(spark, sf_dir))


#: Host and path rules of the URL filter.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.llm.url_filters import Rule, judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), [Rule(*r) for r in URL_RULES])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.llm.common import saved, shared_dir
    from folioforge.llm.quality_rules import COUNTS, count_features, judge

    docs = table(spark, sf_dir, "documents")
    # a few numbers for each document, counted once and used for the fit and the verdict
    counted = saved(count_features(docs.select("doc_id", "text", "lang")).drop("text", "lang"), shared_dir(spark))
    judged = judge(counted)
    return judged.select("doc_id", *[judged[f"rule_{c}"].alias(c) for c in COUNTS], judged["rule_base_failed"].alias("base_failed"), judged["rule_kept"].alias("kept"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.llm.parity_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree made of their ids, three levels deep.

    A document that states its licence in its first four lines is the licence
    file of a directory: by its id modulo 3 of the lowest, the middle or the
    highest level.
    """
    from pyspark.sql import functions as F

    from folioforge.llm.license_scans import scan_licenses

    docs = table(spark, sf_dir, "documents")
    opens = F.col("at_line").between(0, 3)
    levels = [F.concat(F.lit("tree"), (F.col("doc_id") / F.lit(16384)).cast("long").cast("string")), (F.col("doc_id") / F.lit(1024)).cast("long").cast("string"), (F.col("doc_id") / F.lit(64)).cast("long").cast("string")]
    name = F.concat(F.when(opens, F.lit("LICENSE-")).otherwise(F.lit("doc-")), F.col("doc_id").cast("string"))
    place = F.when(opens & (F.col("doc_id") % 3 == 1), F.concat_ws("/", *levels[:2])).when(opens & (F.col("doc_id") % 3 == 2), levels[0]).otherwise(F.concat_ws("/", *levels))
    path = F.concat(place, F.lit("/"), name)
    found = scan_licenses(docs, opens, path=path)
    return found.select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "origin", "license_dir")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.llm.media_columns import store_and_rebuild

    return store_and_rebuild(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioforge.llm.lm_scoring import is_held_out, score, train

    docs = table(spark, sf_dir, "documents")
    held_out = is_held_out(docs["doc_id"])
    return score(docs, train(docs.where(~held_out)), held_out=held_out)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from folioforge.llm.source_mixing import coarse_topic, mix

    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, {"source": docs["source"], "lang": docs["lang"], "topic": coarse_topic(docs["text"])}, columns=["doc_id"])
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_p", 6).alias("p"), F.col("mix_kept").alias("kept"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from folioforge.llm.byte_bpe import round_trip

    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache=256 << 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_parity_join": op5_parity_join,
    "op6_license_scans": op6_license_scans,
    "op7_media_columns": op7_media_columns,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_source_mixing": op9_source_mixing,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": quality_rules_sql(),
    "op5_parity_join": parity_join_sql(),
    "op9_source_mixing": source_mixing_sql(),
}
