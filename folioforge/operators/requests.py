"""Requests to text providers: keys, caches, costs, failures and rate limits."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Estimated US dollars for 1000 characters.
TRANSLATE, REWRITE, SPEECH = 0.0015, 0.0008, 0.0150


def cache_key(text: Column, *, provider: str = "openai", model: str = "gpt", operation: str = "translate") -> Column:
    """Texts that differ in white space alone share a key."""
    head = f"response:{provider.strip().lower()}:{model}:{operation}:"
    return F.sha2(F.concat(F.lit(head), F.btrim(F.regexp_replace(text, r"\s+", " "))), 256)


def _ascii_json(text: Column) -> Column:
    """A string as JSON in ASCII: anything but printable ASCII by its UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"))

    def unit(u: Column) -> Column:
        plain = F.char(F.conv(u, 16, 10).cast("long"))
        escaped = F.concat(F.lit("\\u"), F.lower(u))
        return F.when(u == "0022", '\\"').when(u == "005C", "\\\\").when(u == "0008", "\\b").when(u.between("0020", "007E"), plain).otherwise(escaped)

    simple = ~text.rlike(r'[^ -~]|["\\]')
    body = F.when(simple, text).otherwise(F.array_join(F.transform(units, unit), ""))
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def identity_key(identity: dict[str, Column], *, provider: str, model: str, operation: str) -> Column:
    """Key of a response: a digest of what was asked, as compact JSON with sorted names and white space collapsed.

    `identity` has strings; the key of null is that of JSON's null.
    """
    collapse = lambda c: F.btrim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    fields = [F.concat(F.lit(json.dumps(k) + ":"), _ascii_json(collapse(identity[k]))) for k in sorted(identity)]
    document = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    head = f"response:{provider.strip().lower()}:{model.strip()}:{operation.strip().lower()}:"
    return F.concat(F.lit(head), F.sha2(document, 256))


def answered(asked: DataFrame) -> DataFrame:
    """For each request its key and the request that was sent for it, the first with that key."""
    keyed = asked.select("doc_id", cache_key(F.col("text")).alias("cache_key"))
    first = keyed.groupBy("cache_key").agg(F.min("doc_id").alias("answered_by"))
    return keyed.join(first, "cache_key").select("doc_id", "cache_key", "answered_by")


def telemetry(asked: DataFrame) -> DataFrame:
    keyed = asked.select(cache_key(F.col("text")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    sums = keyed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count("*").alias("misses"))
    hits = F.col("requests") - F.col("misses")
    rate = F.when(F.col("requests") > 0, hits / F.col("requests")).otherwise(0.0)
    return sums.select("requests", "misses", hits.alias("hits"), F.format_string("%.4f", rate).alias("hit_rate"))


def translate(asked: DataFrame, language: str) -> DataFrame:
    """One call for each key, to a provider that puts the language before the text, joined back to all requests."""
    keyed = asked.select("doc_id", "text", cache_key(F.col("text")).alias("k"))
    calls = keyed.groupBy("k").agg(F.min_by("text", "doc_id").alias("text"))
    answers = calls.select("k", F.concat(F.lit(f"[{language}] "), F.col("text")).alias("translated"))
    return keyed.select("doc_id", "k").join(answers, "k").select("doc_id", "translated", F.lit("mock").alias("provider"))


def billed(*texts: Column) -> Column:
    """Characters that a call is billed for: those of its texts together, one at least; null counts as none."""
    return F.greatest(F.lit(1), reduce(Column.__add__, [F.coalesce(F.length(t), F.lit(0)) for t in texts])).cast("long")


def usage(usd: Column) -> Column:
    """A cost as it is added up: negative ones count as none."""
    return F.greatest(F.lit(0.0), usd)


def costs(texts: DataFrame, key: str) -> DataFrame:
    """Rounded costs of language models and speech, and the total of the rounded.

    `texts` has `text`, `translated` and `rewritten`.
    """
    text, translated, rewritten = F.col("text"), F.col("translated"), F.col("rewritten")
    sums = texts.groupBy(key).agg(F.sum(billed(text, translated)).alias("a"), F.sum(billed(translated, rewritten)).alias("r"), F.sum(billed(rewritten)).alias("b"))
    llm = F.round(F.col("a") * TRANSLATE / 1000 + F.col("r") * REWRITE / 1000, 6)
    tts = F.round(F.col("b") * SPEECH / 1000, 6)
    return sums.select(key, llm.alias("llm_usd"), tts.alias("tts_usd"), F.round(llm + tts, 6).alias("total_usd"))


def failure_kind(status: Column, message: Column, code: Column) -> Column:
    """The kind of an HTTP failure: the provider's code and message decide before the status does."""
    m, c = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(code, F.lit("")))
    wrong_model = m.contains("model") & (m.contains("not found") | m.contains("does not exist") | m.contains("invalid"))
    return (
        F.when((status == 401) | m.contains("api key"), "invalid_api_key")
        .when((c == "insufficient_quota") | ((status == 429) & m.contains("quota")), "insufficient_quota")
        .when((c == "model_not_found") | wrong_model, "invalid_model")
        .when(status.isin(408, 504) | m.contains("timeout") | m.contains("timed out"), "timeout")
        .otherwise("http_error")
    )


def retryable(kind: Column, status: Column) -> Column:
    """Whether a failure may pass; without a status only one of unknown kind may, besides those of the network."""
    return (
        F.when(kind.isin("invalid_api_key", "insufficient_quota", "invalid_model"), False)
        .when(kind.isin("timeout", "transport"), True)
        .when(status.isNull(), kind == "unknown")
        .otherwise((status >= 500) | status.isin(408, 429))
    )


def classify(failures: DataFrame) -> DataFrame:
    """`kind` and `retryable` of each row of `status`, `message`, `code`; a failure without a status is one of the network."""
    message = F.lower(F.coalesce("message", F.lit("")))
    network = F.when(message.contains("timeout") | message.contains("timed out"), "timeout").otherwise("transport")
    kind = F.when(F.col("status").isNull(), network).otherwise(failure_kind(F.col("status"), F.col("message"), F.col("code")))
    return failures.withColumn("kind", kind).withColumn("retryable", retryable(F.col("kind"), F.col("status")))


def backoff(attempt: Column, base: float = 0.5, most: float = 4.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def grants(calls: DataFrame, *, key: str, seconds: float) -> DataFrame:
    """When each call may start if a key's starts lie `seconds` apart: a running maximum in closed form."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    i = (F.row_number().over(w) - 1) * seconds
    timed = calls.select("event_id", key, "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), i.alias("i"))
    return timed.select("event_id", F.round(F.col("i") + F.max(F.col("t") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)), 3).alias("granted"))
