import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import quality_classifier as qc
from folioforge.llm.quality_rules import COUNTS, apply_rules, count_features, judge

from .conftest import TEXTS, docs_frame, prose


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    again = {g for g in grams if times[g] > 1}
    covered = {i + k for i, g in enumerate(grams) if g in again for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(edge_docs):
    rows = count_features(edge_docs.select("doc_id", "text", "lang")).collect()
    texts = dict(TEXTS)
    for r in rows:
        assert tuple(r[f"rule_{c}"] for c in COUNTS) == brute_counts(texts[r["doc_id"]]), r["doc_id"]


def mixed_corpus():
    good = [(i, prose(i, 120)) for i in range(80)]
    caps = [(100 + i, " ".join(w.upper() + "!!" for w in prose(100 + i, 120).split())) for i in range(8)]
    marks = [(200 + i, " ".join(w + "***" for w in prose(200 + i, 120).split())) for i in range(8)]
    again = [(300 + i, "mentpa " * 60 + prose(300 + i, 20)) for i in range(4)]
    return good, caps + marks + again


def test_rules_keep_good_and_reject_junk(spark):
    good, junk = mixed_corpus()
    kept = {r["doc_id"] for r in apply_rules(docs_frame(spark, good + junk)).collect()}
    assert kept == {i for i, _ in good}


def test_rules_on_edges_and_clashing_columns(edge_docs, empty_docs):
    clashing = edge_docs.withColumn("rule_p", F.lit(1)).withColumn("rule_n_words", F.lit("x"))
    out = apply_rules(clashing)
    assert out.columns == clashing.columns
    assert {r["doc_id"] for r in out.collect()} <= {6}
    assert apply_rules(empty_docs).count() == 0
    judged = judge(count_features(edge_docs.select("doc_id", "text", "lang"))).select("doc_id", "rule_base_failed", "rule_kept").collect()
    assert len(judged) == len(TEXTS) and all(r["rule_base_failed"] for r in judged if r["doc_id"] != 6)


def symbols(text):
    return [qc.START] * (qc.ORDER - 1) + list((text or "").encode()) + [qc.END]


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney by dictionaries, as a function of context and symbol."""
    n = qc.ORDER
    grams = Counter()
    for text in texts:
        s = symbols(text)
        grams.update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    counts = {n: grams}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    models = {}
    for k in range(1, n + 1):
        met = [sum(c == j for c in counts[k].values()) for j in range(5)]
        y = met[1] / max(met[1] + 2 * met[2], 1)
        d = [0.0] + [min(max(j - (j + 1) * y * met[j + 1] / met[j], 0.1), j) if met[j] and met[j + 1] else j * 0.5 for j in (1, 2, 3)]
        total, freed = defaultdict(int), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3)]
        models[k] = counts[k], d, total, freed

    def p(context, symbol, k=n):
        if k == 0:
            return qc.UNIFORM
        context = context[-(k - 1) :] if k > 1 else ()
        c, d, total, freed = models[k]
        if context not in total:
            return p(context, symbol, k - 1)
        m = c.get((*context, symbol), 0)
        return (m - d[min(m, 3)] if m else 0) / total[context] + freed[context] / total[context] * p(context, symbol, k - 1)

    def perplexity(text):
        s = symbols(text)
        terms = [math.log(p(tuple(s[i - n + 1 : i]), s[i])) for i in range(n - 1, len(s))]
        return -sum(terms) / len(terms)

    return perplexity


ODD = [(900, prose(999, 40) + " ZÄ 東京は夜"), (901, ""), (902, None), (903, "x" * 300), (904, "東京" * 30)]


@pytest.fixture(scope="module")
def mixed(spark):
    """Two languages with models of their own, and some documents that share the pooled one."""
    rows = [(i, prose(i % 110, 30), "en" if i < 70 else "fr" if i < 140 else None if i % 2 else "fi") for i in range(150)] + [(i, t, "en") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


@pytest.mark.parametrize("broadcast", [0, qc.BROADCAST])
def test_verdicts_equal_brute_force(spark, mixed, broadcast):
    """Perplexities, thresholds and verdicts, by joins and by look-ups."""
    docs, rows = mixed
    trusted = docs.where("doc_id < 148").select("doc_id")
    model = qc.train(docs, trusted)
    trains = {r["doc_id"]: r["trains"] for r in model.roles.collect()}
    assert 15 < sum(not x for x in trains.values()) < 60 and model.langs == ["en", "fr"]
    judge = lambda lang: lang if lang in ("en", "fr") else ""
    brutes = {m: brute_kneser_ney([t for i, t, x in rows if trains.get(i) and m in ("", judge(x))]) for m in ("en", "fr", "")}
    expected = {i: brutes[judge(x)](t) for i, t, x in rows}
    limits = {}
    for m in brutes:
        pool = sorted(expected[i] for i, t, x in rows if judge(x) == m and trains.get(i) is False) or sorted(expected[i] for i, t, x in rows if judge(x) == m and i in trains)
        limits[m] = pool[math.ceil(0.9 * len(pool)) - 1]
    out = {r["doc_id"]: r for r in qc.classify(docs, trusted, upper=0.9, broadcast=broadcast).collect()}
    assert len(out) == len(rows)
    for i, t, x in rows:
        assert math.isclose(out[i]["log_perplexity"], expected[i], rel_tol=1e-6) and out[i]["n_bytes"] == len((t or "").encode()), i
        assert math.isclose(out[i]["threshold"], limits[judge(x)], rel_tol=1e-6)
        assert out[i]["kept"] == (not t or expected[i] <= limits[judge(x)] * (1 + 1e-6)), i
    kept = {r["doc_id"] for r in qc.keep_good(docs, trusted, upper=0.9, broadcast=broadcast).collect()}
    assert kept == {i for i in out if out[i]["kept"]} and 903 not in kept


def test_scripts_keep_their_characters_apart(spark):
    """Texts of one CJK vocabulary and shuffles of its characters have distinct perplexities."""
    import random

    words = ["東京", "大学", "日本", "語学", "新聞", "天気", "電車", "時間", "世界", "料理", "問題", "教育"]
    made = lambda seed: "".join(random.Random(seed).choices(words, k=60))
    jumbled = lambda seed: "".join(random.Random(seed).sample(made(seed), 120))
    docs = docs_frame(spark, [(i, made(i)) for i in range(80)] + [(100 + i, jumbled(i)) for i in range(20)]).withColumn("lang", F.lit("ja"))
    rows = {r["doc_id"]: r for r in qc.classify(docs, docs.where("doc_id < 70").select("doc_id")).collect()}
    assert max(rows[i]["log_perplexity"] for i in range(80)) < min(rows[100 + i]["log_perplexity"] for i in range(20))
    assert not any(rows[100 + i]["kept"] for i in range(20)) and sum(rows[i]["kept"] for i in range(80)) > 70


def test_classifier_separates_and_handles_edges(spark, edge_docs, empty_docs):
    good, junk = mixed_corpus()
    docs = docs_frame(spark, good + junk[:16] + [(700, prose(3, 200_000))])
    trusted = docs.where("doc_id < 70").select("doc_id")
    kept = {r["doc_id"] for r in qc.classify(docs, trusted).collect() if r["kept"]}
    assert not kept & {i for i, _ in junk} and len(kept & {i for i, _ in good}) >= 70
    assert {r["doc_id"] for r in qc.keep_good(docs, trusted).collect()} == kept
    nobody = docs.limit(0).select("doc_id")
    assert qc.keep_good(docs, nobody).count() == docs.count()
    assert all(r["kept"] for r in qc.classify(docs, nobody).collect())
    for broadcast in (0, qc.BROADCAST):
        assert qc.classify(edge_docs, edge_docs.select("doc_id"), broadcast=broadcast).count() == len(TEXTS)
        assert qc.keep_good(edge_docs.withColumn("k0", F.lit(1)), edge_docs.select("doc_id"), broadcast=broadcast).columns == [*edge_docs.columns, "k0"]
    assert qc.classify(empty_docs, trusted).count() == 0


def test_small_languages_have_models_of_their_own(spark):
    docs = docs_frame(spark, [(i, prose(i, 20)) for i in range(1080)])
    lang = F.when(F.col("doc_id") >= 1070, "fi").when(F.col("doc_id") >= 1000, "es").otherwise("en")
    model = qc.train(docs.withColumn("lang", lang), docs.select("doc_id"), sample=200)
    assert model.langs == ["en", "es"] and 150 <= model.roles.where("trains").count() <= 200
    assert qc.train(docs, docs.select("doc_id"), sample=None).roles.where("trains").count() > 800


def test_pooled_threshold_without_trusted_documents_of_the_pooled_model(spark):
    docs = docs_frame(spark, [(i, prose(i, 120)) for i in range(90)]).withColumn("lang", F.when(F.col("doc_id") < 80, "en"))
    rows = qc.classify(docs, docs.where("doc_id < 80").select("doc_id"), upper=1.0).collect()
    assert all(r["threshold"] < 100 for r in rows) and sum(r["kept"] for r in rows) > 80


def test_every_trusted_document_trains_or_is_held_out(spark):
    """Counts, models and thresholds come from all trusted documents, however many there are."""
    rows = [(i, prose(i, 2), "en" if i % 8 else "fr") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 5900").select("doc_id")
    model = qc.train(docs, trusted, pooled=False)
    trains = {r["doc_id"]: r["trains"] for r in model.roles.collect()}
    hashed = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) % qc.HELD_OUT != 0).alias("x")).collect()
    assert trains == {r["doc_id"]: r["x"] for r in hashed if r["doc_id"] < 5900} and 4500 < sum(trains.values()) < 4900
    # no document is judged by the pooled model, so there is none
    assert model.langs == ["en", "fr"] == sorted(model.arrays().levels) and len(model.arrays().levels["en"]) == qc.ORDER
    assert model.rows == sum(len(x) for level in model.arrays().levels.values() for order in level for x in order[::2])
    out = {r["doc_id"]: r for r in qc.classify(docs, trusted).collect()}
    for lang in model.langs:
        brute = brute_kneser_ney([t for i, t, x in rows if trains.get(i) and x == lang])
        some = [(i, t) for i, t, x in rows if x == lang and i % 8 in (0, 1)]
        assert all(math.isclose(out[i]["log_perplexity"], brute(t), rel_tol=1e-6) for i, t in some)
        pool = sorted(brute(t) for i, t, x in rows if x == lang and trains.get(i) is False)
        assert math.isclose(out[some[0][0]]["threshold"], pool[math.ceil(qc.UPPER * len(pool)) - 1], rel_tol=1e-6)


@pytest.mark.parametrize("held", [0, 40, 1 << 20])
def test_counts_of_batches_that_are_passed_on_early(held):
    import pyarrow as pa

    texts = [prose(i, 5) for i in range(30)] + ["", None, "東京"]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en", "", "fr"]), pa.array(texts[i : i + 3], pa.string())], names=["lang", "text"]) for i in range(0, 33, 3)]
    found = Counter()
    for b in qc.count_batches(iter(batches), held):
        for lang, gram, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            found[lang, gram] += c
    expected = Counter()
    for i, t in enumerate(texts):
        expected.update((("en", "", "fr")[i % 3], g) for g in qc.grams_of([t])[0].tolist())
    assert found == expected and not list(qc.count_batches(iter([]), held))
