import hashlib
import math

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioforge.llm import quality_classifier as qc
from folioforge.llm.queries import QUERIES

from .conftest import docs_frame, prose
from .test_near_duplicates import brute
from .test_media_lm_mixing import brute_mix, drawn_number
from .test_quality import brute_kneser_ney, mixed_corpus


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    good, junk = mixed_corpus()
    copies = [(500 + k, prose(k, 120)) for k in range(10)] + [(600 + k, prose(k, 118) + " changed ending") for k in range(10)]
    docs_frame(spark, good + junk[:16] + copies).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), dict(good + junk[:16] + copies), {i for i, _ in good}


def test_stages_one_by_one(spark, small):
    sf_dir, texts, good = small
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    expected = set(texts)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= expected and docs.count() == len(ids)
        assert k == 4 or docs.columns == columns
        if k in (0, 1):
            assert len({i for i in texts if i < 100 or i >= 500} - ids) <= (0, 25)[k] and not ids & {i for i in texts if 100 <= i < 500}
        if k == 2:
            parts = brute([(i, texts[i]) for i in sorted(expected)], 5, 80)
            assert ids == {i for i, (_, c) in parts.items() if i == c}
        expected = ids
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_classifier_and_mixing_equal_brute_force(spark, small):
    """What the classifier's threshold and the raked probabilities say of each document is what the stages do."""
    sf_dir, texts, _ = small
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).cache()
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    trains = {r["doc_id"]: r["trains"] for r in qc.train(docs, corpus_pipeline.trusted_labels(spark, sf_dir)).roles.collect()}
    assert set(trains) == labels & set(held) and not all(trains.values())
    perplexity = brute_kneser_ney([held[i] for i in trains if trains[i]])
    scores = {i: perplexity(t) for i, t in held.items()}
    pool = sorted(scores[i] for i in trains if not trains[i])
    most = pool[math.ceil(qc.UPPER * len(pool)) - 1]
    kept = corpus_pipeline.quality_classifier(spark, docs, sf_dir).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i in held if scores[i] <= most * (1 + 1e-6)} and ids < set(held)

    parts = corpus_pipeline.near_duplicates(spark, kept, sf_dir).cache()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in parts.collect()]
    topic = lambda t: "note" if len(t) < 600 else "prose"  # noqa: E731  these texts have no other signs
    cells = [(i, (s, x, topic(t)), len(t.split())) for i, t, x, s in rows]
    p = brute_mix(cells, 0.9)
    drawn = {r["doc_id"] for r in corpus_pipeline.source_mixing(spark, parts, sf_dir).collect()}
    assert drawn == {i for i, cell, _ in cells if drawn_number(i) < p[cell]} and len(drawn) < len(rows)


def test_clashing_columns_nulls_and_repeated_rows(spark, small, tmp_path):
    sf_dir, _, _ = small
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(3).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "n_chars")
    odd = odd.union(docs.limit(2)).union(docs.limit(1).selectExpr("7000L", "CAST(NULL AS STRING)", "lang", "source", "0L"))
    names = ["c0", "d0", "k0", "v0", "u", "p", "gone", "mix_p", "mix_tokens", "rule_p", "rule_good", "label", "cid", "n_tokens"]
    wide = docs.union(odd).select("*", *[F.lit(n).alias(n) for n in names])
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        wide = stage(spark, wide, str(tmp_path)).cache()
        assert wide.count() > 50
        if k < 4:
            assert wide.columns == [*docs.columns, *names] and {tuple(r) for r in wide.select(*names).collect()} == {tuple(names)}
            assert wide.where("doc_id IS NULL").count() > 0 or k > 0
            assert wide.where("doc_id = 7000").count() == 0


def test_run_gives_what_the_stages_give(spark, small):
    sf_dir, _, _ = small
    first = corpus_pipeline.run(spark, sf_dir)
    assert first.count() == first.select("doc_id").distinct().count() > 50
    assert sorted(first.collect()) == sorted(corpus_pipeline.run(spark, sf_dir).collect())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs_frame(spark, [(1, "x")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in QUERIES}
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
