"""The training-data pipeline over `documents`: rules, classifier, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  A stage works on all
that its predecessor kept, and what it rejects is gone; all but the last return
the columns of documents, whatever they are called, extra ones with them.

Defined cases: a null or empty text fails the base rules and goes; a null language
or source is a value of its own; rows that share an id are judged each by its
text, but stay or go together as near duplicates and in the draw; rows with a
null id are no near duplicates; an empty table gives an empty result, and with no
trusted label the classifier keeps everything.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.byte_bpe import round_trip
from folioforge.llm.common import saved, shared_dir, table
from folioforge.llm.parity_join import keep_one
from folioforge.llm.quality_classifier import keep_good
from folioforge.llm.quality_rules import apply_rules
from folioforge.llm.queries import trusted_labels
from folioforge.llm.source_mixing import coarse_topic, draw


#: Rows and bytes of a batch of texts on their way to a Python worker, and bytes of encoded pre-tokens that one keeps.
BATCH_ROWS, BATCH_BYTES, CACHE = 2000, 8 << 20, 40 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep batches small on both sides of a worker's pipe, as executors hold several stages' workers at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the weighted votes of the rules reject go."""
    small_batches(spark)
    return apply_rules(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents too perplexing for their language's model go."""
    return keep_good(docs, trusted_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near duplicates stays (five-word n-grams, similarity 0.8)."""
    return keep_one(docs, n=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents are drawn so that source, language and topic reach their target shares."""
    return draw(docs, {"source": docs["source"], "lang": docs["lang"], "topic": coarse_topic(docs["text"])}, budget=0.9)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids of each text, as their number and digests of them and of the text decoded from them."""
    keep = ["doc_id", "lang", "source"]
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep, cache=CACHE)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: Byte-pair merging is beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
