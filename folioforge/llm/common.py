"""What several operators share: tables, the shared folder, stage cuts, column checks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as the contracts give it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Bits for each key of the bitmaps that spare most rows a join (a superset passes), and most bits of one (32 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under `spark.checkpoint.dir`, which driver and executors share.

    The setting is read from the session.  Only where it is unset and the master
    is local, as in tests, is a folder below the warehouse used instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/folioforge-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write `df` once and read it back: the lineage ends in files that outlive executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, column: str, most: int) -> list[tuple[int, int]]:
    """`column` and `n` of rows of `counts` down to a count that at most `most` rows reach.

    The count comes from a histogram of a few hundred bins, so no more is sent to the driver.
    """
    place = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(((r["b"], r["m"]) for r in counts.groupBy(place.alias("b")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, taken = None, 0
    for b, m in bins:
        taken += m
        if taken > most:
            break
        least = b
    return [] if least is None else [tuple(r) for r in counts.where(place >= least).select(column, "n").collect()]


def presence(keys: DataFrame, column: str) -> Broadcast:
    """A bitmap by the low bits of 64-bit hashes, sized by their number within `FILTER_MOST`."""
    bits = min(FILTER_MOST, 1 << max(16, (FILTER_BITS * keys.count()).bit_length()))
    # Spark numbers the bits of its bitmaps from 1
    places = keys.select((F.pmod(F.col(column), F.lit(bits)) + 1).alias("p"))
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    filled = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows:  # FILTER_MOST bits at most, whatever the input
        filled[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast((filled.tobytes(), bits))


def present(shared: Broadcast, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set in a bitmap of `presence`."""
    bitmap, bits = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
    at = hashes & (bits - 1)
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def word_array(text):
    """Words of a text as an array; null counts as no text."""
    words = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(words, lambda w: w != F.lit(""))


def fold_ascii(text):
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
