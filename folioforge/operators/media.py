"""PCM samples as arrays: peaks, silence, level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 32767
#: Normalised peak and silence threshold as shares of the largest amplitude.
TARGET, SILENCE = 0.95, 0.01


def samples_of(vectors: DataFrame) -> DataFrame:
    """Vectors of numbers within one as 16-bit samples, cut toward zero."""
    return vectors.select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * MOST).cast("long")).alias("samples"))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))


def trim_silence(samples: Column, threshold: int = max(1, round(MOST * SILENCE))) -> Column:
    """From the first to the last sample above the threshold; nothing if there is none."""
    loud = F.filter(F.transform(samples, lambda x, i: F.when(F.abs(x) > threshold, i)), lambda i: i.isNotNull())
    first, last = F.array_min(loud), F.array_max(loud)
    return F.when(first.isNull(), F.slice(samples, 1, 0)).otherwise(F.slice(samples, first + 1, last - first + 1))


def normalize(samples: Column, target: int = round(MOST * TARGET)) -> Column:
    """Scaled so that the peak is the target, half to even; left alone if it is within one of it."""
    top = peak(samples)
    scaled = lambda x: F.bround(x * (F.lit(float(target)) / top), 0)
    fit = lambda x: F.greatest(F.lit(-MOST - 1), F.least(F.lit(MOST), x)).cast("long")
    return F.when((top == 0) | (F.abs(top - target) <= 1), samples).otherwise(F.transform(samples, lambda x: fit(scaled(x))))
