"""URL filters: host and path rules, then a character language-model ratio.

URLs that a rule settles are labelled rows.  Two smoothed variable-order Markov
models over bytes are trained, one on accepted and one on rejected URLs; a URL
that no rule fits is accepted if the difference of its log-likelihoods, divided
by its length, reaches a threshold calibrated on all distinct labelled URLs that
didn't train.

Distinct labelled URLs of at most `LONGEST` bytes are sampled by hash to about
`sample` for each verdict to train on, so the models and what the driver collects
are bounded by parameters; one in `HELD_OUT` never trains.  The threshold comes
from a histogram of all others' scores, of a fixed number of bins; every URL is
judged.  Nothing is shuffled but the distinct labelled URLs and the histogram.

Defined cases: a null URL, or one without `://`, has an empty host and path and
fits no rule; its verdict is the models' (of an empty text where null).  With
labelled URLs of one verdict alone, every other URL gets that verdict; with
none, `allow`.  Of rules that fit and are equally long the last given wins; of
thresholds that are equally good the least.  Repeated rows are judged alike; an empty table gives an empty
result; result columns replace clashing ones of the input.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import fold_ascii, saved, shared_dir

#: Longest context of the models, in bytes.
ORDER = 5
#: Labelled URLs for each verdict that train, about, and the bytes that one has at most.
SAMPLE, LONGEST = 8000, 4096
#: One labelled URL in so many never trains.
HELD_OUT = 5
#: Bins of the histogram of scores for each unit, and units on either side of 0; scores beyond are in the last bins.
FINE, WIDE = 2048, 8
END = 256
CACHE = 1 << 18


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without `://`."""
    text = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return fold_ascii(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


class MarkovModel:
    """Witten-Bell smoothed byte model of contexts of 0 to `ORDER` bytes."""

    def __init__(self) -> None:
        self.next: dict[bytes, dict[int, int]] = defaultdict(dict)
        self.total: dict[bytes, int] = defaultdict(int)

    def train(self, url: bytes) -> None:
        for i in range(len(url) + 1):
            symbol = url[i] if i < len(url) else END
            for k in range(min(ORDER, i) + 1):
                context = url[i - k : i]
                seen = self.next[context]
                seen[symbol] = seen.get(symbol, 0) + 1
                self.total[context] += 1

    def log_p(self, context: bytes, symbol: int) -> float:
        p = 1 / 257
        for k in range(len(context) + 1):
            own = context[len(context) - k :]
            n = self.total.get(own)
            if n is None:
                break
            seen = self.next[own]
            p = (seen.get(symbol, 0) + len(seen) * p) / (n + len(seen))
        return math.log(p)


class RatioFilter:
    """Both models and the threshold."""

    def __init__(self) -> None:
        self.accepted, self.rejected = MarkovModel(), MarkovModel()
        self.threshold = 0.0
        self.cache: dict[tuple[bytes, int], float] = {}

    def score(self, url: str | None) -> float:
        data = (url or "").encode()
        total = 0.0
        for i in range(len(data) + 1):
            key = data[max(0, i - ORDER) : i], data[i] if i < len(data) else END
            term = self.cache.get(key)
            if term is None:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                term = self.cache[key] = self.accepted.log_p(*key) - self.rejected.log_p(*key)
            total += term
        return total / (len(data) + 1)

    @classmethod
    def fit(cls, rows: Sequence[tuple[str, str]]) -> RatioFilter:
        """rows: URL and verdict."""
        out = cls()
        for url, verdict in rows:
            (out.accepted if verdict == "allow" else out.rejected).train(url.encode())
        return out


def bin_of(score: float) -> int:
    return max(-FINE * WIDE, min(FINE * WIDE - 1, math.floor(score * FINE)))


def best_cut(histogram: Sequence[tuple[int, int, int]]) -> float:
    """The threshold with the best mean of both classes' accuracies, half way between two bins; rows: bin, accepted, rejected."""
    goods, bads = sum(g for _, g, _ in histogram), sum(b for _, _, b in histogram)
    if not goods or not bads:
        return 0.0
    rows = sorted(histogram)
    best, cut, below_good, below_bad = 1.0, rows[0][0] / FINE, 0, 0
    for k, (at, g, b) in enumerate(rows):
        below_good, below_bad = below_good + g, below_bad + b
        following = rows[k + 1][0] if k + 1 < len(rows) else at + 1
        accuracy = (goods - below_good) / goods + below_bad / bads
        if accuracy > best + 1e-12:
            best, cut = accuracy, (at + 1 + following) / 2 / FINE
    return cut


def train_ratio(pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", sample: int = SAMPLE) -> RatioFilter:
    """Fit on a bounded hash sample of the distinct URLs that the rules settle, and calibrate on all the others."""
    host, path = host_and_path(pages[url_col])
    _, verdict = matched_rule(host, path, rules)
    labelled = pages.select(pages[url_col].alias("url"), verdict.alias("verdict")).where("verdict IS NOT NULL").distinct()
    may_train = (F.xxhash64("url", F.lit(1)) % HELD_OUT != 0) & (F.octet_length("url") <= LONGEST)
    labelled = saved(labelled.withColumn("h", F.when(may_train, F.pmod(F.xxhash64("url"), F.lit(1 << 30)))), shared_dir(pages.sparkSession))
    numbers = {r["verdict"]: (r["n"], r["m"]) for r in labelled.groupBy("verdict").agg(F.count("*").alias("n"), F.count("h").alias("m")).collect()}
    if len(numbers) < 2:
        out = RatioFilter()
        out.threshold = math.inf if "block" in numbers else -math.inf
        return out
    shares = F.lit(0)
    for name, (_, n) in numbers.items():
        shares = F.when(F.col("verdict") == name, int((1 << 30) * min(1.0, sample / max(n, 1)))).otherwise(shares)
    trains = F.coalesce(F.col("h") < shares, F.lit(False))
    out = RatioFilter.fit(sorted(map(tuple, labelled.where(trains).select("url", "verdict").collect())))
    shared = pages.sparkSession.sparkContext.broadcast(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for url, verdict in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[bin_of(shared.value.score(url)), verdict] += 1
        at, verdicts = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(verdicts, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["at", "verdict", "n"])

    scored = labelled.where(~trains).select("url", "verdict").mapInArrow(run, "at int, verdict string, n long")
    n = lambda verdict: F.coalesce(F.sum(F.when(F.col("verdict") == verdict, F.col("n"))), F.lit(0))
    histogram = scored.groupBy("at").agg(n("allow").alias("g"), n("block").alias("b")).collect()  # at most 2 * FINE * WIDE rows
    out.threshold = best_cut([tuple(r) for r in histogram])
    out.cache = {}
    return out


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Id, host, path, rule, verdict and the models' score of each URL (null where a rule decides)."""
    model = train_ratio(pages, rules, url_col=url_col, sample=sample)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by `sample`
    host, path = host_and_path(pages[url_col])
    rule, verdict = matched_rule(host, path, rules)
    settled = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            verdicts = batch.column("verdict").to_pylist()
            scores: list[float | None] = [None] * len(verdicts)
            for i, url in enumerate(batch.column("url").to_pylist()):
                if verdicts[i] is None:
                    scores[i] = ratio.score(url)
                    verdicts[i] = "allow" if scores[i] >= ratio.threshold else "block"
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "host", "path", "rule", "verdict", "score"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return settled.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
