"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are the bytes of UTF-8, so every script keeps its characters
apart.  Counts of n-grams of trusted documents are sharded by n-gram and
language; joins of each order's counts with their contexts and with the order
below give smoothed probabilities, written as sharded tables.  A document's
perplexity comes from a join of its n-grams with these tables, and is held
against a quantile of the perplexities of its language's trusted documents that
didn't train.

There are two ways to join.  `score_by_join` resolves the corpus' distinct
n-grams by shuffled joins with the tables of each order and joins the answers to
the documents' own n-grams.  `score` does the same look-ups where documents are
read, against the tables as sorted arrays; it is taken only if they have at most
`BROADCAST` rows, as a shuffle of every document's n-grams is many times the
input.  Both give the same perplexities.

Every trusted document has a part: one in `HELD_OUT`, by hash of the id, never
trains and sets thresholds, all others train.  (Callers may have fewer train, by
`sample`, in equal parts for each language; the rest then set thresholds too.)
Languages with fewer than `OWN` trusted documents to train on, and null, share a
pooled model of all languages.  Thresholds are the `UPPER` quantile over all
trusted documents that didn't train, for each language as scored by the model
that judges it; where there are none, over the language's trusted documents, and
if it has none at all, over all of them.

Defined cases: a null or empty text is an end mark alone (`n_bytes` 0) and is
kept; with no trusted documents everything is kept; repeated rows are judged
alike; an empty table gives an empty result; `keep_good` returns the columns of
its input, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import presence, present, saved, shared_dir

#: Order of the model, in bytes.
ORDER = 5
#: One trusted document in so many never trains.
HELD_OUT = 5
#: Trusted documents from which a language has a model of its own.
OWN = 40
#: Kept documents have at most this quantile of their language's trusted log perplexities.
UPPER = 0.99
#: Rows of the model's tables (12 bytes each) up to which they are broadcast.
BROADCAST = 8_000_000
POOLED = ""
#: Symbols that no UTF-8 text has.
START, END = 0xFE, 0xFF
#: Bytes of text that are scored at once.
BLOCK = 1 << 20
#: N-grams and their counts that a task holds before it passes them on.
HELD = 2_000_000

UNIFORM = 1.0 / 255


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every byte and end mark of all texts, packed in a number, and where each text begins."""
    parts, starts, at = [], [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        parts += [bytes([START]) * (ORDER - 1), data, bytes([END])]
        starts.append(at)
        at += len(data) + 1
    s = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(len(s) - ORDER + 1, np.int64)
    for k in range(ORDER):
        grams = grams << 8 | s[k : k + len(grams)]
    # what ends in a start mark isn't predicted
    return grams[s[ORDER - 1 :] != START], np.array(starts, np.int64)


def _blocks(rows: list[int], texts: pa.Array) -> Iterator[list[int]]:
    block: list[int] = []
    size = 0
    for i in rows:
        block.append(i)
        size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if size > BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


# -- training -------------------------------------------------------------------


def _quotas(numbers: dict[str, int], sample: int | None) -> dict[str, int]:
    """Equal parts of `sample`, what one hasn't going to the others, and `OWN` at least."""
    quotas, left = {}, sum(numbers.values()) if sample is None else sample
    for k, (lang, n) in enumerate(sorted(numbers.items(), key=lambda x: (x[1], x[0]))):
        quotas[lang] = n if sample is None else min(n, max(OWN, left // (len(numbers) - k)))
        left -= quotas[lang]
    return quotas


def _named(langs: list[str]) -> Column:
    """The language of the model that judges a document."""
    return F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(F.lit(POOLED))


def trusted_roles(docs: DataFrame, trusted: DataFrame, folder: str, *, sample: int | None = None) -> tuple[DataFrame, list[str]]:
    """`doc_id`, `trains` of each trusted document, and the languages with a model of their own.

    For each language those of least hash train; `trusted` has `doc_id`.
    """
    ids = docs.select("doc_id", "lang").join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    ids = saved(ids.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")), f"{folder}/trusted")
    free = F.col("h") % HELD_OUT != 0
    langs = sorted(r["lang"] for r in ids.where(free).groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= OWN).collect() if r["lang"])
    ids = ids.withColumn("lang", _named(langs))
    numbers = {r["lang"]: r["n"] for r in ids.where(free).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    quota, most = F.lit(0), F.lit(0)
    for name, k in _quotas(numbers, sample).items():
        quota = F.when(F.col("lang") == name, k).otherwise(quota)
        # by their hashes some more than the quota stay to be ranked, however many there are
        most = F.when(F.col("lang") == name, int((1 << 30) * min(1.0, (k + 8 * k**0.5 + 20) / numbers[name]))).otherwise(most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    if sample is None:
        chosen = ids.where(free).select("doc_id")
    else:
        chosen = ids.where(free & (F.col("h") < most)).withColumn("rank", rank).where(F.col("rank") <= quota).select("doc_id")
    roles = ids.select("doc_id").distinct().join(chosen.distinct().withColumn("trains", F.lit(True)), "doc_id", "left")
    return saved(roles.select("doc_id", F.coalesce("trains", F.lit(False)).alias("trains")), f"{folder}/roles"), langs


def _training_texts(docs: DataFrame, chosen: DataFrame, langs: list[str], *, bounded: bool) -> DataFrame:
    """`lang` (of the model) and `text` of the documents that `chosen` names.

    Unless their ids are few enough to be broadcast, the join shuffles texts; a bitmap of the ids spares it most of the others.
    """
    picked = docs.select("doc_id", _named(langs).alias("lang"), "text")
    if bounded:
        return picked.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
    bitmap = presence(chosen.select(F.xxhash64("doc_id").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(present(bitmap, batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays(found.columns[1:], names=["doc_id", "lang", "text"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, text string"
    likely = picked.select(F.xxhash64("doc_id"), "doc_id", "lang", "text").mapInArrow(run, schema)
    return likely.join(chosen.hint("shuffle_hash"), "doc_id", "left_semi").select("lang", "text")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all parts in order, and their counts added up."""
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    return grams[first], np.add.reduceat(counts[order], first) if len(first) else counts


def count_batches(batches: Iterable[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """`lang`, `gram` and `c` of batches of languages and texts; an n-gram comes again once more than `held` were met."""
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang in sorted(parts):
            grams, counts = _added(parts.pop(lang))
            for k in range(0, len(grams), 1 << 16):
                gram, c = pa.array(grams[k : k + (1 << 16)]), pa.array(counts[k : k + (1 << 16)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), gram, c], names=["lang", "gram", "c"])

    n = 0
    for batch in batches:
        langs, column = batch.column(0).to_pylist(), batch.column(1)
        for lang in sorted(set(langs)):
            for block in _blocks([i for i, x in enumerate(langs) if x == lang], column):
                parts.setdefault(lang, []).append(np.unique(grams_of([column[i].as_py() for i in block])[0], return_counts=True))
                n += len(parts[lang][-1][0])
                if n > held:
                    parts |= {x: [_added(p)] for x, p in parts.items()}
                    n = sum(len(p[0][0]) for p in parts.values())
                    if n > held // 2:
                        yield from passed_on()
                        n = 0
    yield from passed_on()


def _counts(texts: DataFrame, folder: str, *, pooled: bool) -> DataFrame:
    """`lang`, `gram` and its count `c`, for every language with a model of its own and, if asked for, for all pooled."""
    met = texts.select("lang", "text").mapInArrow(lambda batches: count_batches(batches), "lang string, gram long, c long")
    met = saved(met.groupBy("lang", "gram").agg(F.sum("c").alias("c")), f"{folder}/met")
    own = met.where(F.col("lang") != POOLED)
    every = met.groupBy("gram").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "gram", "c")
    return own.union(every) if pooled else own


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each language: `d1`, `d2`, `d3`."""
    met = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    n = counts.groupBy("lang").agg(*met).withColumn("y", F.expr("n1 / greatest(n1 + 2 * n2, 1)"))
    d = {k: F.expr(f"CASE WHEN n{k} > 0 AND n{k + 1} > 0 THEN least(greatest({k} - {k + 1} * y * n{k + 1} / n{k}, 0.1), {k}) ELSE {k} * 0.5 END") for k in (1, 2, 3)}
    return n.select("lang", *[d[k].alias(f"d{k}") for k in d])


def _order(counts: DataFrame, below: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Probabilities (`lang`, `gram`, `p`) of the n-grams of order k and back-off weights (`lang`, `ctx`, `g`)."""
    least = F.expr("CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END")
    taken = counts.join(F.broadcast(_discounts(counts)), "lang").withColumn("d", least).withColumn("ctx", F.shiftright("gram", 8))
    contexts = taken.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
    weights = contexts.select("lang", "ctx", (F.col("freed") / F.col("total")).alias("g"))
    joined = taken.join(contexts, ["lang", "ctx"]).withColumn("suffix", F.expr(f"gram & {256 ** (k - 1) - 1}L"))
    lower = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
    p = F.expr("(c - d) / total + freed / total * q")
    return joined.join(lower, ["lang", "suffix"]).select("lang", "gram", p.alias("p")), weights


class Model(NamedTuple):
    """A trained model's tables: probabilities and back-off weights of each order, sharded by n-gram."""

    langs: list[str]
    roles: DataFrame
    orders: list[tuple[DataFrame, DataFrame]]
    #: Rows of all tables.
    rows: int

    def arrays(self) -> Tables:
        """The tables as sorted arrays; only for models of at most `BROADCAST` rows."""
        names = [*self.langs, POOLED]
        code = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1
        out: dict[str, list[tuple[np.ndarray, ...]]] = {name: [] for name in names}

        def split(table: DataFrame, key: str, value: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            rows = table.select(code.alias("m"), F.col(key), F.col(value).cast("float")).toArrow()
            m, keys, values = (rows.column(k).to_numpy() for k in range(3))
            order = np.lexsort((keys, m))
            edges = np.searchsorted(m[order], np.arange(len(names) + 1))
            for a, b in zip(edges, edges[1:], strict=False):
                yield keys[order[a:b]], values[order[a:b]]

        for p, weights in self.orders:
            for name, own, w in zip(names, split(p, "gram", "p"), split(weights, "ctx", "g"), strict=True):
                out[name].append((*own, *w))
        return Tables({name: orders for name, orders in out.items() if len(orders[0][0])})


def train(docs: DataFrame, trusted: DataFrame, *, sample: int | None = None, pooled: bool = True) -> Model | None:
    """Train on trusted documents; None if there are none to train on.

    Without `pooled`, the model of all languages is made only if a document of `docs` is judged by it.
    """
    folder = shared_dir(docs.sparkSession)
    roles, langs = trusted_roles(docs, trusted, folder, sample=sample)
    chosen = roles.where("trains").select("doc_id")
    if chosen.isEmpty():
        return None
    pooled = pooled or not docs.where(_named(langs) == POOLED).isEmpty()
    texts = _training_texts(docs, chosen, langs, bounded=sample is not None)
    counts = {ORDER: saved(_counts(texts, folder, pooled=pooled), f"{folder}/counts-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        # lower orders count the different symbols before them
        shorter = counts[k + 1].groupBy("lang", F.expr(f"gram & {256**k - 1}L").alias("gram")).agg(F.count("*").alias("c"))
        counts[k] = saved(shorter, f"{folder}/counts-{k}")
    below = counts[1].select("lang").distinct().select("lang", F.lit(0).cast("long").alias("gram"), F.lit(UNIFORM).alias("p"))
    orders = []
    for k in range(1, ORDER + 1):
        p, weights = _order(counts[k], below, k)
        below = saved(p, f"{folder}/p-{k}")
        orders.append((below, saved(weights, f"{folder}/g-{k}")))
    return Model(langs, roles, orders, reduce(DataFrame.union, [t.select("lang") for pair in orders for t in pair]).count())


# -- scoring --------------------------------------------------------------------


class Tables:
    """Of each language, for each order: n-grams in order, their probabilities, contexts in order, their weights."""

    def __init__(self, levels: dict[str, list[tuple[np.ndarray, ...]]]) -> None:
        self.levels = levels

    def resolve(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's last symbol after the others: orders are joined from the lowest up."""
        p = np.full(len(grams), UNIFORM)
        for k, (known, probabilities, contexts, weights) in enumerate(self.levels[lang], 1):
            suffix = grams & np.int64(256**k - 1)
            context = suffix >> 8
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            p = np.where(contexts[at] == context, weights[at], 1.0) * p
            at = np.minimum(np.searchsorted(known, suffix), len(known) - 1)
            p = np.where(known[at] == suffix, probabilities[at], p)
        return p

    def score(self, lang: str | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and log perplexity of each text."""
        grams, starts = grams_of(texts)
        distinct, inverse = np.unique(grams, return_inverse=True)
        logs = np.log(self.resolve(lang if lang in self.levels else POOLED, distinct))[inverse]
        sizes = np.diff(np.append(starts, len(grams)))
        return sizes - 1, -np.add.reduceat(logs, starts) / sizes


def score(docs: DataFrame, tables: Broadcast, *, keep: list[str]) -> DataFrame:
    """The columns of `keep` by position (`k0`, `k1` and so on), then `n_bytes` and `log_perplexity`."""
    picked = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["lang"].alias("v0"), docs["text"].alias("v1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(len(keep)).to_pylist()
            texts = batch.column(len(keep) + 1)
            sizes, logs = np.zeros(len(langs), np.int64), np.zeros(len(langs))
            for lang in set(langs):
                for block in _blocks([i for i, x in enumerate(langs) if x == lang], texts):
                    sizes[block], logs[block] = tables.value.score(lang, [texts[i].as_py() for i in block])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(sizes), pa.array(logs)], names=[*(f"k{i}" for i in range(len(keep))), "n_bytes", "log_perplexity"])

    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["n_bytes long", "log_perplexity double"])
    return picked.mapInArrow(run, schema)


def score_by_join(docs: DataFrame, model: Model, *, keep: list[str]) -> DataFrame:
    """As `score`, by shuffled joins of the documents' distinct n-grams with the model's tables."""
    lang = _named(model.langs)
    keyed = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs["lang"].alias("lang"), docs["text"].alias("text"))
    # equal texts of a language have equal perplexities, so a text is named by a digest
    keyed = keyed.select(*[f"k{i}" for i in range(len(keep))], lang.alias("m"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("d"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, d, text in zip(*batch.columns, strict=True):
                grams, counts = np.unique(grams_of([text.as_py()])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([m.as_py()] * len(grams)), pa.array([d.as_py()] * len(grams)), pa.array(grams), pa.array(counts, pa.int64())], names=["lang", "d", "gram", "c"])

    met = keyed.select("m", "d", "text").mapInArrow(run, "lang string, d string, gram long, c long")
    # copies send the same rows; one of each is enough
    met = met.groupBy("lang", "d", "gram").agg(F.first("c").alias("c"))
    asked = met.select("lang", "gram").distinct().withColumn("p", F.lit(UNIFORM))
    for k, (p, weights) in enumerate(model.orders, 1):
        asked = asked.withColumn("suffix", F.expr(f"gram & {256**k - 1}L")).withColumn("ctx", F.shiftright("suffix", 8))
        known = p.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
        asked = asked.join(weights, ["lang", "ctx"], "left").join(known, ["lang", "suffix"], "left")
        asked = asked.select("lang", "gram", F.coalesce("q", F.coalesce("g", F.lit(1.0)) * F.col("p")).alias("p"))
    sums = met.join(asked, ["lang", "gram"]).groupBy("lang", "d").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("p")).alias("l"))
    sums = sums.select(F.col("lang").alias("m"), "d", (F.col("n") - 1).alias("n_bytes"), (-F.col("l") / F.col("n")).alias("log_perplexity"))
    return keyed.drop("text").join(sums, ["m", "d"]).drop("m", "d")


class Scorer:
    """Scores with a model's tables, broadcast or joined by their size."""

    def __init__(self, docs: DataFrame, model: Model, broadcast: int) -> None:
        self.model, self.tables = model, None
        if model.rows <= broadcast:
            self.tables = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def __call__(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        return score_by_join(docs, self.model, keep=keep) if self.tables is None else score(docs, self.tables, keep=keep)


def thresholds(scores: DataFrame, model: Model, *, upper: float = UPPER) -> dict[str, float]:
    """Largest log perplexity that is kept, for each language of the model and pooled, where trusted documents were scored.

    `scores` has `doc_id`, `lang`, `n_bytes` and `log_perplexity` of documents.
    """
    good = scores.where("n_bytes > 0").join(model.roles, "doc_id").select(_named(model.langs).alias("lang"), "trains", "log_perplexity")
    at = F.percentile_approx(F.when(~F.col("trains"), F.col("log_perplexity")), upper, 10000)
    found = good.groupBy("lang").agg(F.coalesce(at, F.percentile_approx("log_perplexity", upper, 10000)).alias("q")).collect()
    return {r["lang"]: r["q"] for r in found}


def _limits(docs: DataFrame, scores: DataFrame, scorer: Scorer, upper: float) -> dict[str, float]:
    """`thresholds`; if the pooled model judges documents but no trusted one, its threshold is that of all as it scores them."""
    limits = thresholds(scores, scorer.model, upper=upper)
    others = F.coalesce(~F.col("lang").isin(scorer.model.langs), F.lit(True))
    if POOLED not in limits and not scores.where(others).isEmpty():
        good = docs.join(scorer.model.roles, "doc_id", "left_semi").select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
        limits |= thresholds(scorer(good, ["doc_id", "lang"]).toDF("doc_id", "lang", "n_bytes", "log_perplexity"), scorer.model, upper=upper)
    return limits


def _threshold(limits: dict[str, float], lang: Column) -> Column:
    most = F.lit(limits.get(POOLED, float("inf")))
    for name, limit in limits.items():
        if name:
            most = F.when(lang == name, F.lit(limit)).otherwise(most)
    return most


def classify(docs: DataFrame, trusted: DataFrame, *, sample: int | None = None, upper: float = UPPER, broadcast: int = BROADCAST) -> DataFrame:
    """`doc_id`, `lang`, `n_bytes`, `log_perplexity`, `threshold` and `kept` of each document."""
    model = train(docs, trusted, sample=sample, pooled=False)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), nothing.alias("log_perplexity"), nothing.alias("threshold"), F.lit(True).alias("kept"))
    scorer = Scorer(docs, model, broadcast)
    scores = scorer(docs, ["doc_id", "lang"]).toDF("doc_id", "lang", "n_bytes", "log_perplexity")
    scores = saved(scores, shared_dir(docs.sparkSession))
    limits = _limits(docs, scores, scorer, upper)
    return scores.withColumn("threshold", _threshold(limits, F.col("lang"))).withColumn("kept", (F.col("n_bytes") == 0) | (F.col("log_perplexity") <= F.col("threshold")))


def keep_good(docs: DataFrame, trusted: DataFrame, *, sample: int | None = None, upper: float = UPPER, broadcast: int = BROADCAST) -> DataFrame:
    """The documents within their language's threshold, with the columns of `docs`.

    Scores are written without the texts for the thresholds, which need all of
    them; then documents are scored again, as a copy of all texts costs more disk.
    """
    model = train(docs, trusted, sample=sample, pooled=False)
    if model is None:
        return docs
    scorer = Scorer(docs, model, broadcast)
    scores = scorer(docs, ["doc_id", "lang"]).toDF("doc_id", "lang", "n_bytes", "log_perplexity")
    limits = _limits(docs, saved(scores, shared_dir(docs.sparkSession)), scorer, upper)
    most = _threshold(limits, F.col(f"k{docs.columns.index('lang')}"))
    kept = scorer(docs, docs.columns).where((F.col("n_bytes") == 0) | (F.col("log_perplexity") <= most))
    return kept.select(*[f"k{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
