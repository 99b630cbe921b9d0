"""Mixing sources to target weights, in DataFrame functions alone.

Documents are reduced to cells, the combinations of source, language and topic
that occur, with their tokens.  Iterative proportional fitting rakes the cells'
token weights to the target shares of each dimension in turn until all fit.  The
weights give each cell an inclusion probability, scaled so that the expected
tokens are the budget, with probabilities above one set to one and the rest
scaled up.  A document stays if a number drawn from a hash of its id is below
its cell's probability.

Documents weigh their tokens: a column of counts if `tokens` gives one (those of
a tokenizer, say), else their words, as counting with a tokenizer isn't within
DataFrame functions.

All fitting is on cells, pre-aggregated before any shuffle, so a source with a
third of all rows is a handful of rows by then.  Up to `BROADCAST` cells are
raked in windows and joined back by broadcast; more are raked by partial sums
joined back to the cells, and joined to the documents by a shuffled join.

Defined cases: a null source, language or topic is a value of its own; a null or
empty text has no tokens and is drawn like any other row of its cell; a null id
is drawn as an empty one; repeated rows stay or go together; targets for values
that don't occur are ignored and values without a target keep their share; an
empty table gives an empty result.  Extra columns are kept, whatever their
names; result columns of `mix` replace clashing ones of the input, and `draw`
returns the columns of its input alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import GAP, saved, shared_dir

#: Most rounds of fitting; it ends earlier once every share is within `CLOSE` of its target.
ROUNDS, CLOSE = 30, 1e-12
#: Rounds between two writes of the cells, so that plans stay short.
STRIDE = 3
#: Most cells that are broadcast (about 100 bytes each).
BROADCAST = 50_000
#: Default targets: observed shares to this power, scaled to one.
TEMPER = 0.7


def token_estimate(text: Column) -> Column:
    """Words of a text, as the weight of a document."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def coarse_topic(text: Column) -> Column:
    """A topic from plain signs in the whole text: legal, contact, note or prose."""
    t = F.coalesce(text, F.lit(""))
    legal = t.contains("icense") | t.contains("icence") | t.contains("ights reserved") | t.contains("opyright")
    contact = t.contains("@") | t.contains("://")
    return F.when(legal, "legal").when(contact, "contact").when(F.length(t) < 600, "note").otherwise("prose")


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the MD5 of the id as text."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def cells_of(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Tokens `t` of each combination of the dimensions in `rows` (with `mix_tokens`)."""
    return rows.groupBy(*dimensions).agg(F.sum("mix_tokens").cast("double").alias("t"))


def target_shares(cells: DataFrame, column: str, targets: DataFrame | None, folder: str, *, power: float = TEMPER) -> DataFrame:
    """`v`, `share` for each value of a dimension, scaled to one.

    `targets` has `value` and `share`; without it observed shares to `power` are
    taken.  A value without a target keeps its observed share.
    """
    sums = saved(cells.groupBy(F.col(column).alias("v")).agg(F.sum("t").alias("t")), f"{folder}/sums")
    if targets is None:
        shares = sums.select("v", F.pow("t", F.lit(power)).alias("s"))
    else:
        whole = sums.agg(F.sum("t")).first()[0] or 1.0
        known = targets.select("value", "share")
        shares = sums.join(known, F.col("v").eqNullSafe(F.col("value")), "left").select("v", F.coalesce("share", F.col("t") / whole).alias("s"))
    shares = saved(shares, f"{folder}/shares")
    scale = shares.agg(F.sum("s")).first()[0] or 1.0
    return shares.select("v", (F.col("s") / scale).alias("share"))


def _raked(cells: DataFrame, column: str, share: str, small: bool) -> DataFrame:
    """One step: weights under which the shares of one dimension are its targets (shares add up to one)."""
    mass = F.sum(F.col("w") * F.col("t"))
    if small:
        return cells.withColumn("w", F.col("w") * F.col(share) / mass.over(Window.partitionBy(column)))
    sums = cells.groupBy(F.col(column).alias("v")).agg(mass.alias("m"))
    return cells.join(sums, cells[column].eqNullSafe(F.col("v"))).withColumn("w", F.col("w") * F.col(share) / F.col("m")).drop("v", "m")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame | None], folder: str, *, broadcast: int = BROADCAST) -> DataFrame:
    """The cells with `w`, weights under which each dimension's token shares are its targets."""
    dims = list(targets)
    # tokens of a cell without any count as one, so that a value can't have a target and no weight
    cells = saved(cells.withColumn("t", F.greatest("t", F.lit(1.0))), f"{folder}/cells")
    small = cells.count() <= broadcast
    for k, (column, wanted) in enumerate(targets.items()):
        shares = target_shares(cells, column, wanted, f"{folder}/{k}")
        cells = cells.join(shares, cells[column].eqNullSafe(F.col("v")), "left").drop("v").withColumnRenamed("share", f"s{k}")
    cells = saved(cells.withColumn("w", F.lit(1.0)), f"{folder}/shared")
    mass = F.sum(F.col("w") * F.col("t"))
    for it in range(0, ROUNDS, STRIDE):
        for _ in range(STRIDE):
            for k, column in enumerate(dims):
                cells = _raked(cells, column, f"s{k}", small)
        cells = saved(cells, f"{folder}/raked-{it}")
        worst = 0.0
        for k, column in enumerate(dims):
            gap = cells.groupBy(column).agg(mass.alias("m"), F.first(f"s{k}").alias("s")).agg(F.max(F.abs(F.col("m") - F.col("s")))).first()[0]
            worst = max(worst, gap or 0.0)
        if worst < CLOSE:
            break
    return cells


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """The cells with `p`: probabilities in proportion to `w`, at most one, whose expected tokens are `budget` of all."""
    goal = budget * (cells.agg(F.sum("t")).first()[0] or 0.0)
    scale = 0.0
    while True:
        # cells that the scale so far takes whole, and what is left for the others
        whole = F.col("w") * scale >= 1
        row = cells.agg(F.sum(F.when(whole, F.col("t")).otherwise(0.0)).alias("full"), F.sum(F.when(whole, 0.0).otherwise(F.col("w") * F.col("t"))).alias("rest")).first()
        if not row["rest"]:
            break
        wider = (goal - row["full"]) / row["rest"]
        if wider <= scale * (1 + 1e-12):
            break
        scale = wider
    return cells.withColumn("p", F.least(F.lit(1.0), F.col("w") * scale))


def _drawn(
    docs: DataFrame, dimensions: Mapping[str, Column], targets: Mapping[str, DataFrame | None] | None, budget: float, tokens: Column | None, id_col: str, text_col: str, keep: Sequence[str], broadcast: int
) -> DataFrame:
    """The columns of `keep` by position (`k0`, `k1` and so on), dimensions (`d0` ...), `tokens`, `p` and `u`."""
    folder = shared_dir(docs.sparkSession)
    weight = token_estimate(docs[text_col]) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    names = [f"d{k}" for k in range(len(dimensions))]
    rows = docs.select(
        *[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *[c.alias(n) for n, c in zip(names, dimensions.values(), strict=True)], weight.alias("mix_tokens"), uniform(docs[id_col]).alias("u")
    )
    if text_col not in keep:  # a few short values for each document: counted once
        rows = saved(rows, f"{folder}/rows")
    cells = rake(cells_of(rows, names), {n: (targets or {}).get(d) for n, d in zip(names, dimensions, strict=True)}, folder, broadcast=broadcast)
    cells = saved(calibrate(cells, budget), f"{folder}/calibrated")
    drawn = cells.select(*[F.col(n).alias(f"c{k}") for k, n in enumerate(names)], "p")
    if cells.count() <= broadcast:
        drawn = F.broadcast(drawn)
    match = F.lit(True)
    for k, n in enumerate(names):
        match = match & F.col(n).eqNullSafe(F.col(f"c{k}"))
    return rows.join(drawn, match).withColumnRenamed("mix_tokens", "tokens")


def mix(
    docs: DataFrame,
    dimensions: Mapping[str, Column],
    targets: Mapping[str, DataFrame | None] | None = None,
    *,
    budget: float = 0.8,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    columns: Sequence[str] | None = None,
    broadcast: int = BROADCAST,
) -> DataFrame:
    """`columns` of `docs` (all unless given), then `mix_<dimension>`, `mix_tokens`, `mix_p` and `mix_kept`.

    `dimensions` gives each dimension's name and column; `targets` a table of
    `value` and `share`, or None for tempered observed shares.
    """
    made = [*(f"mix_{d}" for d in dimensions), "mix_tokens", "mix_p", "mix_kept"]
    keep = [c for c in (docs.columns if columns is None else columns) if c not in made]
    joined = _drawn(docs, dimensions, targets, budget, tokens, id_col, text_col, keep, broadcast)
    picked = joined.select(*[f"k{i}" for i in range(len(keep))], *[f"d{k}" for k in range(len(dimensions))], "tokens", "p", F.col("u") < F.col("p"))
    return picked.toDF(*keep, *made)


def draw(
    docs: DataFrame,
    dimensions: Mapping[str, Column],
    targets: Mapping[str, DataFrame | None] | None = None,
    *,
    budget: float = 0.8,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast: int = BROADCAST,
) -> DataFrame:
    """The documents drawn, with the columns of `docs`, whatever they are called."""
    joined = _drawn(docs, dimensions, targets, budget, tokens, id_col, text_col, docs.columns, broadcast)
    return joined.where(F.col("u") < F.col("p")).select(*[f"k{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
