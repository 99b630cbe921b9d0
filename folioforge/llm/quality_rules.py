"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule votes good, bad, or abstains.  Expectation-maximisation over the
counts of vote patterns estimates how often each rule casts each vote on good
and on bad documents; the posterior probability of good then decides, in place
of an all-must-pass filter.

Documents are reduced to one integer, the vote pattern, before anything is
shuffled, so what EM sees is a table of at most 3**8 rows, whatever the input
and however skewed it is; its posteriors join back by broadcast, which that
bound makes safe.  Feature counting stays within each row.

Defined cases: a null or empty text has no words and fails the base rules; a
text with no cased letters or no line abstains where a rule needs one, and so does
the rule on function words in a language without a list of them (null included);
repeated rows are judged alike; an empty table gives an empty result.
`apply_rules` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import GAP, saved, shared_dir, word_array

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (en, fr, de, es).
FUNCTION_WORDS = (
    "the of and to in is that it as for with on be by this was are "
    "la le de les et un une des en du que est pas au pour "
    "der die und das den von zu mit ist ein eine auf nicht im "
    "el los las del una por con para como se es y"
).split()
#: The languages that these words are of.
LANGUAGES = ("en", "fr", "de", "es")
RULES = 8
PATTERNS = 3**RULES
ROUNDS = 25
#: Share of all documents that each vote gets in advance in each class, so that no rate is zero.
SMOOTH = 1e-4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*COUNTS, "n_lines", "n_upper", "n_lower", "n_exclaim", "n_distinct", "n_function")


def count_features(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` with whole-text counts, columns `rule_n_words` and so on (`FEATURES`)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    staged = docs.withColumn("rule_t", text).withColumn("rule_w", word_array(F.col("rule_t")))
    staged = staged.withColumn(
        "rule_s",
        F.expr(
            "CASE WHEN size(rule_w) < 3 THEN array() ELSE "
            "sort_array(transform(sequence(0, size(rule_w) - 3), i -> struct(concat_ws(' ', rule_w[i], rule_w[i + 1], rule_w[i + 2]) AS g, i AS i))) END"
        ),
    )
    staged = staged.withColumn(
        "rule_s",
        F.expr("transform(filter(rule_s, (x, k) -> x.g = get(rule_s, k - 1).g OR x.g = get(rule_s, k + 1).g), x -> x.i)"),
    ).withColumn("rule_l", F.filter(F.split("rule_t", "\n"), lambda x: F.regexp_replace(x, GAP, "") != ""))
    t, w = F.col("rule_t"), F.col("rule_w")
    features = {
        "n_words": F.size(w),
        "word_chars": F.length(F.regexp_replace(t, GAP, "")),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.size("rule_l") - F.size(F.array_distinct("rule_l")),
        "n_repeat_words": F.expr("size(array_distinct(flatten(array(rule_s, transform(rule_s, x -> x + 1), transform(rule_s, x -> x + 2)))))"),
        "n_lines": F.size("rule_l"),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "n_lower": F.length(F.regexp_replace(t, r"[^\p{Ll}]+", "")),
        "n_exclaim": F.length(F.regexp_replace(t, "[^!]+", "")),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_function": F.when(docs[lang_col].isin(*LANGUAGES), F.size(F.array_intersect(w, F.array(*map(F.lit, FUNCTION_WORDS))))),
    }
    # A term that is always 0 but not deterministic to Catalyst: else it would push filters on the
    # counts through this projection, and copy the word arrays into every use inside lambdas.
    features["n_words"] = features["n_words"] + F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    # columns and not a struct, for the expressions of a struct are copied into every use of its fields
    return staged.select(*docs.columns, *[c.cast("long").alias(f"rule_{n}") for n, c in features.items()])


def votes() -> list[Column]:
    """The rules' votes: 2 good, 0 bad, 1 abstains."""
    f = {n: F.col(f"rule_{n}") for n in FEATURES}

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 2).otherwise(1)

    n = f["n_words"]
    cased = f["n_upper"] + f["n_lower"]
    return [
        rule(f["n_symbols"] * 10 > n, f["n_symbols"] * 50 <= n),
        rule(f["n_upper"] * 2 > cased, (f["n_upper"] * 5 < cased)),
        rule(f["n_repeat_words"] * 10 > n * 3, f["n_repeat_words"] * 10 <= n),
        rule((f["n_lines"] >= 4) & (f["n_dup_lines"] * 10 > f["n_lines"] * 3), (f["n_lines"] >= 2) & (f["n_dup_lines"] == 0)),
        rule(f["n_function"] <= 1, f["n_function"] >= 3),
        rule(f["n_exclaim"] * 5 > n, f["n_exclaim"] * 50 <= n),
        rule(f["n_distinct"] * 8 < F.least(n, F.lit(1000)), f["n_distinct"] * 3 > F.least(n, F.lit(1000))),
        rule((f["word_chars"] < n * 3) | (f["word_chars"] > n * 11), (f["word_chars"] >= n * 4) & (f["word_chars"] <= n * 9)),
    ]


def pattern() -> Column:
    """All votes as one number in base 3, first rule lowest."""
    total = F.lit(0)
    for k, vote in enumerate(votes()):
        total = total + vote * 3**k
    return total.cast("int")


def base_failed() -> Column:
    return F.expr("rule_n_words < 50 OR rule_n_repeat_words * 100 > rule_n_words * 50")


def posteriors(patterns: DataFrame) -> DataFrame:
    """From rows of `rule_p` the posterior of good, `rule_good`, for each pattern met."""
    counts = patterns.groupBy("rule_p").agg(F.count("*").cast("double").alias("n"))
    # at most PATTERNS rows: one array of them is bounded whatever the input
    packed = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("rule_p", "n"))).alias("t")).where("size(t) > 0")
    digits = f"transform(sequence(0, {RULES - 1}), j -> CAST(floor(x.rule_p / pow(3, j)) AS INT) % 3)"
    packed = packed.selectExpr(
        "t",
        f"transform(t, x -> {digits}) AS d",
        f"{SMOOTH} * aggregate(t, 0D, (a, x) -> a + x.n) AS s",
    )
    start = packed.selectExpr(
        "t", "d", "s",
        # no bad vote: surely good; one: rather bad; more: bad
        "transform(d, v -> CASE size(filter(v, y -> y = 0)) WHEN 0 THEN 0.95D WHEN 1 THEN 0.3D ELSE 0.05D END) AS q0",
    )
    mass = "aggregate(zip_with(t, q, (x, y) -> x.n * {y}), 0D, (a, x) -> a + x)"
    part = "aggregate(sequence(0, size(t) - 1), 0D, (a, i) -> a + CASE WHEN d[i][j] = v THEN t[i].n * {y} ELSE 0D END)"
    ratio = (
        f"ln(({part.format(y='q[i]')} + s) / ({mass.format(y='y')} + 3 * s))"
        f" - ln(({part.format(y='(1 - q[i])')} + s) / ({mass.format(y='(1 - y)')} + 3 * s))"
    )
    table = f"transform(sequence(0, {RULES - 1}), j -> transform(sequence(0, 2), v -> {ratio}))"
    prior = f"ln(({mass.format(y='y')} + s) / ({mass.format(y='(1 - y)')} + s))"
    # `m` is an array of one struct, so that the rates are worked out once a round
    step = (
        f"flatten(transform(array(struct({table} AS r, {prior} AS p)), m -> "
        f"transform(d, v -> 1 / (1 + exp(-(m.p + aggregate(sequence(0, {RULES - 1}), 0D, (a, j) -> a + m.r[j][v[j]])))))))"
    )
    ended = start.selectExpr("t", f"aggregate(sequence(1, {ROUNDS}), q0, (q, it) -> {step}) AS q")
    return ended.selectExpr("inline(zip_with(t, q, (x, y) -> struct(x.rule_p AS rule_p, y AS rule_good)))")


def judge(features: DataFrame) -> DataFrame:
    """From rows of `count_features`: adds `rule_p`, `rule_good`, `rule_base_failed` and `rule_kept`."""
    voted = features.withColumn("rule_p", pattern())
    good = posteriors(voted.select("rule_p"))
    judged = voted.join(F.broadcast(good), "rule_p").withColumn("rule_base_failed", base_failed())
    return judged.withColumn("rule_kept", ~F.col("rule_base_failed") & (F.col("rule_good") >= 0.5))


def apply_rules(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with the columns of `docs`."""
    renamed = docs.toDF(*[f"doc_{k}" for k in range(len(docs.columns))])  # no name can clash with the rules' own
    counted = count_features(renamed, text_col=f"doc_{docs.columns.index(text_col)}", lang_col=f"doc_{docs.columns.index(lang_col)}")
    # counted once: the fit and the verdict need no more than the pattern and the base rules
    voted = saved(counted.select(*renamed.columns, pattern().alias("rule_p"), base_failed().alias("rule_base_failed")), shared_dir(docs.sparkSession))
    judged = voted.join(F.broadcast(posteriors(voted.select("rule_p"))), "rule_p")
    return judged.where(~F.col("rule_base_failed") & (F.col("rule_good") >= 0.5)).select(*renamed.columns).toDF(*docs.columns)
