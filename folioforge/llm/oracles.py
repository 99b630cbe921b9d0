"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from folioforge.llm import quality_rules as q
from folioforge.llm import source_mixing as m


def quality_rules_ctes(docs: str = "documents") -> str:
    """CTEs `counted` (counts, pattern) and `good` (posterior for each pattern) over table `docs`."""
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(q.FUNCTION_WORDS))
    langs = ", ".join(f"'{x}'" for x in q.LANGUAGES)
    n = q.RULES

    def rule(bad: str, good: str) -> str:
        return f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 2 ELSE 1 END"

    rules = [
        rule("n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
        rule("n_upper * 2 > n_upper + n_lower", "n_upper * 5 < n_upper + n_lower"),
        rule("n_repeat_words * 10 > n_words * 3", "n_repeat_words * 10 <= n_words"),
        rule("n_lines >= 4 AND n_dup_lines * 10 > n_lines * 3", "n_lines >= 2 AND n_dup_lines = 0"),
        rule("n_function <= 1", "n_function >= 3"),
        rule("n_exclaim * 5 > n_words", "n_exclaim * 50 <= n_words"),
        rule("n_distinct * 8 < least(n_words, 1000)", "n_distinct * 3 > least(n_words, 1000)"),
        rule("word_chars < n_words * 3 OR word_chars > n_words * 11", "word_chars >= n_words * 4 AND word_chars <= n_words * 9"),
    ]
    code = " + ".join(f"({r}) * {3**k}" for k, r in enumerate(rules))
    mass = "list_sum(list_transform(range(1, len(n) + 1), lambda i: n[i] * {}))"
    part = "list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN d[i][j] = v THEN n[i] * {} ELSE 0 END))"
    ratio = (
        f"ln(({part.format('q[i]')} + s) / ({mass.format('q[i]')} + 3 * s))"
        f" - ln(({part.format('(1 - q[i])')} + s) / ({mass.format('(1 - q[i])')} + 3 * s))"
    )
    return f"""
texts AS (SELECT doc_id, lang, coalesce(text, '') AS t, row_number() OVER () AS k FROM {docs}),
worded AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS l FROM texts),
places AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM worded),
windows AS (SELECT k, i, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM places WINDOW o AS (PARTITION BY k ORDER BY i)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS m FROM windows WHERE c IS NOT NULL) WHERE m > 1),
covered AS (SELECT k, count(DISTINCT i) AS n_repeat_words FROM (SELECT k, i FROM twice UNION ALL SELECT k, i + 1 FROM twice UNION ALL SELECT k, i + 2 FROM twice) GROUP BY k),
featured AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{{Ll}}]+', '', 'g')) AS n_lower,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim, len(list_distinct(w)) AS n_distinct,
    CASE WHEN lang IN ({langs}) THEN len(list_filter([{words}], lambda x: list_contains(w, x))) END AS n_function
    FROM worded LEFT JOIN covered USING (k)),
counted AS (SELECT *, {code} AS p FROM featured),
packed AS (SELECT list(p ORDER BY p) AS p, list(n ORDER BY p) AS n, {q.SMOOTH} * sum(n) AS s,
    list(list_transform(range(0, {n}), lambda j: (p // CAST(pow(3, j) AS BIGINT)) % 3) ORDER BY p) AS d
    FROM (SELECT p, CAST(count(*) AS DOUBLE) AS n FROM counted GROUP BY p)),
em AS (SELECT 0 AS it, p, n, s, d,
    list_transform(d, lambda x: CASE len(list_filter(x, lambda y: y = 0)) WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.05::DOUBLE END) AS q FROM packed
  UNION ALL
  SELECT it + 1, p, n, s, d, list_transform(d, lambda x: 1 / (1 + exp(-(g + list_sum(list_transform(range(1, {n} + 1), lambda j: r[j][x[j] + 1])))))) FROM (
    SELECT *, list_transform(range(1, {n} + 1), lambda j: list_transform(range(0, 3), lambda v: {ratio})) AS r,
      ln(({mass.format('q[i]')} + s) / ({mass.format('(1 - q[i])')} + s)) AS g FROM em WHERE it < {q.ROUNDS})),
good AS (SELECT unnest(p) AS p, unnest(q) AS good FROM em WHERE it = {q.ROUNDS})"""


def quality_rules_sql() -> str:
    return f"""WITH RECURSIVE {quality_rules_ctes()}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND good >= 0.5 AS kept
FROM counted JOIN good USING (p)"""


def source_mixing_sql(budget: float = 0.8) -> str:
    """Fitting as a recursion over the cells; the scale as the least one with k cells taken whole that is consistent."""
    steps = [f"w * s_{d} / sum(w * t) OVER (PARTITION BY {d})" for d in ("source", "lang", "topic")]
    shares = ", ".join(f"{d}_shares AS (SELECT {d}, pow(sum(t), {m.TEMPER}) / sum(pow(sum(t), {m.TEMPER})) OVER () AS s_{d} FROM cells GROUP BY {d})" for d in ("source", "lang", "topic"))
    return f"""WITH RECURSIVE rows AS (SELECT doc_id, source, lang,
    CASE WHEN contains(x, 'icense') OR contains(x, 'icence') OR contains(x, 'ights reserved') OR contains(x, 'opyright') THEN 'legal'
      WHEN contains(x, '@') OR contains(x, '://') THEN 'contact'
      WHEN length(x) < 600 THEN 'note' ELSE 'prose' END AS topic,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n_tokens,
    ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
cells AS (SELECT source, lang, topic, greatest(sum(n_tokens)::DOUBLE, 1.0) AS t FROM rows GROUP BY ALL),
{shares},
fit AS (SELECT 0 AS it, source, lang, topic, t, s_source, s_lang, s_topic, 1.0::DOUBLE AS w
    FROM cells JOIN source_shares USING (source) JOIN lang_shares USING (lang) JOIN topic_shares USING (topic)
  UNION ALL
  SELECT it + 1, source, lang, topic, t, s_source, s_lang, s_topic, {steps[2]} FROM (SELECT * REPLACE ({steps[1]} AS w) FROM (SELECT * REPLACE ({steps[0]} AS w) FROM fit WHERE it < {m.ROUNDS}))),
raked AS (SELECT * FROM fit WHERE it = {m.ROUNDS}),
ordered AS (SELECT *, row_number() OVER (ORDER BY w DESC, source, lang, topic) AS place, coalesce(sum(t) OVER above, 0) AS taken, sum(w * t) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    {budget} * sum(t) OVER () AS goal FROM raked WINDOW above AS (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scale AS (SELECT arg_min((goal - taken) / rest, place) FILTER (WHERE (goal - taken) / rest * w < 1) AS k FROM ordered)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(least(1.0, w * k), 6) AS p, u < least(1.0, w * k) AS kept
FROM rows JOIN raked USING (source, lang, topic) CROSS JOIN scale"""


def parity_join_sql(n: int = 4, percent: int = 85) -> str:
    """All pairs that share a shingle, and everything reachable by links: plain, for tables of test size."""
    window = " || ' ' || ".join(f"l[i + {k}]" for k in range(n))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) < {n} THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - {n - 2}), lambda i: {window}) END) AS g FROM w WHERE len(l) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {percent} * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS v, doc_id AS l FROM documents UNION SELECT v, y FROM reach JOIN both_ways ON l = x)
SELECT v AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(l) AS component_id FROM reach LEFT JOIN n ON n.doc_id = v GROUP BY v"""
