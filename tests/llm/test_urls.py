import math
import random
from collections import Counter

import pytest

from folioforge.llm import url_filters
from folioforge.llm.queries import URL_RULES
from folioforge.llm.url_filters import MarkovModel, Rule, judge_urls

RULES = [Rule(*r) for r in URL_RULES]


def frame(spark, urls):
    return spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, verdict string")


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/fr/", "example.net", "/fr/", "net/", "block"),
        ("https://www.example.com/de/x", "www.example.com", "/de/x", "example.com/de/", "block"),
        ("https://notexample.com/de/x", "notexample.com", "/de/x", None, None),
        ("ftp://b.org/fr/#f", "b.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net?q=/en/", "x.net", "", None, None),
        ("no scheme here", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("http://" + "h" * 20000 + ".net/" + "p" * 50000, "h" * 20000 + ".net", "/" + "p" * 50000, "net/", "block"),
    ]
    rows = {r["page_id"]: r for r in judge_urls(frame(spark, [c[0] for c in cases]), RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), cases[i][0]
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_the_ratio_generalises(spark):
    good = [f"http://w{i}.example.net/en/{i * 7}" for i in range(300)]
    bad = [f"http://w{i}.example.com/de/{i * 7}" for i in range(300)]
    new = [f"http://q{i}.example.org/en/{i * 13}" for i in range(50)] + [f"http://q{i}.example.edu/de/{i * 13}" for i in range(50)]
    rows = {r["page_id"]: r["verdict"] for r in judge_urls(frame(spark, good + bad + new), RULES).collect()}
    assert sum(rows[600 + i] == "allow" for i in range(50)) >= 45
    assert sum(rows[650 + i] == "block" for i in range(50)) >= 45


def test_one_class_none_and_empty(spark):
    only = judge_urls(frame(spark, ["http://a.net/x", "http://b.com/y"]), RULES).collect()
    assert {r["verdict"] for r in only} == {"block"}
    none = judge_urls(frame(spark, ["http://b.com/y", None]), RULES).collect()
    assert {r["verdict"] for r in none} == {"allow"}
    assert judge_urls(frame(spark, ["x"]).limit(0), RULES).count() == 0


def test_models_are_distributions():
    import math

    m = MarkovModel()
    for url in (b"abcab", b"abd", b"abcab"):
        m.train(url)
    for context in (b"", b"ab", b"abc", b"zz"):
        assert math.isclose(sum(math.exp(m.log_p(context, s)) for s in range(257)), 1.0, rel_tol=1e-9)


def brute_log_p(urls, context, symbol):
    """Witten-Bell by recounting: the share of a symbol after a context, interpolated with that after the shorter one."""
    if context is None:
        return 1 / 257
    after = Counter(u[i + len(context)] if i + len(context) < len(u) else 256 for u in urls for i in range(len(u) + 1 - len(context)) if u[i : i + len(context)] == context)
    below = brute_log_p(urls, context[1:] if context else None, symbol)
    n = sum(after.values())
    return (after[symbol] + len(after) * below) / (n + len(after)) if n else below


@pytest.mark.parametrize("sample", [12, 8000])
def test_verdicts_equal_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(url_filters, "HELD_OUT", 3)
    r = random.Random(4)
    urls = [f"http://{r.choice('abc')}{i % 7}.example.net/en/{r.choice(('news', 'x'))}" for i in range(40)] + [f"http://{r.choice('xyz')}.example.com/de/{r.choice(('ad', 'promo'))}{i % 5}" for i in range(40)]
    others = ["http://a1.example.edu/en/news", "http://z.example.biz/de/ad3", "no scheme", "", None, "http://q/" + "é" * 30] + [f"http://{r.choice('abcxyz')}.w.edu/{r.choice(('en', 'de'))}/{r.choice(('news', 'ad'))}" for _ in range(20)]
    given = urls + others + urls[:5]
    pages = frame(spark, given)
    model = url_filters.train_ratio(pages, RULES, sample=sample)
    rows = judge_urls(pages, RULES, sample=sample).collect()
    labelled = {u: "allow" if "/en/" in u else "block" for u in urls}
    marks = {x["url"]: (x["a"], x["b"]) for x in spark.createDataFrame([(u,) for u in labelled], "url string").selectExpr("url", "pmod(xxhash64(url), 1 << 30) AS a", "xxhash64(url, 1) % 3 <> 0 AS b").collect()}
    trains = set()
    for verdict in ("allow", "block"):
        free = [u for u, v in labelled.items() if v == verdict and marks[u][1]]
        trains |= {u for u in free if marks[u][0] < int((1 << 30) * min(1.0, sample / len(free)))}
    good, bad = ([u.encode() for u in trains if labelled[u] == v] for v in ("allow", "block"))
    assert good and bad and len(trains) < len(labelled)

    def score(url):
        data = (url or "").encode()
        terms = []
        for i in range(len(data) + 1):
            context, symbol = data[max(0, i - 5) : i], data[i] if i < len(data) else 256
            terms.append(math.log(brute_log_p(good, context, symbol)) - math.log(brute_log_p(bad, context, symbol)))
        return sum(terms) / len(terms)

    held = [(url_filters.bin_of(score(u)), v) for u, v in labelled.items() if u not in trains]
    ends = sorted({b for b, _ in held})

    def accuracy(cut):
        return sum(b / 2048 >= cut for b, v in held if v == "allow") / sum(v == "allow" for _, v in held) + sum(b / 2048 < cut for b, v in held if v == "block") / sum(v == "block" for _, v in held)

    cuts = [ends[0] / 2048] + [(a + 1 + b) / 2 / 2048 for a, b in zip(ends, [*ends[1:], ends[-1] + 1])]
    best = max(map(accuracy, cuts))
    assert math.isclose(model.threshold, next(c for c in cuts if accuracy(c) >= best - 1e-12))
    for row in rows:
        url = given[row["page_id"]]
        if url in labelled:
            assert row["verdict"] == labelled[url] and row["score"] is None
        else:
            assert math.isclose(row["score"], score(url), rel_tol=1e-9, abs_tol=1e-12) and row["verdict"] == ("allow" if score(url) >= model.threshold else "block"), url


def test_equally_long_rules(spark):
    rules = [Rule("allow", "b.org", "/x"), Rule("block", "a.b.org", ""), Rule("block", "b.org", "/x")]
    rows = judge_urls(frame(spark, ["http://a.b.org/x", "http://b.org/xy", "http://c.b.org/x"]), rules).collect()
    assert [(r["rule"], r["verdict"]) for r in sorted(rows)] == [("b.org/x", "block")] * 3
