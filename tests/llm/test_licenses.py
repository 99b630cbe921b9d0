import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.llm.license_scans import LEAST, TEMPLATES, Matcher, idf, inherit, match_files, named, notices, terms

from .conftest import TEXTS, prose

APACHE, MIT, GPL = TEMPLATES["Apache-2.0"][0], TEMPLATES["MIT"][0], TEMPLATES["GPL-3.0"][0]


def brute(texts):
    """Licence and cosine of each text: every statement against every template, with frequencies counted over all texts."""
    files = len(texts)
    df = Counter(t for x in texts for t in set(terms((x or "").lower())))
    weight = lambda counts: {t: n * idf(df[t], files) for t, n in counts.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, weight(counts)) for name, counts in notices(TEMPLATES)]
    out = []
    for text in texts:
        lines = [terms(x) for x in (text or "").lower().split("\n")]
        blocks, block = [], []
        for counts in [*lines, Counter()]:
            if counts:
                block.append(counts)
            elif block:
                blocks.append(sum(block, Counter()))
                block = []
        best, name = 0.0, None
        for counts in [*lines, *blocks, sum(lines, Counter())]:
            v = weight(counts)
            for which, t in vectors:
                if v:
                    x = sum(t[k] * v[k] for k in t if k in v) / norm(t) / norm(v)
                    if x > best + 1e-9:
                        best, name = x, which
        out.append((name, round(best, 6)) if best >= LEAST else (None, 0.0))
    return out


def notice_texts():
    wrapped = "\n".join(f" * {x}" for x in TEMPLATES["GPL-3.0"][1].replace(". ", ".\n").split("\n"))
    return [
        prose(1, 50) + "\n" + APACHE,
        prose(2, 80),
        "x\n" + MIT,
        prose(5, 40) + "\n  all RIGHTS reserved.\n" + prose(6, 10),
        None,
        "",
        prose(7, 20000) + "\n" + GPL,
        wrapped + " " * 50_000,
        wrapped + "\n\n" + prose(8, 9000),
        TEMPLATES["MIT"][1],
        "MIT License\n\n" + TEMPLATES["MIT"][1].replace(". ", ".\n"),
        "# SPDX-License-Identifier:   BSD-3-Clause\n" + prose(9, 30),
        "// SPDX-License-Identifier: GPL-2.0-or-later",
        "// SPDX-License-Identifier: Unheard-Of-1.0",
        "licensed under",
        "This document is " + APACHE + " " + "zorp quux",
        "the license " * 40,
        *[prose(20 + k, 30) + "\n" + (APACHE, MIT, GPL, "Licensed under CC BY-NC 4.0.")[k % 4] for k in range(24)],
        *[prose(60 + k, 40) for k in range(40)],
        "copyright 2001 by wolfram\n" + "Licensed under CC BY 4.0. by wolfram and sons, " + prose(90, 3),
    ]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 16])
def test_scan_equals_brute_force(spark, frequent):
    texts = notice_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: (r["license"], round(r["cosine"], 6)) for r in match_files(df, frequent=frequent).collect()}
    expected = brute(texts)
    for k, text in enumerate(texts):
        assert rows[k][0] == expected[k][0] and math.isclose(rows[k][1], expected[k][1], abs_tol=2e-6), (k, (text or "")[:60], rows[k], expected[k])
    assert [rows[k][0] for k in (0, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13, 14)] == ["Apache-2.0", "MIT", "Proprietary", "GPL-3.0", "GPL-3.0", "GPL-3.0", "MIT", "MIT", "BSD-3-Clause", "GPL-2.0", None, None]


def test_licenses_are_inherited(spark, edge_docs, empty_docs):
    files = [
        ("a/LICENSE", APACHE + "\n" + prose(1, 50)),
        ("a/b/c.txt", prose(2, 80)),
        ("a/b/d/LICENSE", "x\n" + MIT),
        ("a/b/d/e.txt", prose(3, 40)),
        ("q/r.txt", prose(4, 40)),
        ("q/own.txt", prose(5, 40) + "\n  all RIGHTS reserved.\n" + prose(6, 10)),
        (None, None),
        ("top.txt", ""),
        # two licences as often in one directory: the least by name; three files of one outvote them
        ("t/1/LICENSE", MIT), ("t/2/LICENSE", MIT), ("t/2/x/LICENSE", APACHE), ("t/2/LICENSE", APACHE), ("t/2/doc", "none"), ("t/2/LICENSE", MIT + " "), ("t/1/LICENSE", APACHE), ("t/1/doc", "none"),
        ("a/b/c.txt", prose(2, 80)),
    ]
    df = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files)], "doc_id long, path string, text string")
    own = match_files(df).join(df.select("doc_id", "path"), "doc_id")
    rows = {r["doc_id"]: r for r in inherit(own, F.col("path").endswith("LICENSE")).collect()}

    def brute_inherit(k):
        path = files[k][0]
        if rows[k]["origin"] == "own" or path is None:
            return rows[k]["license"], rows[k]["origin"], None
        at = path.rpartition("/")[0]
        while True:
            here = Counter(rows[j]["license"] for j, (p, _) in enumerate(files) if p and p.endswith("LICENSE") and p.rpartition("/")[0] == at and rows[j]["origin"] == "own")
            if here:
                return min(here, key=lambda x: (-here[x], x)), "inherited", at
            if not at:
                return None, "none", None
            at = at.rpartition("/")[0]

    for k in range(len(files)):
        assert (rows[k]["license"], rows[k]["origin"], rows[k]["license_dir"]) == brute_inherit(k), files[k]
    assert rows[1]["license"] == "Apache-2.0" and rows[12]["license"] == "MIT" and rows[15]["license"] == "Apache-2.0"
    assert match_files(empty_docs).count() == 0 and match_files(edge_docs).count() == len(TEXTS)


def test_the_anchor_filter_is_exact():
    df = {named(t): n for t, n in {"the": 900, "license": 30, "under": 100}.items()}
    matcher = Matcher(TEMPLATES, df, 1000)
    for text in [*(x for t in TEMPLATES.values() for x in t), prose(1, 30), "the license", "released under", "rights", "all rights", "apache 2.0", "cc by", "spdx-license-identifier: mit"]:
        best = matcher.weigh(0, terms(text.lower()))
        assert best is None or matcher.anchor.search(text.lower()), text


def test_a_notice_is_found_however_many_files_there_are():
    notice = "This document is licensed under the apache license version 2.0"
    shares = {"the": 0.6, "licensed": 0.01, "under": 0.03, "apache": 0.006, "license": 0.02, "version": 0.02, "2.0": 0.006, "is": 0.3, "this": 0.3, "document": 0.05}
    for files in (1000, 10_000, 3_000_000):
        found = Matcher(TEMPLATES, {named(t): int(x * files) for t, x in shares.items()}, files).scan(notice)
        assert [(s.name, s.missing) for s in found] == [("Apache-2.0", [])] and found[0].cosine > 0.85
