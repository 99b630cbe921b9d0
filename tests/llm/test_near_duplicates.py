import random
import re
from itertools import combinations, product

import pytest

from folioforge.llm import parity_join
from folioforge.llm.components import connected_components
from folioforge.llm.parity_join import Bound, block_keys, keep_one, near_duplicates, token_sets

from .conftest import TEXTS, docs_frame, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, n=4, percent=85):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted((find(i), find(j)))
            parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies():
    r = random.Random(3)
    rows, passage = [], prose(777, 60)
    for g in range(12):
        base = prose(g, r.choice((6, 20, 60, 150, 400))).split()
        for _ in range(r.choice((1, 2, 8))):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            rows.append(" ".join(words))
    for _ in range(40):  # one base, many edits, links of every degree
        words = prose(5000, 120).split()
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        rows.append(" ".join(words))
    rows += [passage + " " + prose(9000 + k, r.choice((3, 20, 60))) for k in range(60)]  # a passage that many share
    rows += ["a b c", "A  b\nc", "a b", "a", "", None, "a b c d", "a b c d e"] * 2
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (1, 60), (2, 50), (1, 20), (3, 95)])
def test_components_equal_brute_force(spark, n, percent):
    rows = near_copies()
    found = near_duplicates(docs_frame(spark, rows), n=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, n, percent)


def test_pigeonhole_holds():
    """Linked sets share a key in a band where both are sent, whatever tokens are held to be frequent."""
    import numpy as np

    r = np.random.default_rng(2)
    for size, percent in product((1, 2, 5, 6, 7, 12, 13, 40, 118, 119, 500, 3000), (85, 66, 50, 20)):
        bound = Bound(4, percent)
        for _ in range(30 if size < 500 else 4):
            a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
            frequent = np.sort(r.choice(a, r.integers(0, len(a)), replace=False))
            most = max(d for d in range(len(a) + 1) if bound.difference(len(a), len(a) - d) >= d)
            b = np.sort(r.choice(a, len(a) - r.integers(0, most + 1), replace=False))
            assert any(set(block_keys(a, k, bound, frequent)) & set(block_keys(b, k, bound, frequent)) for k in set(bound.bands(len(a))) & set(bound.bands(len(b)))), (size, len(b))


def test_links_across_bands(spark):
    """18 words and the same with 12 more link at 60 percent, and chains through sizes that grow link end to end."""
    words = [f"y{k}" for k in range(30)]
    rows = [(0, " ".join(words[:18])), (1, " ".join(words))] + [(2 + k, " ".join(f"x{j}" for j in range(round(10 * 1.9**k)))) for k in range(7)]
    for percent in (60, 50, 30):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_frame(spark, rows), n=1, percent=percent).collect()}
        assert found == brute(rows, 1, percent) and found[1][1] == 0 and (percent == 60 or found[8][1] == 2)


def test_cells_of_a_grid(spark, monkeypatch):
    """Buckets cut to small cells lose no pair."""
    monkeypatch.setattr(parity_join, "HELD", 4)
    monkeypatch.setattr(parity_join, "SPREAD", 8)
    rows = near_copies()
    found = near_duplicates(docs_frame(spark, rows), n=4, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 4, 85)


def test_edges(edge_docs, empty_docs):
    rows = near_duplicates(edge_docs).collect()
    assert len(rows) == len(TEXTS)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (9, 4, 9), (10, 4, 9), (11, 4, 9)} <= found
    assert near_duplicates(empty_docs).count() == 0
    kept = keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.select("doc_id").collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_hashed_sets_count_like_sets():
    for _, text in TEXTS:
        assert len(next(token_sets([(text or "").encode()], 4))) == len(shingles(text, 4))


def test_components_of_paths_and_stars(spark, tmp_path):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(500, 500)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()
    labels = {r["v"]: r["label"] for r in found}
    assert all(labels[k] == 0 for k in range(41)) and all(labels[k] == 100 for k in range(100, 150)) and labels[500] == 500


def test_components_of_a_long_path_in_random_order(spark, tmp_path):
    nodes = list(range(2000))
    random.Random(1).shuffle(nodes)
    edges = list(zip(nodes, nodes[1:]))
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()
    assert {r["v"]: r["label"] for r in found} == dict.fromkeys(nodes, 0)
    assert len(list((tmp_path / "c").glob("labels-*"))) < 30
