import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import lm_scoring as lm
from folioforge.llm import media_columns as media
from folioforge.llm.elias_fano import EliasFano
from folioforge.llm.source_mixing import coarse_topic, draw, mix
from folioforge.llm.words import word_hashes

from .conftest import TEXTS, docs_frame, prose


# -- media ---------------------------------------------------------------------


def test_media_round_trip(spark, edge_docs, empty_docs):
    rows = media.store_and_rebuild(edge_docs).collect()
    texts = dict(TEXTS)
    assert len(rows) == len(TEXTS)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()
    assert media.store_and_rebuild(empty_docs).count() == 0


def brute_feature(payload):
    mean = sum(payload) / len(payload)
    std = math.sqrt(sum((x - mean) ** 2 for x in payload) / len(payload))
    crossings = sum((a > mean) != (b > mean) for a, b in zip(payload, payload[1:], strict=False))
    entropy = abs(-sum(n / len(payload) * math.log2(n / len(payload)) for n in Counter(payload).values()))
    return f"samples={len(payload)};mean={mean:.4f};std={std:.4f};min={min(payload)};max={max(payload)};crossings={crossings};entropy={entropy:.4f}"


def test_features_equal_brute_force(spark):
    docs = docs_frame(spark, [(i, prose(i, 7 * i)) for i in range(30)] + [(40, None), (41, "ABC"), (42, "é" * 96)])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = media.store_and_rebuild(docs).collect()
    assert len(rows) == len(texts) and all(r["feature"] == brute_feature(media.payload_of(texts[r["doc_id"]])[0]) for r in rows)


def test_shared_chunks_are_stored_once(spark, tmp_path):
    shared = prose(1, 400)
    made = [(i, prose(100 + i, 80) + shared + prose(200 + i, 50 * (i % 3))) for i in range(12)]
    docs = docs_frame(spark, made + [(50 + i, made[0][1]) for i in range(9)] + [(70, None), (70, None)])
    sizes = (64, 512, 6)
    stored = media.store(docs.repartition(5), f"file://{tmp_path}/store", sizes=sizes)
    assert {"media", "pool"} <= {x.name for x in (tmp_path / "store").iterdir()}
    pool = {bytes(r["chunk"]) for r in stored.pool.collect()}
    assert len(pool) > 3 and stored.pool.count() == len(pool)
    own = 0
    for r in stored.media.collect():
        data = media.zstandard.ZstdDecompressor().decompress(bytes(r["own"])) if r["own"] else b""
        assert len(data) == sum(n for n, c in zip(r["sizes"], r["chunks"], strict=True) if bytes(c) not in pool)
        assert r["pooled"] == sum(bytes(c) in pool for c in r["chunks"])
        own += len(data)
    assert own < sum(len(t) for _, t in made) * 0.7  # the shared passage isn't among them
    rows = media.store_and_rebuild(docs, sizes=sizes).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["payload_sha256"] == hashlib.sha256(media.payload_of(texts[r["doc_id"]])[0]).hexdigest()


def test_damage_is_found(spark, tmp_path):
    docs = docs_frame(spark, [(1, prose(1, 300)), (2, prose(2, 300))])
    stored = media.store(docs, f"file://{tmp_path}/store")
    other = media.zstandard.ZstdCompressor().compress(prose(3, 900).encode())
    broken = stored._replace(media=stored.media.withColumn("own", F.lit(bytearray(other))))
    with pytest.raises(Exception, match="damaged"):
        media.rebuild(broken).collect()


def test_cuts_follow_content():
    data = prose(1, 30000).encode()
    cuts = media.cut_points(data)
    least, most, _ = media.SIZES
    assert cuts[-1] == len(data) and all(least <= b - a <= most for a, b in zip([0, *cuts], cuts[:-1], strict=False))
    moved = media.cut_points(b"something in front " + data)
    assert len({c - 19 for c in moved} & set(cuts)) > len(cuts) // 2
    gear, h = media.gear_hash(b"abcdef" * 20), 0
    for k, byte in enumerate(b"abcdef" * 20):
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
        assert int(gear[k]) == h


# -- language model --------------------------------------------------------------


@pytest.mark.parametrize(("n", "universe"), [(0, 1), (1, 1), (7, 9), (500, 400), (2000, 10**12)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, universe, n)).astype(np.uint64)
    ef = EliasFano.encode(values, universe)
    if n:
        at = r.integers(0, n, 300)
        assert (ef.get(at) == values[at]).all()
    asked = np.concatenate([values, r.integers(0, universe + 9, 300).astype(np.uint64)])
    found = ef.find(asked)
    assert ((found >= 0) == np.isin(asked, values)).all() and (values[found[found >= 0]] == asked[found >= 0]).all()


def words_of(text):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(low)) + [None]


def test_words_hash_like_words():
    texts = [(t or "").encode() for _, t in TEXTS]
    hashes, sizes = word_hashes(texts)
    words = [w for _, t in TEXTS for w in words_of(t)[:-1]]
    assert sizes.tolist() == [len(words_of(t)) - 1 for _, t in TEXTS] and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words)) == len({(h, w) for h, w in zip(hashes.tolist(), words, strict=True)})


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, edge_docs, order):
    docs = docs_frame(spark, [(100 + i, prose(i % 40, 60)) for i in range(60)]).unionByName(edge_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    held = lm.is_held_out(docs["doc_id"])
    model = lm.train(docs.where(~held), order=order)
    rows = lm.score(docs, model, held_out=held).collect()
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    train = [words_of(t) for i, t in given if not out(i)]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    grams, follows, kinds = Counter(), Counter(), defaultdict(set)
    for x in train:
        padded = [None, *x]
        for i in range(1, len(padded)):
            for k in range(2, min(order, i + 1) + 1):
                gram = tuple(padded[i - k + 1 : i + 1])
                grams[gram] += 1
                follows[gram[:-1]] += 1
                kinds[gram[:-1]].add(gram[-1])
    single = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(context, w):
        if not context:
            return single(w)
        below = p(context[1:], w)
        if not follows[context]:
            return below
        return max(grams[*context, w] - 0.75, 0) / follows[context] + 0.75 * len(kinds[context]) / follows[context] * below

    expected = []
    for i, t in given:
        x = words_of(t)
        padded = [None, *x]
        base = sum(math.log10(single(w)) for w in x)
        full = sum(math.log10(p(tuple(padded[max(0, k - order + 1) : k]), padded[k])) for k in range(1, len(padded)))
        expected.append((-1 if i is None else i, out(i), len(x), sum(w in c for w in x), n, base, full / len(x)))
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"] / r["n_tokens"]) for r in rows)
    expected.sort()
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in found], [r[5] for r in expected], rtol=1e-9)
    assert np.allclose([r[6] for r in found], [r[6] for r in expected], atol=0.016)  # half a step of the coarse codes


def test_shards_and_holding_give_the_same_scores(spark, monkeypatch):
    docs = docs_frame(spark, [(i, prose(i % 40, 80)) for i in range(60)])
    scores = lambda m: {r["doc_id"]: r["score"] for r in lm.score(docs, m).collect()}
    one = scores(lm.train(docs, shards=1))
    many = scores(lm.train(docs, shards=64))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], abs_tol=1e-9) for i in one)
    monkeypatch.setattr(lm, "SHARD", 1 << 10)
    assert lm.train(docs).shards > 16  # they grow with the text


def test_a_shard_is_built_in_bounded_memory():
    r = np.random.default_rng(5)
    none, n, parts = 5000, 50_000, []
    for _ in range(8):
        ids = (none * r.random(n) ** 3).astype(np.int64)
        columns, counts = lm._distinct(lm._windows(ids, np.full(n // 50, 50), 0, 3, none), np.ones(n, np.int64))
        parts.append((lm._packed(np.diff(columns[0], prepend=0)), *map(lm._packed, columns[1:]), lm._packed(counts)))
    built = lambda most: lm._levels(lm._merged(list(parts), most), 3, none, lambda ids: ids + 1_000_000, none)
    whole = built(8 * n)
    tracemalloc.start()
    sliced = built(10_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(x.dtype == y.dtype and np.array_equal(x, y) for x, y in zip([*whole[0], *whole[1:]], [*sliced[0], *sliced[1:]], strict=True))
    assert peak < 80 * 8 * n  # bytes of a window; 54 measured, 229 with a shard at once


def test_documents_that_occur_twice_score_apart(spark):
    texts = [prose(i, 150) for i in range(200)]
    docs = docs_frame(spark, list(enumerate(texts + texts[:40])))
    rows = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(docs, lm.train(docs)).collect()}
    once = sorted(rows[i] for i in range(40, 200))
    assert sum(rows[i] > once[-9] for i in range(40)) >= 38


def test_no_training_text(spark, edge_docs, empty_docs):
    model = lm.train(empty_docs)
    assert (model.words, model.tokens) == (0, 0)
    rows = lm.score(edge_docs, model).collect()
    assert all(r["n_known"] == 0 and math.isclose(r["base_score"], 0.0, abs_tol=1e-9) for r in rows)
    assert lm.score(empty_docs, model).count() == 0


# -- mixing ------------------------------------------------------------------------


def test_shares_reach_targets(spark):
    rows = [(i, prose(i, 40 + i % 90), "en" if i % 5 else "fr", f"s{i % 4 if i % 3 else 0}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {"source": spark.createDataFrame([("s0", 0.25), ("s1", 0.25), ("s2", 0.25), ("s3", 0.25)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.7), ("fr", 0.3)], "value string, share double")}
    out = mix(docs, {"source": docs["source"], "lang": docs["lang"]}, want, budget=0.4, columns=["doc_id"]).toPandas()
    assert (out.mix_p <= 1).all() and (out.mix_kept == (out.mix_p > 0) & out.mix_kept).all()
    weighed = out.assign(w=out.mix_p * out.mix_tokens)
    assert abs(weighed.w.sum() / out.mix_tokens.sum() - 0.4) < 1e-6
    for column, shares in (("mix_source", {"s0": 0.25, "s3": 0.25}), ("mix_lang", {"fr": 0.3})):
        got = weighed.groupby(column).w.sum() / weighed.w.sum()
        for value, share in shares.items():
            assert abs(got[value] - share) < 0.01
    drawn = out[out.mix_kept]
    assert abs(drawn.mix_tokens.sum() / out.mix_tokens.sum() - 0.4) < 0.05


def brute_mix(rows, budget, rounds=400):
    """Raking and calibration by dictionaries: the probability of each cell; rows are (id, cell, tokens)."""
    t = defaultdict(float)
    for _, cell, n in rows:
        t[cell] += n
    t = {c: max(x, 1.0) for c, x in t.items()}
    w = dict.fromkeys(t, 1.0)
    shares = []
    for k in range(len(next(iter(t)))):
        sums = defaultdict(float)
        for c, x in t.items():
            sums[c[k]] += x
        whole = sum(x**0.7 for x in sums.values())
        shares.append({v: x**0.7 / whole for v, x in sums.items()})
    for _ in range(rounds):
        for k, share in enumerate(shares):
            sums = defaultdict(float)
            for c in t:
                sums[c[k]] += w[c] * t[c]
            w = {c: x * share[c[k]] / sums[c[k]] for c, x in w.items()}
    goal, low, high = budget * sum(t.values()), 0.0, 1e12
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(1.0, w[c] * middle) * t[c] for c in t) < goal else (low, middle)
    return {c: min(1.0, x * low) for c, x in w.items()}


def drawn_number(i):
    return int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:8], 16) / 2**32


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_mixing_equals_brute_force(spark, broadcast):
    r = np.random.default_rng(4)
    rows = [(int(i), f"s{min(int(r.zipf(1.6)), 9)}" if i % 17 else None, ("en", "fr", "de", None)[int(r.integers(4))], " ".join(["w"] * int(r.integers(0, 60)))) for i in range(900)]
    rows += [(5, *rows[5][1:])] * 3 + [(None, "s1", "en", "a b"), (2000, "s1", "en", None), (2001, "s1", "fr", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    out = mix(docs, {"source": docs["source"], "lang": docs["lang"]}, budget=0.5, broadcast=broadcast).collect()
    p = brute_mix([(i, (s, x), len((t or "").split())) for i, s, x, t in rows], 0.5)
    assert len(out) == len(rows)
    for row in out:
        expected = p[row["source"], row["lang"]]
        assert math.isclose(row["mix_p"], expected, rel_tol=1e-6)
        assert row["mix_kept"] == (drawn_number(row["doc_id"]) < row["mix_p"])
    kept = Counter(r["doc_id"] for r in draw(docs, {"source": docs["source"], "lang": docs["lang"]}, budget=0.5, broadcast=broadcast).collect())
    assert kept == Counter(row["doc_id"] for row in out if row["mix_kept"])


def test_mixing_rakes_the_counts_that_are_given(spark):
    from folioforge.llm.token_counts import count_tokens
    import public_tokenizers as P

    docs = docs_frame(spark, [(i, prose(i, 30 + i % 40)) for i in range(200)])
    counted = count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).select("doc_id", F.col("n_tokens").alias("tokens"))
    joined = docs.join(counted, "doc_id")
    want = {"source": spark.createDataFrame([("src0", 0.2), ("src1", 0.8)], "value string, share double")}
    out = mix(joined, {"source": joined["source"]}, want, budget=0.3, tokens=joined["tokens"]).toPandas()
    weighed = out.mix_p * out.tokens
    assert (out.mix_tokens == out.tokens).all() and abs(weighed[out.source == "src1"].sum() / weighed.sum() - 0.8) < 1e-6


def test_mixing_edges(edge_docs, empty_docs):
    dims = lambda d: {"source": d["source"], "lang": d["lang"], "topic": coarse_topic(d["text"])}
    out = mix(edge_docs, dims(edge_docs))
    assert out.count() == len(TEXTS) and out.columns[: len(edge_docs.columns)] == edge_docs.columns
    assert all(r["mix_p"] is not None for r in out.collect())
    assert mix(empty_docs, dims(empty_docs)).count() == 0
    names = ["c0", "d0", "k0", "u", "p", "v", "t", "w", "s0", "tokens", "mix_tokens", "mix_p", "mix_kept", "mix_topic", "gone", "v0"]
    clashing = edge_docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = mix(clashing, dims(clashing))
    assert out.columns == [c for c in clashing.columns if not c.startswith("mix_")] + ["mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_p", "mix_kept"]
    kept = draw(clashing, dims(clashing))
    assert kept.columns == clashing.columns and {r["mix_kept"] for r in kept.collect()} == {names.index("mix_kept")}
