"""N-gram Jaccard join by parity sketches: which documents are nearly the same.

A document is its set of distinct word n-grams; two link when
100 * |intersection| >= `percent` * |union|.  For sets of sizes a and b that
bounds the symmetric difference, so:

* Sets are dealt to size bands, and each to every band below that a smaller
  partner could be in; a pair meets in the band of its smaller set.  D is the
  largest difference that a linked pair of the band can have.
* Tokens are dealt by hash to m = D + 1 + W blocks of the band.  XOR of token
  hashes in each block is the block's parity digest.  A differing token spoils
  one block, so linked sets agree on at least 1 + W blocks (pigeonhole).
* A block is weak if it has no token, or none but very frequent ones.  A set
  with w <= W weak blocks agrees with each partner on 1 + W - w strong ones, so
  the D + 1 strong blocks of least digest are enough (prefix filtering), and
  empty blocks and widespread passages make no large buckets.  A set with more
  weak blocks sends all its blocks.
* Sets that share a block meet in a bucket.  The member that shares the most
  blocks is the bucket's pivot; every other is paired with it, so a bucket of k
  gives k - 1 pairs.  A pair whose bit sketches (one bit flipped for each token)
  have a Hamming distance above the bound can't link; the rest is verified on
  the texts.
* Linked pairs make components.  A bucket whose members all lie in one
  component is finished.  In the others each member outside the bucket's largest
  component is held against all members of other components by sketch, and what
  passes and wasn't verified yet is verified too.
  No link between components is lost, and pairs inside one are never listed.  A
  large bucket is a grid of cells of at most `HELD` held and `SPREAD` passing
  members, and each cell is a task's work.

No key's rows need to be in one task: which buckets have two sets is found by
partial aggregation, joins on a bucket are left to Spark's splitting of skewed
joins, and each text is sent to the pairs of the member that has more of them.

Copies, and texts with equal sets, are one set with many documents.  Very
frequent tokens are only a matter of speed: the result doesn't depend on them.
Sets and blocks rest on 64-bit hashes; among n distinct sets a false match has a
probability of about n * n / 2**65.

Defined cases: a null or empty text, or one without words, has the empty set
(`n_shingles` 0) and is alone; a text of fewer words than an n-gram is one
n-gram; repeated rows and copies share a component; a null id is null in the
result and no smallest id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import most_frequent, presence, present, saved, shared_dir
from folioforge.llm.components import connected_components
from folioforge.llm.words import blocks, mix, word_hashes

U = np.uint64
#: A token is very frequent if it is in so large a share of the documents that a task has seen, and in `RARE` of them at least.
FREQUENT, RARE = 0.002, 24
#: Most tokens that are held to be very frequent (8 bytes each in a broadcast).
FREQUENT_MOST = 1 << 16
#: Tokens that a task gathers before it counts them.
GATHER = 3_000_000
#: Distinct sets that a task remembers to send copies once, and pairs that it remembers to name them once.
REMEMBER = 1 << 17
#: Rows of mixed buckets that one task takes, about, and members that it holds against others.
SPREAD, HELD = 16_384, 2048


class Bound(NamedTuple):
    """N-gram length and similarity in percent, and what follows from them."""

    n: int = 4
    percent: int = 85

    def difference(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of sizes a and b; below 0: they can't link."""
        total = a + b
        return total - 2 * -(-self.percent * total // (100 + self.percent))

    def partner(self, size: int) -> int:
        """Size of the largest set that can link with one of `size`."""
        return size * 100 // self.percent

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def edge(self, band: int) -> int:
        """Least size of a band; bands grow by a half."""
        size = 1
        for _ in range(band):
            size = max(size + 1, size * 3 // 2)
        return size

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def band(self, size: int) -> int:
        k = 0
        while self.edge(k + 1) <= size:
            k += 1
        return k

    def bands(self, size: int) -> range:
        """The bands in which a set of `size` or a smaller partner of it can be."""
        return range(self.band(max(1, -(-size * self.percent // 100))), self.band(size) + 1)

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def spoiled(self, band: int) -> int:
        """D of a band."""
        top = self.edge(band + 1) - 1
        return (top + self.partner(top)) * (100 - self.percent) // (100 + self.percent)

    def weak(self, band: int) -> int:
        """W of a band."""
        return self.spoiled(band) + 9

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def bits(self, band: int) -> int:
        """Bits of the sketches of a band, a power of two."""
        return max(256, 1 << (2 * self.edge(band + 1) - 1).bit_length())


def token_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The set of each text: hashes of its n-grams, ascending."""
    words, sizes = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - n + 1), U)
    for k in range(n):
        grams = mix(grams * U(0xD1342543DE82EF95) + words[k : k + len(grams)])
    end = 0
    for size in sizes.tolist():
        start, end = end, end + size
        if size >= n:
            yield np.unique(grams[start : end - n + 1])
        elif size:
            short = np.array([size], U)
            for k in range(start, end):
                short = mix(short * U(0x9FB21C651E98DF25) + words[k : k + 1])
            yield short
        else:
            yield np.zeros(0, U)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name for a set, as a signed number."""
    total = np.add.reduce(mix(tokens ^ U(0x5851F42D4C957F2D)), keepdims=True)
    parity = np.bitwise_xor.reduce(mix(tokens + U(0x14057B7EF767814F)), keepdims=True)
    size = np.array([len(tokens)], U)
    return int(mix(total * U(3) ^ parity ^ mix(size)).astype(np.int64)[0])


def sketch(tokens: np.ndarray, bits: int) -> bytes:
    """One bit flipped for each token."""
    counts = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).tobytes()


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to fewer bits; the distance stays a lower bound.

    Bit t of a sketch is token t modulo its size, so the halves line up.
    """
    while sketches.shape[1] * 64 > bits:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def block_keys(tokens: np.ndarray, band: int, bound: Bound, frequent: np.ndarray) -> np.ndarray:
    """The bucket keys under which a set is sent in a band."""
    spoiled, weak = bound.spoiled(band), bound.weak(band)
    m = spoiled + 1 + weak
    # tokens ascend, so blocks taken from the high bits do too
    block = ((tokens >> U(32)) * U(m) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    digest = np.bitwise_xor.reduceat(mix(tokens ^ U(0xA0761D6478BD642F)), first)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        strong = np.logical_or.reduceat(frequent[at] != tokens, first)
    else:
        strong = np.ones(len(first), bool)
    keys = mix(mix(digest + block[first].astype(U) * U(0xE7037ED1A0B428DB)) + U(band))
    chosen = keys[strong]
    if m - len(chosen) <= weak:
        return np.sort(chosen)[: spoiled + 1]
    void = np.setdiff1d(np.arange(m), block).astype(U)
    return np.concatenate([keys, mix(mix(void * U(0x8EBC6AF09C88C6E3) + U(1)) + U(band))])


def _sets(docs: DataFrame, bound: Bound) -> DataFrame:
    """Of each document its set's name, size and sketch; beside these, tokens that are frequent in a task (`token`, `n`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        held = 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(gathered), return_counts=True)
            often = counts >= max(RARE, int(FREQUENT * len(gathered)))
            tokens, counts = tokens[often].astype(np.int64), counts[often]
            return _set_rows(None, [None] * len(tokens), counts.tolist(), [None] * len(tokens), tokens)

        for batch in batches:
            names, sizes, sketches = [], [], []
            for texts in blocks(batch.column(0)):
                for tokens in token_sets(texts, bound.n):
                    sizes.append(len(tokens))
                    if not len(tokens):
                        names.append(None)
                        sketches.append(None)
                        continue
                    names.append(set_id(tokens))
                    sketches.append(sketch(tokens, bound.bits(bound.band(len(tokens)))))
                    gathered.append(tokens)
                    held += len(tokens)
                if held > GATHER:
                    yield frequent()
                    gathered, held = [], 0
            yield _set_rows(batch.column(1), names, sizes, sketches, None)
        if gathered:
            yield frequent()

    kind = docs.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def _set_rows(ids, names, sizes, sketches, tokens) -> pa.RecordBatch:
        n = len(names)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, arrow) if ids is None else ids, pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int64()) if tokens is None else pa.array(tokens, pa.int64())],
            names=["id", "cid", "n", "sketch", "token"],
        )

    return docs.select("text", "id").mapInArrow(run, f"id {kind.simpleString()}, cid long, n long, sketch binary, token long")


def _buckets(docs: DataFrame, bound: Bound, frequent: Broadcast, wanted: Broadcast | None = None) -> DataFrame:
    """Rows `bkey`, `cid`: under which keys each set is sent, those in `wanted` if given; a task sends copies once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            keys, names = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            size = 0
            for texts in blocks(batch.column(0)):
                for tokens in token_sets(texts, bound.n):
                    if not len(tokens):
                        continue
                    name = set_id(tokens)
                    if name in met:
                        continue
                    if len(met) >= REMEMBER:
                        met.clear()
                    met.add(name)
                    for k in bound.bands(len(tokens)):
                        own = block_keys(tokens, k, bound, frequent.value)
                        if wanted is not None:
                            own = own[present(wanted, own.astype(np.int64))]
                        keys.append(own)
                        names.append(np.full(len(own), name, np.int64))
                        size += len(own)
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(names))], names=["bkey", "cid"])
                    keys, names, size = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(names))], names=["bkey", "cid"])

    return docs.select("text").mapInArrow(run, "bkey long, cid long")


def _words(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<u8").reshape(len(data), -1)


def _near(a: bytes, b: bytes, na: int, nb: int, bound: Bound) -> bool:
    """Whether two sketches allow a link."""
    most = bound.difference(na, nb)
    if most < 0:
        return False
    x, y = _words([a]), _words([b])
    bits = 64 * min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, bits) ^ folded(y, bits)).sum()) <= most


def _by_sketch(pairs: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """The pairs `a`, `b` of set names whose sketches allow a link."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (4, 5, 2, 3)), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([_near(*row, bound) for row in rows], pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, names: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """The text of each set named in `names` (`cid`), as `cid`, `text`, one row each."""
    place = F.xxhash64("id").alias("p")
    shared = presence(sets.join(names, "cid", "left_semi").select(place), "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pa.array(present(shared, np.asarray(batch.column("p")))))
            cids, kept = [], []
            for block in blocks(texts):
                for text, tokens in zip(block, token_sets(block, bound.n), strict=True):
                    if len(tokens):
                        cids.append(set_id(tokens))
                        kept.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(kept, pa.binary())], names=["cid", "text"])

    found = docs.select(place, "text").mapInArrow(run, "cid long, text binary")
    return found.join(names, "cid", "left_semi").dropDuplicates(["cid"])


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, bound: Bound, folder: str) -> DataFrame:
    """The pairs `a`, `b` that link, held against each other on their whole texts."""
    pairs = saved(_by_sketch(pairs, sets, bound), f"{folder}/pairs")
    names = saved(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).groupBy("cid").agg(F.count("*").alias("k")), f"{folder}/names")
    if names.isEmpty():
        return pairs
    texts = _texts(docs, names, sets, bound)
    # the member with more pairs comes first: its text is sent once, the other's with the pair
    left, right = names.select(F.col("cid").alias("a"), F.col("k").alias("ka")), names.select(F.col("cid").alias("b"), F.col("k").alias("kb"))
    swap = F.col("kb") > F.col("ka")
    pairs = pairs.join(left, "a").join(right, "b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    both = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, mine = a, next(token_sets([ta.as_py()], bound.n))
                other = next(token_sets([tb.as_py()], bound.n))
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * shared >= bound.percent * (len(mine) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return saved(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), f"{folder}/links")


def _grid(named: DataFrame, buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of mixed buckets dealt to cells: `part`, `cell`, `held`, `cid`, `label`, `n`, `sketch`, `is_pivot`.

    `buckets` has `bkey`, `pivot`, `major` (the largest component), `members` and
    `minors` (those outside it).  Minors are held, in slices; all members pass the
    held ones, in slices too.
    """
    slices = lambda rows, most: F.pow(2, F.ceil(F.log2(F.greatest(F.lit(1.0), rows / most)))).cast("int")
    cut = buckets.withColumn("hs", slices(F.col("minors"), HELD)).withColumn("ms", slices(F.col("members"), SPREAD))
    # cells of the same slices of buckets around one component share a task while they are few: their pairs are named once
    load = F.sum(F.col("members") / F.col("ms") + F.col("minors") / F.col("hs"))
    groups = cut.groupBy("major", "hs", "ms").agg(F.ceil(load / SPREAD).alias("groups"))
    cut = cut.join(groups, ["major", "hs", "ms"])
    rows = named.join(cut, "bkey").join(sets.select("cid", "n", "sketch"), "cid")
    rows = rows.withColumn("minor", F.col("label") != F.col("major")).withColumn("is_pivot", F.col("cid") == F.col("pivot"))
    own = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    keep = ["bkey", "major", "groups", "hs", "ms", "cid", "label", "n", "sketch", "is_pivot"]
    passing = rows.select(*keep, F.lit(False).alias("held"), F.explode(upto("hs")).alias("h"), own(F.col("ms")).alias("m"))
    holding = rows.where(F.col("minor") & ~F.col("is_pivot")).select(*keep, F.lit(True).alias("held"), own(F.col("hs")).alias("h"), F.explode(upto("ms")).alias("m"))
    part = F.xxhash64("major", "hs", "ms", "h", "m", F.pmod("bkey", "groups"))
    return passing.union(holding).select(part.alias("part"), F.xxhash64("bkey", "h", "m").alias("cell"), "held", "cid", "label", "n", "sketch", "is_pivot")


def _across(grid: DataFrame, bound: Bound) -> DataFrame:
    """Pairs from different components of a cell whose sketches allow a link.

    Of each cell the held members come first, and the others stream past them.
    Pairs with the pivot were verified before.
    """
    ordered = grid.repartition("part").sortWithinPartitions("cell", F.col("held").desc()).select("cell", "held", "cid", "label", "n", "sketch", "is_pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        held: list[tuple] = []
        met: set[tuple[int, int]] = set()  # cells of the same documents share a task, and most of their pairs
        for batch in batches:
            found: set[tuple[int, int]] = set()
            start = 0
            keys = np.asarray(batch.column(0))
            edges = np.concatenate([np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else []
            for end in edges:
                rows = batch.slice(start, end - start)
                start = end
                if keys[end - 1] != cell:
                    cell, held = keys[end - 1], []
                first, pivot = (np.asarray(rows.column(k).cast(pa.int8())) == 1 for k in (1, 6))
                cid, label, n = (np.asarray(rows.column(k)) for k in (2, 3, 4))
                raw = rows.column(5).to_pylist()
                held += [(int(cid[i]), int(label[i]), int(n[i]), raw[i]) for i in np.flatnonzero(first)]
                passing = np.flatnonzero(~first & ~pivot)
                if not len(passing) or not held:
                    continue
                cid, label, n = cid[passing], label[passing], n[passing]
                bits = 8 * min([len(raw[i]) for i in passing] + [len(x[3]) for x in held])
                sketches = np.concatenate([folded(_words([raw[i]]), bits) for i in passing])
                for c, own, size, x in held:
                    total = n + size
                    most = total - 2 * -(-bound.percent * total // (100 + bound.percent))
                    near = np.bitwise_count(sketches ^ folded(_words([x]), bits)).sum(axis=1) <= most
                    found.update((min(c, d), max(c, d)) for d in cid[near & (label != own)].tolist())
            found -= met
            if len(met) > REMEMBER:
                met.clear()
            met |= found
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Id, `n_shingles` and `component_id` (the smallest id reachable by links) of each document."""
    spark = docs.sparkSession
    bound = Bound(n, percent)
    folder = shared_dir(spark)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    noted = saved(_sets(rows, bound), f"{folder}/sets")
    documents = noted.where("token IS NULL")
    top = most_frequent(saved(noted.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")), f"{folder}/frequent"), "token", FREQUENT_MOST)
    frequent = np.sort(np.array([t for t, _ in top], np.int64).astype(U))

    groups = documents.where("cid IS NOT NULL").groupBy("cid").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = saved(groups, f"{folder}/groups")

    shared = spark.sparkContext.broadcast(frequent)  # at most FREQUENT_MOST numbers
    # keys of two sets or more, by partial aggregation; then the sets are sent again, under those keys alone
    ends = _buckets(rows, bound, shared).groupBy("bkey").agg(F.min("cid").alias("least"), F.max("cid").alias("most"))
    keys = saved(ends.where("least < most").select("bkey"), f"{folder}/keys")
    sent = _buckets(rows, bound, shared, presence(keys, "bkey"))
    buckets = saved(sent.join(keys, "bkey", "left_semi").distinct(), f"{folder}/buckets")
    shared_blocks = buckets.groupBy("cid").agg(F.count("*").alias("k"))
    pivots = saved(buckets.join(shared_blocks, "cid").groupBy("bkey").agg(F.max_by("cid", F.struct("k", "cid")).alias("pivot")), f"{folder}/pivots")
    star = buckets.join(pivots, "bkey").where("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
    star = saved(star, f"{folder}/star")
    links = _verified(star, rows, sets, bound, f"{folder}/first")
    labels = connected_components(links, f"{folder}/components-1")

    named = buckets.join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("bkey", "cid", F.coalesce("label", "cid").alias("label"))
    sizes = named.groupBy("bkey", "label").agg(F.count("*").alias("k"))
    open_buckets = sizes.groupBy("bkey").agg(F.count("*").alias("labels"), F.sum("k").alias("members"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("major"))
    # the one pair of a bucket of two has been verified
    open_buckets = open_buckets.where("labels > 1 AND members > 2").select("bkey", "major", "members", (F.col("members") - F.col("most")).alias("minors"))
    grid = _grid(named, open_buckets.join(pivots, "bkey"), sets)
    rest = saved(_across(grid, bound).join(star, ["a", "b"], "left_anti"), f"{folder}/rest")
    if not rest.isEmpty():
        more = _verified(rest, rows, sets, bound, f"{folder}/second")
        labels = connected_components(links.union(more), f"{folder}/components-2")

    joined = sets.select("cid", F.col("id").alias("rep")).join(labels.withColumnRenamed("v", "cid"), "cid", "left").select("cid", "rep", F.coalesce("label", "cid").alias("label"))
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "label").select("cid", "component_id")
    out = documents.select("id", "n", "cid").join(named, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that link to one of smaller id, with the columns of `docs`.

    Of each component the document of smallest id stays.  Rows that share an id
    are one document and stay or go together; rows with a null id always stay.
    """
    parts = near_duplicates(docs, id_col=id_col, text_col=text_col, n=n, percent=percent)
    extra = saved(parts.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("gone")).distinct(), shared_dir(docs.sparkSession))
    return docs.join(extra, docs[id_col] == extra["gone"], "left_anti")
