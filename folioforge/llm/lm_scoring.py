"""Language-model scoring with an Elias-Fano coded n-gram trie.

Training text gives one level for each order: words, and for each n-gram (the
context) the words that followed it.  Words are dealt to shards by hash.  Longer
n-grams are dealt by a hash of their first two words, so a word's followers
spread over all shards, and a context's node and its followers are in one shard
at every order.

The word level of a shard is the monotone sequence of its words' hashes.  In the
levels above, a follower is stored relative to its context's pointer, which makes
all followers of a level one monotone sequence; contexts' pointers are another.
All are Elias-Fano coded; beside them lie the n-grams' discounted probabilities
and their back-off weights, quantised on a log scale.  A shard's levels are one
file in the shared folder, mapped into memory by the tasks that score, so a task
touches only the pages it needs.  Where the folder isn't mounted, a process holds
at most `HELD` bytes of shards, those it used last.

A probability interpolates the discounted n-gram with the next shorter one, down
to the word's own additive estimate:

    p(w|h) = max(c(h,w) - D, 0) / c(h) + D * n(h) / c(h) * p(w|h'),
    p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)),

with h' the context without its first word, c(h) the followers of h and n(h) the
different ones.  A context that was never followed is passed over.  Texts are
preceded by one end token and never reach into the text before.

There is a shard for each `SHARD` bytes of training text, whatever their number;
a task builds one shard at a time, a range of contexts after the other, from
packed arrays that are pre-aggregated for each partition of the input.  Files are written under another name and then
renamed, so a task that is run again replaces its file by the same bytes.

Defined cases: a null or empty text is one end token; a null id counts as the
empty text in the split and is held out; repeated rows are counted and scored
each; with no training text every token is unknown (N = V = 0); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import shared_dir
from folioforge.llm.elias_fano import EliasFano
from folioforge.llm.words import blocks, mix, word_hashes

#: Order of the model, in words.
ORDER = 3
ADD = 0.1
DISCOUNT = 0.75
#: Bytes of training text for each shard.
SHARD = 24 << 20
#: The end token, as a word hash.
END = np.uint64(0x454E44_0F_7E87)
#: Quantised log10 values lie in [-FLOOR, 0]: on 16 bits, and on 8 for the highest order.
FLOOR, FINE, COARSE = 8.0, (1 << 16) - 1, (1 << 8) - 1
#: Tokens that a task gathers before it sends them on.
GATHER = 2_500_000
#: Of these, windows that are sorted at once.
SLICE = 1 << 18
#: Bytes of shards that a process holds where they can't be mapped, and shards that it keeps mapped.
HELD, MAPPED = 256 << 20, 1 << 14

U = np.uint64
LOW = U(0xFFFFFFFF)


def _code(p: np.ndarray, levels: int) -> np.ndarray:
    logs = -np.log10(np.maximum(p, 1e-300))
    return np.rint(np.clip(logs / FLOOR, 0, 1) * levels).astype(np.uint8 if levels == COARSE else np.uint16)


def _decode(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code.astype(np.float64) * (-FLOOR / (COARSE if code.dtype == np.uint8 else FINE)))


# -- files in the shared folder ------------------------------------------------


def _place(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def write_level(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, each from a multiple of 8 bytes, behind a table of types and sizes."""
    import os

    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    head = np.zeros((len(arrays), 2), np.int64)
    for row, a in zip(head, arrays, strict=True):
        row[:] = a.dtype.itemsize * 256 + ord(a.dtype.kind), len(a)
    temporary = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 60)}"
    with system.open_output_stream(temporary) as out:
        out.write(np.array([len(arrays)], np.int64).tobytes() + head.tobytes())
        for a in arrays:
            out.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    system.move(temporary, path)


def open_level(uri: str) -> list[np.ndarray]:
    """The arrays of a file: mapped if the shared folder is mounted, else read into memory; none if a shard has no file."""
    import pyarrow.fs as fs

    system, path = _place(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return []
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        dtype = np.dtype(f"{chr(kind % 256)}{kind // 256}")
        out.append(raw[at : at + size * dtype.itemsize].view(dtype))
        at += -(-size * dtype.itemsize // 8) * 8
    return out


class Model(NamedTuple):
    """Where a trained model lies, and its totals."""

    folder: str
    shards: int
    #: First word id of each word shard, and the number of words at the end.
    bases: tuple[int, ...]
    tokens: int
    order: int

    @property
    def words(self) -> int:
        return self.bases[-1]


class _Opened:
    """Files by name: mapped ones as they come, held ones within `HELD` bytes, those used last."""

    def __init__(self) -> None:
        self.files: OrderedDict[str, list[np.ndarray]] = OrderedDict()
        self.held = 0

    def __call__(self, uri: str) -> list[np.ndarray]:
        arrays = self.files.get(uri)
        if arrays is None:
            arrays = self.files[uri] = open_level(uri)
            self.held += self._size(arrays)
            while len(self.files) > MAPPED or (self.held > HELD and len(self.files) > 1):
                _, old = self.files.popitem(last=False)
                self.held -= self._size(old)
        else:
            self.files.move_to_end(uri)
        return arrays

    @staticmethod
    def _size(arrays: list[np.ndarray]) -> int:
        return sum(x.nbytes for x in arrays if not isinstance(x, np.memmap))


def _word_shift(shards: int) -> int:
    return 64 - (shards.bit_length() - 1)


def _stretches(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shards met and the stretch of each in an array that has them in order."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield int(shard[a]), a, b


class Words:
    """The first level: every word's hash, count and back-off weight, in shards by hash."""

    def __init__(self, model: Model, opened: _Opened, *, weights: bool) -> None:
        self.model, self.opened, self.weights = model, opened, weights
        self.shift = _word_shift(model.shards)
        self.bases = np.array(model.bases, np.int64)

    def part(self, shard: int) -> tuple[EliasFano, np.ndarray]:
        arrays = self.opened(f"{self.model.folder}/words/{shard}")
        return EliasFano.of(*arrays[:4]), arrays[4]

    def find(self, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), counts and back-off weights of hashes in ascending order."""
        ids, counts, weights = np.full(len(ordered), -1, np.int64), np.zeros(len(ordered), np.int64), np.ones(len(ordered))
        for shard, a, b in _stretches(_word_shard(ordered, self.model.shards)):
            if self.bases[shard] == self.bases[shard + 1]:
                continue
            hashes, own = self.part(shard)
            at = hashes.find(_within(ordered[a:b], self.shift))
            hit = np.flatnonzero(at >= 0)
            ids[a + hit] = at[hit] + self.bases[shard]
            counts[a + hit] = own[at[hit]]
            if self.weights:
                weights[a + hit] = _decode(self.opened(f"{self.model.folder}/weights/{shard}")[0][at[hit]])
        return ids, counts, weights

    def totals(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word ids in ascending order."""
        out = np.zeros(len(ids), np.int64)
        for shard, a, b in _stretches(np.searchsorted(self.bases, ids, "right") - 1):
            out[a:b] = self.part(shard)[1][ids[a:b] - self.bases[shard]]
        return out


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    shift = _word_shift(shards)
    return (hashes >> U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(hashes), np.int64)


def _within(hashes: np.ndarray, shift: int) -> np.ndarray:
    return hashes & U((1 << shift) - 1)


class Level:
    """One order of a shard: pointers of contexts, followers, their codes, and their weights as contexts."""

    #: Arrays of a level in its file.
    ARRAYS = 10

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.pointers, self.followers = EliasFano.of(*arrays[:4]), EliasFano.of(*arrays[4:8])
        self.codes, self.weights = arrays[8], arrays[9]

    def successors(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each word among the followers of its context, -1 where it never followed."""
        start, end = self.pointers.get(context), self.pointers.get(context + 1)
        target = start + word.astype(U)
        # a successor beyond the next context's pointer belongs to that context
        inside = np.flatnonzero(target < end)
        out = np.full(len(context), -1, np.int64)
        out[inside] = self.followers.find(target[inside])
        return out


class Grams:
    """The levels from the second on, in shards by the first two words."""

    def __init__(self, model: Model, opened: _Opened) -> None:
        self.model, self.opened = model, opened

    def _levels(self, shard: int) -> list[np.ndarray]:
        return self.opened(f"{self.model.folder}/grams/{shard}")

    def pairs(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shard, node (-1: never met), probability and weight as a context of each pair of ids."""
        shard = pair_shard(u, w, self.model.shards)
        node, p, weight = np.full(len(u), -1, np.int64), np.zeros(len(u)), np.ones(len(u))
        order = np.argsort(shard.astype(np.uint32), kind="stable")
        for s, a, b in _stretches(shard[order]):
            arrays, rows = self._levels(s), order[a:b]
            if not arrays:
                continue
            context = EliasFano.of(*arrays[:4]).find(u[rows].astype(U))
            rows, context = rows[context >= 0], context[context >= 0]
            level = Level(arrays[4 : 4 + Level.ARRAYS])
            found = level.successors(context, w[rows])
            rows, found = rows[found >= 0], found[found >= 0]
            node[rows], p[rows] = found, _decode(level.codes[found])
            if len(level.weights):
                weight[rows] = _decode(level.weights[found])
        return shard, node, p, weight

    def longer(self, k: int, shard: np.ndarray, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node, probability and weight at order k of words after contexts (nodes of order k - 1 in their shards)."""
        node, p, weight = np.full(len(w), -1, np.int64), np.zeros(len(w)), np.ones(len(w))
        # in order of their contexts, so that a level is read from one end to the other
        order = np.argsort(shard << 40 | context)
        for s, a, b in _stretches(shard[order]):
            rows, at = order[a:b], 4 + Level.ARRAYS * (k - 2)
            level = Level(self._levels(s)[at : at + Level.ARRAYS])
            found = level.successors(context[rows], w[rows])
            rows, found = rows[found >= 0], found[found >= 0]
            node[rows], p[rows] = found, _decode(level.codes[found])
            if len(level.weights):
                weight[rows] = _decode(level.weights[found])
        return node, p, weight


def pair_shard(u: np.ndarray, w: np.ndarray, shards: int) -> np.ndarray:
    h = mix(u.astype(U) * U(0x9E3779B97F4A7C15) + w.astype(U))
    return (h >> U(32)).astype(np.int64) & (shards - 1)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


def _packed(a: np.ndarray) -> bytes:
    """Non-negative numbers as compressed planes of bytes, in 4 bytes each if they fit, else in 8."""
    width = 8 if len(a) and int(a.max()) >= 1 << 32 else 4
    planes = np.ascontiguousarray(a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.int64)


def token_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each text's words, and the texts' token counts."""
    hashes, sizes = word_hashes(texts)
    return np.insert(hashes, np.cumsum(sizes), END), sizes + 1


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    for batch in batches:
        yield from blocks(batch.column(0))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bytes, ...]]]]:
    """Each shard of a task with its rows of packed arrays; a task has one shard unless partitions were merged."""
    rows: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
    for batch in batches:
        for shard, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows[shard].append(tuple(packed))
    while rows:
        yield rows.popitem()


# -- training -------------------------------------------------------------------


def _windows(ids: np.ndarray, sizes: np.ndarray, end: int, order: int, none: int) -> list[np.ndarray]:
    """For each token the one before it (the end token for a text's first), itself and what follows it (`none` after the end)."""
    after = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - np.repeat(sizes, sizes)  # -1 at the end token
    columns = [_contexts(ids, sizes, end), ids]
    for k in range(1, order - 1):
        column = np.full(len(ids), none, np.int64)
        column[: len(ids) - k] = ids[k:]
        column[after + k >= 0] = none
        columns.append(column)
    return columns


def _distinct(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows in order, with their counts added up."""
    if not len(counts):
        return columns, counts
    group = columns[0].astype(U)
    if int(columns[0].max()) >= 1 << 32:
        group = np.unique(group, return_inverse=True)[1].astype(U)
    for k, column in enumerate(columns[1:], 1):
        if int(column.max()) >= 1 << 32:
            column = np.unique(column, return_inverse=True)[1]
        key = group << U(32) | column.astype(U)
        if k < len(columns) - 1:
            group = np.unique(key, return_inverse=True)[1].astype(U)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [c[order[at]] for c in columns], np.add.reduceat(counts[order], at)


def _narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative numbers in 4 bytes each if they fit."""
    return a.astype(np.uint32) if not len(a) or int(a.max()) < 1 << 32 else a


def _slices(ordered: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `most` rows of an array in order, each with all rows of its values."""
    a = 0
    while a < len(ordered):
        b = len(ordered) if a + most >= len(ordered) else int(np.searchsorted(ordered, ordered[a + most - 1], "right"))
        yield a, b
        a = b


def _merged(parts: list[tuple[bytes, ...]], most: int | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Distinct windows in order with their counts, a range of contexts of about `most` rows at a time; empties `parts`."""
    held = []
    while parts:
        first, *others = map(_unpacked, parts.pop())
        held.append([_narrow(np.cumsum(first)), *map(_narrow, others)])
    firsts = np.sort(np.concatenate([h[0] for h in held]))
    begins = [0] * len(held)
    for _, b in _slices(firsts, most or SLICE):
        # each part has its contexts in order
        ends = [int(np.searchsorted(h[0], firsts[b - 1], "right")) for h in held]
        *columns, counts = (np.concatenate([h[k][i:j] for h, i, j in zip(held, begins, ends, strict=True)]).astype(np.int64) for k in range(len(held[0])))
        begins = ends
        yield _distinct(columns, counts)


class _Growing:
    """What an order of a shard has so far, contexts in order."""

    def __init__(self, levels: int) -> None:
        self.pointers, self.followers = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        self.codes, self.weights = [_code(np.zeros(0), levels)], [np.zeros(0, np.uint16)]

    def add(self, own: np.ndarray, w: np.ndarray, parents: int) -> None:
        """Words `w` of `parents` more contexts, ascending for each."""
        widths = np.zeros(parents, np.int64)
        last = np.flatnonzero(np.append(own[1:] != own[:-1], True)) if len(own) else np.zeros(0, np.int64)
        widths[own[last]] = w[last] + 1
        ends = np.cumsum(widths) + self.pointers[-1][-1]
        self.followers.append((ends - widths)[own] + w)
        if parents:
            self.pointers.append(ends)

    def arrays(self) -> list[np.ndarray]:
        top = int(self.pointers[-1][-1]) + 1
        coded = [EliasFano.encode(np.concatenate(x), top).arrays() for x in (self.pointers, self.followers)]
        return [*coded[0], *coded[1], np.concatenate(self.codes), np.concatenate(self.weights)]


def _levels(ranges: Iterator[tuple[list[np.ndarray], np.ndarray]], order: int, none: int, totals, words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The arrays of a shard's file from its ranges of distinct windows in order; also its contexts of order 1 and their numbers of followers.

    `totals` gives the counts of word ids.
    """
    grown = [_Growing(COARSE if k == order - 1 else FINE) for k in range(1, order)]
    contexts, degrees_1 = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for columns, counts in ranges:
        met, parent = np.unique(columns[0], return_inverse=True)
        contexts.append(met)
        total = totals(met).astype(np.float64)
        for k, level in enumerate(grown, 1):
            word = columns[k]
            rows = np.flatnonzero(word != none)
            parent, word, counts, columns = parent[rows], word[rows], counts[rows], [c[rows] for c in columns]
            first = np.flatnonzero(np.concatenate([[True], (parent[1:] != parent[:-1]) | (word[1:] != word[:-1])])) if len(rows) else np.zeros(0, np.int64)
            node = np.zeros(len(rows), np.int64)
            node[first[1:]] = 1
            node = np.cumsum(node)
            own, w = parent[first], word[first]
            c = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            if total is None:  # contexts of order 2 and more: how often anything followed them
                total = np.bincount(own, c, parents)
            degrees = np.bincount(own, minlength=len(total))
            if k == 1:
                degrees_1.append(degrees)
            else:
                # the level below gets its weights: a context that nothing followed is passed over
                grown[k - 2].weights.append(_code(np.where(total > 0, DISCOUNT * degrees / np.maximum(total, 1), 1.0), FINE))
            level.add(own, w, len(total))
            level.codes.append(_code((c - DISCOUNT) / total[own], COARSE if k == order - 1 else FINE))
            parent, parents, total = node, len(own), None
    met = np.concatenate(contexts)
    arrays = EliasFano.encode(met, words).arrays()
    for level in grown:
        arrays += level.arrays()
    return arrays, met, np.concatenate(degrees_1)


def train(texts: DataFrame, *, text_col: str = "text", folder: str | None = None, shards: int | None = None, order: int = ORDER) -> Model:
    """Count `texts` and write the trie; its files stay in `folder` in the shared storage."""
    spark = texts.sparkSession
    folder = folder or shared_dir(spark)
    rows = texts.select(texts[text_col].alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        shards = 1 << max(3, (size // SHARD).bit_length())
    shift = _word_shift(shards)

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            edges = np.searchsorted(_word_shard(keys, shards), np.arange(shards + 1))
            found = [(s, keys[a:b].astype("<u8").tobytes(), _packed(counts[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            return _batch(found, ["shard", "words", "counts"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([np.zeros(0, U), *(x for x, _ in waiting)])
            return _counted(keys, np.concatenate([np.zeros(0, np.int64), *(n for _, n in waiting)]))

        for texts in _text_blocks(batches):
            waiting.append(np.unique(token_stream(texts)[0], return_counts=True))
            size += len(waiting[-1][0])
            if size > GATHER:
                waiting = [merged()]
                size = len(waiting[0][0])
                if size > GATHER // 2:
                    yield sent(*waiting.pop())
                    size = 0
        yield sent(*merged())

    def words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _by_shard(batches):
            hashes = np.concatenate([np.frombuffer(x, "<u8") for x, _ in parts])
            hashes, counts = _counted(hashes, np.concatenate([_unpacked(x) for _, x in parts]))
            wide = len(counts) and int(counts.max()) >= 1 << 32
            write_level(f"{folder}/words/{shard}", [*EliasFano.encode(_within(hashes, shift), 1 << shift).arrays(), counts.astype(np.uint64 if wide else np.uint32)])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(hashes)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["shard", "words", "tokens"])

    sent = rows.mapInArrow(words_out, "shard int, words binary, counts binary").repartitionById(shards, F.col("shard"))
    sizes = {r["shard"]: r for r in sent.mapInArrow(words_in, "shard int, words long, tokens long").collect()}
    bases = [0]
    for s in range(shards):
        bases.append(bases[-1] + (sizes[s]["words"] if s in sizes else 0))
    model = Model(folder, shards, tuple(bases), sum(r["tokens"] for r in sizes.values()), order)
    if not model.words:
        return model
    none = model.words
    names = ["contexts", "seconds", *(f"w{k}" for k in range(2, order)), "counts"]
    packed = ", ".join(f"{n} binary" for n in names)

    def grams_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model)
        end = int(words.find(np.array([END]))[0][0])
        waiting: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            held = []
            for column in waiting:
                held.append(np.concatenate(column))
                column.clear()
            by_shard = np.argsort(held[0], kind="stable")
            # some shards at a time
            for a, b in _slices(held[0][by_shard], SLICE):
                columns, counts = _distinct([c[by_shard[a:b]].astype(np.int64) for c in held[1:]], np.ones(b - a, np.int64))
                shard = pair_shard(columns[0], columns[1], shards)
                order_ = np.argsort(shard.astype(np.uint32), kind="stable")
                columns, counts = [c[order_] for c in columns], counts[order_]
                found = []
                for s, i, j in _stretches(shard[order_]):
                    first = np.diff(columns[0][i:j], prepend=0)  # ascending within a shard
                    found.append((s, _packed(first), *(_packed(c[i:j]) for c in columns[1:]), _packed(counts[i:j])))
                yield _batch(found, ["shard", *names])

        for texts in _text_blocks(batches):
            hashes, sizes = token_stream(texts)
            distinct, inverse = np.unique(hashes, return_inverse=True)
            columns = _windows(words.find(distinct)[0][inverse], sizes, end, order, none)
            shard = pair_shard(columns[0], columns[1], shards).astype(np.uint16 if shards <= 1 << 16 else np.uint32)
            for held, column in zip(waiting, [shard, *map(_narrow, columns)], strict=True):
                held.append(column)
            size += len(hashes)
            if size > GATHER:
                yield from sent()
                size = 0
        if size:
            yield from sent()

    def grams_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model)
        for shard, parts in _by_shard(batches):
            arrays, contexts, degrees = _levels(_merged(parts), order, none, words.totals, model.words)
            write_level(f"{folder}/grams/{shard}", arrays)
            # each context's number of followers, to the shard of the word
            owner = np.searchsorted(words.bases, contexts, "right") - 1
            yield _batch([(s, _packed(contexts[a:b]), _packed(degrees[a:b])) for s, a, b in _stretches(owner)], ["shard", "contexts", "degrees"])

    def weights_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model)
        for shard, parts in _by_shard(batches):
            base, end = model.bases[shard], model.bases[shard + 1]
            degrees = np.zeros(end - base, np.int64)
            for contexts, numbers in parts:
                degrees[_unpacked(contexts) - base] += _unpacked(numbers)
            counts = words.part(shard)[1]
            write_level(f"{folder}/weights/{shard}", [_code(DISCOUNT * degrees / np.maximum(counts, 1), FINE)])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    met = rows.mapInArrow(grams_out, f"shard int, {packed}").repartitionById(shards, F.col("shard"))
    degrees = met.mapInArrow(grams_in, "shard int, contexts binary, degrees binary").repartitionById(shards, F.col("shard"))
    degrees.mapInArrow(weights_in, "shard int").collect()
    return model


@lru_cache(maxsize=1)
def _words(model: Model) -> Words:
    """Opened once by each worker while a model is trained."""
    return Words(model, _Opened(), weights=False)


def _contexts(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The id before each token; before a text's first, the end token's."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "shard" else pa.binary()) for c, n in zip(columns, names, strict=True)], names=names)


# -- scoring --------------------------------------------------------------------


@lru_cache(maxsize=1)
def _opened(model: Model) -> tuple[Words, Grams]:
    opened = _Opened()
    return Words(model, opened, weights=True), Grams(model, opened)


def _shifted(a: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    out[by:] = a[: len(a) - by]
    return out


def _interpolated(model: Model, ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, end: int, end_weight: float, p: np.ndarray) -> np.ndarray:
    """Probability of each token after those before it in its text, from `p`, the words' own."""
    _, grams = _opened(model)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before, weight = _contexts(ids, sizes, end), _contexts(weights, sizes, end_weight)
    # pairs: each different one is looked up once
    both = np.flatnonzero((before >= 0) & (ids >= 0))
    shard, node, found, after = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
    if len(both):
        if model.words < 1 << 32:
            key, inverse = np.unique(before[both].astype(U) << U(32) | ids[both].astype(U), return_inverse=True)
            u, w = (key >> U(32)).astype(np.int64), (key & LOW).astype(np.int64)
        else:
            key, inverse = np.unique(np.stack([before[both], ids[both]]), axis=1, return_inverse=True)
            u, w = key
        for out, values in zip((shard, node, found, after), grams.pairs(u, w), strict=True):
            out[both] = values[inverse]
    p = np.where(before >= 0, found + weight * p, p)
    for k in range(3, model.order + 1):
        # the context of order k - 1 ended at the token before, in the same text
        context, home, weight = _shifted(node, 1, -1), _shifted(shard, 1, 0), _shifted(after, 1, 1.0)
        seen = (context >= 0) & (place >= k - 2)
        rows = np.flatnonzero(seen & (ids >= 0))
        shard, node, found, after = home, np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
        node[rows], found[rows], after[rows] = grams.longer(k, home[rows], context[rows], ids[rows])
        p = np.where(seen, found + weight * p, p)
    return p


def _scored(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, log10 probability under the words alone and under the trie of each text."""
    hashes, sizes = token_stream(texts)
    starts = np.cumsum(sizes) - sizes
    total = model.tokens + ADD * (model.words + 1)
    add = lambda x: np.add.reduceat(x, starts)
    if not model.words:
        single = np.full(len(hashes), ADD / total)
        return sizes, add(np.zeros(len(hashes), np.int64)), add(np.log10(single)), add(np.log10(single))
    distinct, inverse = np.unique(hashes, return_inverse=True)
    known = _opened(model)[0].find(distinct)
    ids, counts, weights = (x[inverse] for x in known)
    at = int(np.searchsorted(distinct, END))
    single = (counts + ADD) / total
    p = _interpolated(model, ids, sizes, weights, int(known[0][at]), float(known[2][at]), single)
    return sizes, add((counts > 0).astype(np.int64)), add(np.log10(single)), add(np.log10(p))


def _gathered(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The texts of a batch in lists of about `most` bytes, so that a shard's pages are visited for many at once."""
    block: list[bytes] = []
    size = 0
    for texts in blocks(batch.column(0)):
        block += texts
        size += sum(map(len, texts))
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Id, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` of each document."""
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].alias("id"), held.alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_scored(model, texts) for texts in _gathered(batch)]
            n_tokens, n_known, base, full = (np.concatenate(x) if x else np.zeros(0) for x in (zip(*parts, strict=True) if parts else ((), (), (), ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([model.tokens] * len(n_tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())],
                names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def is_held_out(doc_id: Column, folds: int = 10) -> Column:
    """Whether the CRC-32 of the id as text is divisible by `folds`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10.0, -score / n_tokens)
