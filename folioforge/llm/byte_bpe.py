"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Positions of a linked list of byte spans wait in one bucket for each merge rank.
A bitmap says which buckets hold anything and a second one which words of the
first are not zero; find-first-set on the two picks the lowest rank in constant
time, whatever the length of the pre-token, and stale positions are skipped when
they come up.  Only spans whose rank is the least beside them wait, about one for
each merge.

`encode_documents` adds the ids, `decode_documents` turns ids back into bytes,
`round_trip` does both and returns digests.  Documents are handled where they
are read: no shuffle; memory is bounded by an Arrow batch and a cache of so many bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; the id
column may be null; repeated rows give repeated results; an empty table gives an
empty result; other columns are dropped unless named in `keep`, and a kept
column that has the name of a result column is replaced by the result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.pretoken import LETTER, NUMBER, OTHER, SPACE, Splitter

#: Bytes of encoded pre-tokens that a worker remembers, about; the cache starts anew when full.
CACHE = 96 << 20
#: Bytes of an entry besides its pre-token and ids, and longest pre-token that is remembered.
ENTRY, LONGEST = 240, 1 << 12
#: Bits of one bitmap word are 2 to this power.
SHIFT = 8
MASK = (1 << SHIFT) - 1
#: The bits of a word.
BITS = [1 << k for k in range(1 << SHIFT)]


class RankQueue:
    """The lowest rank first, and the leftmost position of that rank.

    `ByteBPE.merge` takes these steps in place, as calls would be a sixth of its time.
    """

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> SHIFT) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank >> SHIFT
            self.top |= 1 << word
            self.low[word] |= 1 << (rank & MASK)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The next rank and position; the caller knows that there is one."""
        word = (self.top & -self.top).bit_length() - 1
        low = self.low[word]
        rank = (word << SHIFT) + (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        low &= low - 1
        self.low[word] = low
        if not low:
            self.top &= self.top - 1
        return rank, bucket[0]


class ByteBPE:
    """Encoder and decoder for a rank file (`.tiktoken`)."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE) -> None:
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        #: Stands for no rank, above all of them.
        self.none = max(self.ranks.values()) + 1
        self.names = [str(rank) for rank in range(self.none)]
        self.queue = RankQueue(self.none)
        self.single = {piece[0]: rank for piece, rank in self.ranks.items() if len(piece) == 1}
        #: Ranks of two bytes, by the first and the second.
        self.double = [[self.none] * 256 for _ in range(256)]
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                self.double[piece[0]][piece[1]] = rank
        single = {bytes([b]): b for b in range(256)}
        self._is = [
            (tiktoken.Encoding("class", pat_str=p, mergeable_ranks=single, special_tokens={}), plain)
            for p, plain in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE))
        ]
        self.splitter = Splitter(pattern, self._class)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.most, self.held = cache, 0

    def _class(self, char: str) -> str:
        return next((plain for e, plain in self._is if e.encode_ordinary(char)), OTHER)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token.

        `wanted` has the rank of each span joined with the next one.  A span waits
        while its rank is below that of the span before and not above that of the one
        after: the lowest rank's leftmost span is always such a one.  A merge changes
        the rank of its own span `i` and of `h` before it, so these may begin to wait,
        or else their neighbours `k` and `g`, which did not before.
        """
        get = self.ranks.get
        whole = get(data)
        if whole is not None:
            return [whole]
        n, none, double = len(data), self.none, self.double
        ids = list(map(self.single.__getitem__, data))
        after = [*range(1, n + 2)]
        before = [*range(-1, n)]
        wanted = [double[a][b] for a, b in pairwise(data)]
        wanted += (none, none, none)  # the last one also stands before the first
        bits, buckets, low, top = BITS, self.queue.buckets, self.queue.low, 0
        left = rank = none
        for i, right in enumerate(wanted, -1):
            if left > rank <= right:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so still a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> SHIFT
                    top |= 1 << word
                    low[word] |= bits[rank & MASK]
            left, rank = rank, right
        while top:
            word = (top & -top).bit_length() - 1
            held = low[word]
            rank = (word << SHIFT) + (held & -held).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[word] = held = held & (held - 1)
                if not held:
                    top &= top - 1
            if wanted[i] != rank:
                continue
            ids[i] = rank
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            gone, wanted[j] = wanted[j], none
            here = wanted[i] = get(data[i : after[k]], none) if k < n else none
            lead = first = second = none
            at = beside = h = before[i]
            if h >= 0:
                was = wanted[h]
                lead = wanted[h] = get(data[h:k], none)
                g = before[h]
                rank = wanted[g]
                if lead < rank:
                    if lead <= here:
                        first = lead
                elif was < rank < wanted[before[g]]:
                    first, at = rank, g
            rank = wanted[k]
            if here <= rank:
                if here < lead:
                    second, beside = here, i
            elif gone <= rank <= wanted[after[k]]:
                second, beside = rank, k
            for rank, i in ((first, at), (second, beside)):
                if rank < none:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> SHIFT
                        top |= 1 << word
                        low[word] |= bits[rank & MASK]
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for pieces in self.splitter.lists(text):
            if self.held > self.most:
                cache.clear()
                self.held = 0
            found = list(map(cache.get, pieces))
            long: dict[str, tuple[int, ...]] = {}
            for k in [k for k, ids in enumerate(found) if ids is None]:
                piece = pieces[k]
                ids = cache.get(piece) or long.get(piece)
                if ids is None:
                    ids = tuple(self.merge(piece.encode()))
                    if len(piece) > LONGEST:
                        long[piece] = ids
                    else:
                        cache[piece] = ids
                        self.held += ENTRY + 4 * len(piece) + 8 * len(ids)
                found[k] = ids
            out.extend(chain.from_iterable(found))
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, cache: int = CACHE) -> ByteBPE:
    return ByteBPE(path, pattern, cache)


def _mapped(docs: DataFrame, columns: list[str], keep: Sequence[str], made: list[tuple[str, str, pa.DataType]], row: Callable[..., tuple]) -> DataFrame:
    """Add the columns `made` by `row` from the values of `columns`, after those of `keep`."""
    keep = [c for c in keep if c not in {name for name, _, _ in made}]
    picked = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *[docs[c].alias(f"v{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results: list[list] = [[] for _ in made]
            for values in zip(*(batch.column(len(keep) + i) for i in range(len(columns))), strict=True):
                for got, value in zip(results, row(*(v.as_py() for v in values)), strict=True):
                    got.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(got, kind) for got, (_, _, kind) in zip(results, made, strict=True)],
                names=[f"k{i}" for i in range(len(keep))] + [f"m{i}" for i in range(len(made))],
            )

    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + [f"m{i} {kind}" for i, (_, kind, _) in enumerate(made)])
    return picked.mapInArrow(run, schema).toDF(*keep, *[name for name, _, _ in made])


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of `keep`, then `ids` (array of int) and `n_tokens`."""

    def row(text: str | None) -> tuple:
        ids = codec(vocabulary, pattern).encode(text or "")
        return ids, len(ids)

    return _mapped(docs, [text_col], keep, [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "long", pa.int64())], row)


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str, *, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of `keep`, then `data` (binary); null ids decode to no bytes."""

    def row(ids: list[int] | None) -> tuple:
        return (codec(vocabulary, pattern).decode(ids or []),)

    return _mapped(encoded, [ids_col], keep, [("data", "binary", pa.binary())], row)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",), cache: int = CACHE) -> DataFrame:
    """Columns of `keep`, then `n_tokens`, `ids_sha256` and `decoded_sha256` of ids encoded and decoded again."""

    def row(text: str | None) -> tuple:
        bpe = codec(vocabulary, pattern, cache)
        ids = bpe.encode(text or "")
        digest = hashlib.sha256(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest()
        return len(ids), digest, hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, [text_col], keep, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], row)
