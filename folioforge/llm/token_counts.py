"""Token counts by heap-and-linked-list byte-pair merging.

`count_tokens` adds `n_bytes`, `n_tokens` and `over_limit` to documents.  Each
pre-token is a doubly linked list of symbols; a heap holds the adjacent pairs
that can merge, keyed by merge rank and position.  The lowest is popped again
and again, stale entries are passed over, and every merge takes one from the
count.  No identifier is emitted: the count is initial symbols minus merges.

Documents are counted where they are read: no shuffle, and memory is bounded by
one Arrow batch and a cache of `CACHE_BYTES` of pre-token counts for each worker.

Defined cases: a null or empty text counts 0 bytes and 0 tokens and isn't over
any limit; a null id stays null; repeated rows give repeated results; an empty
table gives an empty result.  Result columns replace input columns of the same
name when `keep` carries them, so clashing extra columns don't matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.pretoken import LETTER, NUMBER, OTHER, SPACE, Splitter

#: Bytes of pre-token counts that a worker remembers, about; the cache starts anew when full.
CACHE_BYTES = 96 << 20
#: Bytes of an entry besides its pre-token, and longest pre-token that is remembered.
ENTRY, LONGEST = 180, 1 << 12


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte.

    Bytes that print in Latin-1 stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of texts under the merges of a `.json` vocabulary."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_alphabet()
        self.symbol = [vocab[alphabet[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self._pre = Tokenizer.from_file(path).pre_tokenizer
        self.splitter = Splitter(pattern, self._class)
        self.cache: dict[str, int] = {}
        self.held = 0

    def _class(self, char: str) -> str:
        for plain in (LETTER, NUMBER, OTHER):
            if len(self._pre.pre_tokenize_str(plain + char)) == 1:
                return plain
        return SPACE

    def merged(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        symbols = [self.symbol[b] for b in data]
        n = count = len(symbols)
        pairs = self.pairs
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            hit = pairs.get((symbols[i], symbols[i + 1]))
            if hit:
                heap.append((hit[0], i))
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            left = symbols[i]
            j = after[i]
            if left < 0 or j >= n:
                continue
            hit = pairs.get((left, symbols[j]))
            if hit is None or hit[0] != rank:
                continue
            symbols[i], symbols[j] = hit[1], -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                follow = pairs.get((hit[1], symbols[k]))
                if follow:
                    heappush(heap, (follow[0], i))
            h = before[i]
            if h >= 0:
                lead = pairs.get((symbols[h], hit[1]))
                if lead:
                    heappush(heap, (lead[0], h))
        return count

    def _plain(self, text: str) -> int:
        total, cache = 0, self.cache
        for pieces in self.splitter.lists(text):
            if self.held > CACHE_BYTES:
                cache.clear()
                self.held = 0
            long: dict[str, int] = {}
            for piece in set(pieces).difference(cache):
                n = self.merged(piece.encode())
                if len(piece) > LONGEST:
                    long[piece] = n
                else:
                    cache[piece] = n
                    self.held += ENTRY + 4 * len(piece)
            if long:
                total += sum(long[p] if p in long else cache[p] for p in pieces)
            else:
                total += sum(map(cache.__getitem__, pieces))
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token, as the library has it."""
        return self._count(text, 0)

    def _count(self, text: str, level: int) -> int:
        if level == len(self.specials):
            return self._plain(text) if text else 0
        if self.specials[level] not in text:
            return self._count(text, level + 1)
        parts = text.split(self.specials[level])
        return len(parts) - 1 + sum(self._count(x, level + 1) for x in parts)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> MergeCounter:
    return MergeCounter(path, pattern)


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    *,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Count the tokens of each document; `vocabulary` is a path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = counter(vocabulary, pattern)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(merge.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
