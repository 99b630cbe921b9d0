import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioforge.llm import byte_bpe, token_counts
from folioforge.llm.byte_bpe import RankQueue, codec, decode_documents, encode_documents, round_trip
from folioforge.llm.token_counts import count_tokens, counter

from .conftest import TEXTS

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(5)
    pools = [range(32, 127), range(0x80, 0x600), range(0x2000, 0x3100), range(0xA000, 0xD7FF), range(0x10000, 0x1F700), [32, 9, 10, 13, 0x1C, 0x85, 0xA0]]
    return ["".join(chr(r.choice(r.choice(pools))) for _ in range(120)) for _ in range(150)] + ["a<|endoftext|> b<|endoftext|>", "aaaa" * 999]


def test_counts_equal_the_library():
    tokenizer = Tokenizer.from_file(JSON)
    for text in [t or "" for _, t in TEXTS] + odd_texts():
        assert counter(JSON, P.PATTERN).count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text[:80]


def test_ids_equal_the_library(library):
    bpe = codec(RANKS, P.PATTERN)
    for text in [t or "" for _, t in TEXTS] + odd_texts():
        ids = bpe.encode(text)
        assert ids == library.encode_ordinary(text), text[:80]
        assert bpe.decode(ids) == text.encode()


def test_rank_queue_gives_lowest_rank_then_leftmost():
    r, queue = random.Random(1), RankQueue(5000)
    items = [(r.randrange(5000), k) for k in range(3000)]
    r.shuffle(items)
    for rank, position in items:
        queue.push(rank, position)
    assert [queue.pop() for _ in items] == sorted(items)
    assert not queue.top


def test_few_spans_wait_that_are_not_merged(library):
    """Of the spans of a pre-token only those wait that can be next, so hardly more are popped than merged."""

    class Counting(dict):
        popped = 0

        def __delitem__(self, rank):
            self.popped += 1
            super().__delitem__(rank)

    bpe, r = byte_bpe.ByteBPE(RANKS, P.PATTERN), random.Random(2)
    bpe.queue.buckets = popped = Counting()
    tokens = list(bpe.ranks)
    pieces = [b"".join(r.choices(tokens, k=r.randint(2, 6))) for _ in range(400)]
    pieces += [bytes(r.choices(b"etaoinshrdlu", k=12)) for _ in range(2000)]
    merged = 0
    for piece in pieces:
        ids = bpe.merge(piece)
        assert ids == library._encode_single_piece(piece)
        merged += len(piece) - len(ids) if len(ids) > 1 else 0
    assert popped.popped < 1.3 * merged


def test_edge_rows(edge_docs, empty_docs):
    rows = count_tokens(edge_docs, JSON, P.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_bytes"], by[1]["n_tokens"], by[1]["over_limit"]) == (0, 0, False)
    assert by[6]["over_limit"] and by[9]["n_tokens"] == by[10]["n_tokens"]
    assert count_tokens(empty_docs, JSON, P.PATTERN).count() == 0
    trip = {r["doc_id"]: r for r in round_trip(edge_docs, RANKS, P.PATTERN).collect()}
    for doc_id, text in TEXTS:
        assert trip[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert trip[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert round_trip(empty_docs, RANKS, P.PATTERN).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_encode_then_decode(edge_docs):
    encoded = encode_documents(edge_docs, RANKS, P.PATTERN, keep=["doc_id", "n_tokens"])  # a result replaces the clashing column
    assert encoded.columns == ["doc_id", "ids", "n_tokens"]
    back = {r["doc_id"]: bytes(r["data"]) for r in decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in TEXTS}


def test_caches_are_bounded_in_bytes(monkeypatch, library):
    """A corpus of long pre-tokens, none of them twice, leaves little behind."""
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 1 << 20)
    tokenizer, count = Tokenizer.from_file(JSON), token_counts.MergeCounter(JSON, P.PATTERN)
    bpe = byte_bpe.ByteBPE(RANKS, P.PATTERN, 1 << 20)
    r = random.Random(9)
    for k in range(40):
        text = " ".join("".join(r.choices("abcdefgh", k=r.choice((3, 900, 5000)))) for _ in range(60))
        assert count.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert bpe.encode(text) == library.encode_ordinary(text)
        for held in (count, bpe):
            assert sum(len(x) for x in held.cache) < 2 << 20 and not any(len(x) > 4096 for x in held.cache)
