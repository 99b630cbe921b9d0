"""Media columns: payloads stored as content-defined chunks and rebuilt from them.

A payload becomes a WAV file of one channel of 8-bit samples.  A rolling gear
hash cuts the file into chunks where its high bits are zero, so equal passages
give equal chunks wherever they stand.  Chunks are stored once for each digest;
a medium is an ordered list of digests.  Joins on the digest bring shared chunks
back, each chunk is verified against its digest and each medium against its own,
and only then is anything computed from it.

A chunk that is met more than once lies in a pool, one row for each digest; the
others lie with their medium, packed together.  Which chunks those are comes from
the digests alone, before any bytes are moved.  Media and pool are tables in the
shared folder: a medium's row is written by the task that read its text, so bytes
of chunks that stand in one place move to storage and nowhere else, and only media
with pooled chunks are joined with the pool.  Everything computed comes from the
stored bytes, read back.  A medium is rebuilt in one row, as it is held in one row
of the input.

Defined cases: a null or empty text is a payload of padding alone; repeated rows
and equal texts share one medium and give equal values; an empty table gives an
empty result; extra columns are ignored and can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import presence, present, saved, shared_dir

#: Payloads are padded with this byte to a positive multiple of `UNIT`.
PAD, UNIT = b" ", 192
#: Chunk sizes, for texts: no cut before so many bytes, one at so many, and a cut where so many bits of the hash are zero.
SIZES = 256, 4096, 9
#: Bytes of a chunk's digest (of SHA-256).
DIGEST = 16
#: Media that a task remembers to chunk and store copies once.
REMEMBER = 1 << 17
SAMPLE_RATE = 8000
#: Gear table: 256 pseudo-random 32-bit numbers from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(20_011)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
HEADER = 44


def payload_of(text: str | None) -> tuple[bytes, int]:
    """Padded payload of a text and its unpadded length."""
    data = (text or "").encode()
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data.ljust(size, PAD), len(data)


def to_wav(payload: bytes) -> bytes:
    """Payload bytes as unsigned 8-bit samples of one channel."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n)
    return head + payload


def from_wav(media: bytes) -> bytes:
    """Samples of a file that `to_wav` made; anything else is an error."""
    riff, size, wave, fmt, _, kind, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data") or (kind, channels, bits) != (1, 1, 8) or n != len(media) - HEADER or size != n + 36:
        raise ValueError("not a stored medium")
    return media[HEADER:]


def gear_hash(data: bytes) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 32 bytes' gears, each shifted by its age."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for age in (1, 2, 4, 8, 16):
        older = h[:-age] << np.uint32(age)
        h = h.copy()
        h[age:] += older
    return h


def cut_points(data: bytes, sizes: tuple[int, int, int] = SIZES) -> list[int]:
    """Ends of the chunks of `data`."""
    n = len(data)
    least, most, bits = sizes
    if n <= least:
        return [n] if n else []
    # the high bits depend on all of the last 32 bytes
    found = np.flatnonzero(gear_hash(data) >> np.uint32(32 - bits) == 0) + 1
    cuts, start = [], 0
    while n - start > least:
        at = int(np.searchsorted(found, start + least))
        end = min(start + most, n, int(found[at]) if at < len(found) else n)
        cuts.append(end)
        start = end
    if start < n:
        cuts.append(n)
    return cuts


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST]


def _chunks(media: bytes, sizes: tuple[int, int, int]) -> list[bytes]:
    ends = cut_points(media, sizes)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class _Met:
    """Media that a task has seen, forgotten when they are many."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def again(self, digest: bytes) -> bool:
        if digest in self.seen:
            return True
        if len(self.seen) >= REMEMBER:
            self.seen.clear()
        self.seen.add(digest)
        return False


def chunk_counts(docs: DataFrame, *, text_col: str = "text", sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """How often each `chunk` is met (`n`); of copies that a task meets, the first alone counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in batches:
            names: list[bytes] = []
            for value in batch.column(0):
                media = to_wav(payload_of(value.as_py())[0])
                if not met.again(hashlib.sha256(media).digest()):
                    names += map(chunk_digest, _chunks(media, sizes))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["chunk"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "chunk binary").groupBy("chunk").agg(F.count("*").alias("n"))


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:7])


def _stored(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, int, int], pooled: Broadcast) -> DataFrame:
    """Of each document `id`, `n_bytes` and `media` (its digest); with the first of copies that a task meets, the medium.

    That is its ordered `chunks`, their `sizes`, how many are `pooled`, and the others' bytes, `own`.
    """
    names = ["id", "n_bytes", "media", "chunks", "sizes", "pooled", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=True)
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        met = _Met()
        for batch in batches:
            rows: list[tuple] = []
            start = held = 0
            for k, value in enumerate(batch.column(1), 1):
                payload, size = payload_of(value.as_py())
                media = to_wav(payload)
                digest = hashlib.sha256(media).digest()
                if met.again(digest):
                    rows.append((size, digest, None, None, None, None))
                else:
                    chunks = _chunks(media, sizes)
                    digests = [chunk_digest(x) for x in chunks]
                    common = present(pooled, np.array([_slot(x) for x in digests], np.int64))
                    own = b"".join(x for x, there in zip(chunks, common, strict=True) if not there)
                    rows.append((size, digest, digests, [len(x) for x in chunks], int(common.sum()), pack.compress(own) if own else None))
                    held += len(rows[-1][-1] or b"") + 64 * len(digests)
                if held > 8 << 20 or k == batch.num_rows:
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), *columns], names=names)
                    start, held, rows = k, 0, []

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_bytes long, media binary, chunks array<binary>, sizes array<int>, pooled int, own binary")


def _pool(docs: DataFrame, text_col: str, sizes: tuple[int, int, int], pooled: Broadcast) -> DataFrame:
    """The bytes of pooled chunks (`chunk`, `packed`), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6, write_checksum=False, write_content_size=True)
        media_met, chunks_met = _Met(), _Met()
        for batch in batches:
            out: dict[bytes, bytes] = {}
            for value in batch.column(0):
                media = to_wav(payload_of(value.as_py())[0])
                if media_met.again(hashlib.sha256(media).digest()):
                    continue
                chunks = _chunks(media, sizes)
                names = [chunk_digest(x) for x in chunks]
                common = present(pooled, np.array([_slot(x) for x in names], np.int64))
                for name, chunk, there in zip(names, chunks, common, strict=True):
                    if there and not chunks_met.again(name):
                        out[name] = pack.compress(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], names=["chunk", "packed"])

    sent = docs.select(docs[text_col].alias("text")).mapInArrow(run, "chunk binary, packed binary")
    return sent.groupBy("chunk").agg(F.first("packed").alias("packed"))


class Store(NamedTuple):
    """A written chunk store: documents with their media, media with their chunks, and the pool of common chunks."""

    documents: DataFrame
    media: DataFrame
    pool: DataFrame


def store(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int, int] = SIZES) -> Store:
    """Write the chunk store of `docs` in `folder`, which is shared.

    A chunk that is met more than once is pooled, and so is any other whose bit of
    the bitmap that tells tasks so is set; so the pool has every chunk whose bit is.
    """
    slot = F.conv(F.hex(F.substring("chunk", 1, 7)), 16, 10).cast("long").alias("slot")
    common = chunk_counts(docs, text_col=text_col, sizes=sizes).where("n > 1").select(slot)
    pooled = presence(saved(common, f"{folder}/common"), "slot")
    stored = saved(_stored(docs, id_col, text_col, sizes, pooled), f"{folder}/media")
    pool = saved(_pool(docs, text_col, sizes, pooled), f"{folder}/pool")
    return Store(stored.select("id", "n_bytes", "media"), stored.where("chunks IS NOT NULL").drop("id", "n_bytes"), pool)


def features_of(payload: bytes) -> str:
    """Size, mean, standard deviation, range, rate of mean crossings and byte entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    level = float(np.dot(counts, np.arange(256))) / len(x)
    spread = float(np.dot(counts, (np.arange(256) - level) ** 2) / len(x)) ** 0.5
    above = x > level
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    entropy = abs(float((p * np.log2(p)).sum()))
    return f"samples={len(x)};mean={level:.4f};std={spread:.4f};min={x.min()};max={x.max()};crossings={crossings};entropy={entropy:.4f}"


def _read_back(media: DataFrame) -> DataFrame:
    """Rebuild media from `chunks`, `sizes`, `own` and `loans`, verify them and describe them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for digest, chunks, lengths, own, loans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lent = {x["chunk"]: unpack.decompress(x["packed"]) for x in loans or ()}
                rest = unpack.decompress(own) if own else b""
                pieces, at = [], 0
                for name, length in zip(chunks, lengths, strict=True):
                    piece = lent.get(name)
                    if piece is None:
                        piece, at = rest[at : at + length], at + length
                    if chunk_digest(piece) != name:
                        raise ValueError("a stored chunk is damaged")
                    pieces.append(piece)
                whole = b"".join(pieces)
                if hashlib.sha256(whole).digest() != digest:
                    raise ValueError("a stored medium is damaged")
                payload = from_wav(whole)
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(whole), digest.hex(), features_of(payload), len(pieces)))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    picked = media.select("media", "chunks", "sizes", "own", "loans")
    return picked.mapInArrow(run, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long")


def rebuild(stored: Store) -> DataFrame:
    """Every medium of a store from its stored bytes.

    Rows: `media`, `payload_bytes`, `payload_sha256`, `tail_crc32`, `media_bytes`,
    `media_sha256`, `feature`, `n_chunks`.
    """
    lent = "array<struct<chunk: binary, packed: binary>>"
    alone = stored.media.where("pooled = 0").withColumn("loans", F.lit(None).cast(lent))
    others = stored.media.where("pooled > 0").groupBy("media").agg(*[F.first(c).alias(c) for c in ("chunks", "sizes", "own")])
    asked = others.select("media", F.explode(F.array_distinct("chunks")).alias("chunk"))
    loans = asked.join(stored.pool, "chunk").groupBy("media").agg(F.collect_list(F.struct("chunk", "packed")).alias("loans"))
    described = _read_back(alone).union(_read_back(others.join(loans, "media")))
    return described.dropDuplicates(["media"])  # copies that different tasks stored whole


def store_and_rebuild(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """Every document's medium through the store and back: id, `n_bytes` and the columns of `rebuild`."""
    stored = store(docs, shared_dir(docs.sparkSession), id_col=id_col, text_col=text_col, sizes=sizes)
    joined = stored.documents.join(rebuild(stored), "media")
    return joined.drop("media").withColumnRenamed("id", id_col)
