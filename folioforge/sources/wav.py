"""WAV files as binary columns: made, merged, measured, tagged and decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 24_000


def make(pcm: bytes, *, rate: int = RATE, width: int = 2, channels: int = 1) -> bytes:
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * width * channels, width * channels, 8 * width)
    body = b"WAVE" + _chunk(b"fmt ", fmt) + _chunk(b"data", pcm)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def parts(wav: bytes) -> list[tuple[bytes, bytes]]:
    """The chunks of a file."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    found, at = [], 12
    while at + 8 <= len(wav):
        size = struct.unpack("<I", wav[at + 4 : at + 8])[0]
        found.append((wav[at : at + 4], wav[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return found


def describe(wav: bytes) -> tuple[int, int, int, bytes]:
    """Channels, rate, bytes of a sample and PCM data."""
    own = dict(parts(wav))
    _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", own[b"fmt "][:16])
    return channels, rate, bits // 8, own.get(b"data", b"")


def duration(wav: bytes) -> float:
    channels, rate, width, pcm = describe(wav)
    return len(pcm) // (channels * width) / rate


def tagged(wav: bytes, tags: Mapping[str, str]) -> bytes:
    """The file with its old tags dropped and new ones, in order of their names, at the end."""
    kept = b"".join(_chunk(n, d) for n, d in parts(wav) if not (n == b"LIST" and d[:4] == b"INFO"))
    info = b"".join(_chunk(k.encode("ascii"), v.encode() + b"\0") for k, v in sorted(tags.items()) if v)
    body = b"WAVE" + kept + (_chunk(b"LIST", b"INFO" + info) if info else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples(pcm: bytes, width: int) -> np.ndarray:
    """Little-endian samples of 1 to 4 bytes as numbers; those of one byte are centred on 128."""
    if width == 1:
        return np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    if width == 3:
        b = np.frombuffer(pcm[: len(pcm) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
        value = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return value - ((value >> 23) << 24)
    return np.frombuffer(pcm[: len(pcm) // width * width], f"<i{width}").astype(np.int64)


def synthesized(rewrites: DataFrame, keys: list[str], *, text_col: str = "text") -> DataFrame:
    """The mock speech provider: a silent file, 0.1 s long, for each text, with `wav` and `duration_seconds`."""
    silent = make(b"\0" * 4800)
    return rewrites.select(*keys, F.lit(silent).alias("wav"), F.lit(duration(silent)).alias("duration_seconds"))


def merged(audio: DataFrame, book: str, order: list[str]) -> DataFrame:
    """One file for each book from its parts' samples in order; parts must agree in format."""
    kind = audio.schema[book].dataType.simpleString()
    grouped = audio.groupBy(F.col(book).alias("book")).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "wav"))), lambda x: x["wav"]).alias("wavs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for wavs in batch.column(1).to_pylist():
                told = [describe(w) for w in wavs]
                if len({t[:3] for t in told}) > 1:
                    raise ValueError("audio parts differ in format")
                channels, rate, width, _ = told[0]
                out.append(make(b"".join(t[3] for t in told), rate=rate, width=width, channels=channels))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["book", "wav"])

    return grouped.mapInArrow(run, f"book {kind}, wav binary").withColumnRenamed("book", book)
