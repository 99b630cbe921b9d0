"""Providers of text and speech behind a protocol, called once for each distinct request.

Requests are deduplicated by key before the call and answers joined back, so a
group of copies is one call.  Calls run in `mapInArrow`, each task with a limiter
of its own at its share of the rate, and with retries; they must be idempotent,
as Spark may run a task again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.requests import cache_key


class Provider(Protocol):
    def answer(self, text: str) -> str: ...


class Mock:
    """A pure function of its input, so that answers can be told apart and checked."""

    def __init__(self, language: str) -> None:
        self.language = language

    def answer(self, text: str) -> str:
        return f"[{self.language}] {text}"


class ProviderError(Exception):
    def __init__(self, kind: str) -> None:
        super().__init__(kind)
        self.kind = kind


#: Providers by id; others may be added.
REGISTRY: dict[str, Callable[[str], Provider]] = {"mock": Mock}
RETRYABLE = ("timeout", "transport", "rate_limited", "server_error")


class Limiter:
    """At least `seconds` between two starts."""

    def __init__(self, seconds: float, clock=time.monotonic, sleep=time.sleep) -> None:
        self.seconds, self.clock, self.sleep, self.next = seconds, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.seconds


def with_retries(call: Callable[[], str], *, retries: int = 2, base: float = 0.5, most: float = 4.0, sleep=time.sleep) -> tuple[str, int]:
    """The answer and how often it was asked for again."""
    for attempt in range(retries + 1):
        try:
            return call(), attempt
        except ProviderError as error:
            if error.kind not in RETRYABLE or attempt == retries:
                raise
            sleep(min(most, base * 2**attempt))
    raise AssertionError


def call_provider(requests: DataFrame, provider_id: str, language: str, *, key_col: str = "doc_id", text_col: str = "text", interval: float = 0.0) -> DataFrame:
    """`key_col`, `answer`, `retries` for each request; requests of one key share a call."""
    if provider_id not in REGISTRY:
        raise ValueError(f"unknown provider {provider_id!r}; known: {', '.join(sorted(REGISTRY))}")
    factory = REGISTRY[provider_id]
    keyed = requests.select(F.col(key_col).alias("r"), F.col(text_col).alias("text"), cache_key(F.col(text_col), provider=provider_id).alias("k"))
    calls = keyed.groupBy("k").agg(F.min_by("text", "r").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider, limiter = factory(language), Limiter(interval)
        for batch in batches:
            answers, again = [], []
            for text in batch.column(1).to_pylist():
                limiter.wait()
                answer, n = with_retries(lambda: provider.answer(text or ""))  # noqa: B023
                answers.append(answer)
                again.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(again, pa.int64())], names=["k", "answer", "retries"])

    answered = calls.mapInArrow(run, "k string, answer string, retries long")
    return keyed.select("r", "k").join(answered, "k").select(F.col("r").alias(key_col), "answer", "retries")
