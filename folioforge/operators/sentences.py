"""The sentence kernel: where a text may be cut, and chunks, plans and repairs made with it.

These scans depend on what was cut before, so they are plain functions of one
text (a chapter), which `apply_per_row` runs over Arrow batches; nothing is
shuffled, as a chapter is one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Abbreviations that end in a dot without ending a sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof sr jr st vs etc fig no al".split())
CLOSERS, OPENERS = "\"')]}»”", "\"'([{«“"
#: A cut is sought back to this share of the target, and forward by that share beyond it.
BACK, FORWARD = 0.6, 0.35
ACRONYM = re.compile(r"(?:[A-Za-z]\.){2,}\Z")
BUDGET, CEILING = 6500, 9300

COMPLETE, CHAPTER_END = "sentence_complete", "chapter_end"
FORCED, REPAIRED = "forced_split_no_sentence_boundary", "sentence_boundary_repaired"


def is_boundary(text: str, at: int) -> bool:
    """Whether the mark at `at` ends a sentence."""
    mark = text[at]
    if mark != ".":
        return mark in "!?"
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if before.isdigit() and after.isdigit():
        return False
    start = at
    while start and text[start - 1].isalpha():
        start -= 1
    if text[start:at].lower() in ABBREVIATIONS:
        return False
    return not ACRONYM.search(text[max(0, at - 8) : at + 1])


def with_tail(text: str, at: int, limit: int | None = None) -> int:
    """The end of a sentence whose mark is at `at`: closing marks, then white space, go with it."""
    end = at + 1
    limit = len(text) if limit is None else limit
    while end < limit and text[end] in CLOSERS:
        end += 1
    while end < limit and text[end].isspace():
        end += 1
    return end


def _cut(text: str, start: int, target: int) -> tuple[int, str]:
    n, goal = len(text), start + target
    if goal >= n:
        return n, CHAPTER_END
    least = max(start, start + int(BACK * target))
    for mark in ".!?":
        at = text.rfind(mark, least, goal)
        while at >= 0:
            if is_boundary(text, at):
                return with_tail(text, at), COMPLETE
            at = text.rfind(mark, least, at)
    limit = min(n, goal + max(1, int(FORWARD * target)))
    for mark in ".!?":
        at = text.find(mark, goal, limit)
        while at >= 0:
            if is_boundary(text, at):
                return with_tail(text, at), COMPLETE
            at = text.find(mark, at + 1, limit)
    for k in range(goal, limit):
        if text[k].isspace():
            return k + 1, FORCED
    for k in range(goal - 1, start, -1):
        if text[k].isspace():
            return k + 1, FORCED
    return (limit if limit > start else goal), FORCED


def chunks(text: str, target: int) -> list[tuple[int, int, str]]:
    """Start, end and strategy of each chunk; together they are the text."""
    found, start = [], 0
    while target > 0 and start < len(text):
        end, how = _cut(text, start, target)
        found.append((start, end, how))
        start = end
    return found


def paragraphs(text: str) -> list[tuple[int, int, str]]:
    """Raw start and end, and stripped text, of the paragraphs between blank lines."""
    found, start = [], 0
    for gap in [*re.finditer(r"\n\s*\n", text), None]:
        end = gap.start() if gap else len(text)
        body = text[start:end].strip()
        if body:
            found.append((start, end, body))
        start = gap.end() if gap else end
    return found


def split_unit(text: str, title: str, budget: int) -> list[tuple[str, int, int]]:
    """A unit's parts under a budget: whole paragraphs packed greedily, longer ones cut at sentences."""
    body = text.strip()
    if len(body) <= budget:
        return [(body or title, 0, len(text))]
    out: list[tuple[str, int, int]] = []
    pack: list[tuple[int, int, str]] = []

    def flush() -> None:
        if pack:
            out.append(("\n\n".join(p[2] for p in pack), pack[0][0], pack[-1][1]))
            pack.clear()

    for start, end, paragraph in paragraphs(text):
        if len(paragraph) > budget:
            flush()
            for a, b, _ in chunks(paragraph, budget):
                piece = paragraph[a:b].strip()
                if piece:
                    out.append((piece, start + a, start + b))
            continue
        if pack and sum(len(p[2]) + 2 for p in pack) + len(paragraph) > budget:
            flush()
        pack.append((start, end, paragraph))
    flush()
    return out


def plan(units: Sequence[tuple[int, int, str, str]], budget: int = BUDGET) -> list[tuple[int, int, str, list[int]]]:
    """Chapter, segment in the chapter, text and source orders of the planned segments.

    `units`: order, chapter, title and text, in order.  Parts that are neighbours
    in a chapter are merged while they fit the budget.
    """
    budget = min(budget, CEILING)
    out: list[tuple[int, int, str, list[int]]] = []
    for order, chapter, title, text in units:
        for part, _, _ in split_unit(text, title or f"Chapter {chapter}", budget):
            if out and out[-1][0] == chapter and len(out[-1][2]) + 2 + len(part) <= budget:
                _, segment, left, orders = out[-1]
                out[-1] = chapter, segment, f"{left}\n\n{part}", orders + [order] * (order not in orders)
            else:
                out.append((chapter, out[-1][1] + 1 if out and out[-1][0] == chapter else 0, part, [order]))
    return out


def _is_cut_sentence(left: str, right: str) -> bool:
    end = left.rstrip()
    while end and end[-1] in CLOSERS:
        end = end[:-1].rstrip()
    if end.endswith((".", "!", "?")):
        return False
    head = right.lstrip()
    lower = lambda x: "a" <= x <= "z"
    goes_on = head != "" and (lower(head[0]) or head[0] in ",;:)" or (head[0] in OPENERS and lower(head[1:2])))
    return goes_on or left.count('"') % 2 == 1


def repair(pieces: list[tuple[str, int, int, str]], target: int) -> tuple[list[tuple[str, int, int, str]], int]:
    """Neighbouring chunks of a chapter (text, start, end, strategy) with cut sentences carried over, and how many were."""
    out, moved = list(pieces), 0
    for k in range(len(out) - 1):
        left, a0, a1, how = out[k]
        right, b0, b1, other = out[k + 1]
        if not _is_cut_sentence(left, right):
            continue
        limit = min(target + max(1, int(FORWARD * target)) - len(left), len(right))
        ends = (with_tail(right, at, limit) for at in range(max(0, limit)) if right[at] in ".!?" and is_boundary(right, at))
        carry = right[: next(ends, 0)]
        if not carry.strip() or len(carry) >= len(right):
            continue
        out[k] = left + carry, a0, a1 + len(carry), REPAIRED
        out[k + 1] = right[len(carry) :], b0 + len(carry), b1, other
        moved += 1
    return out, moved


def apply_per_row(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], made: Sequence[tuple[str, str, pa.DataType]], rows: Callable[..., list[tuple]]) -> DataFrame:
    """For each row the rows that `rows` makes of its `inputs`, after the columns of `keys`."""
    picked = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keys)], *[df[c].alias(f"v{i}") for i, c in enumerate(inputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, results = [], []
            values = zip(*(batch.column(len(keys) + i).to_pylist() for i in range(len(inputs))), strict=True)
            for i, row in enumerate(values):
                for result in rows(*row):
                    at.append(i)
                    results.append(result)
            columns = zip(*results, strict=True) if results else [()] * len(made)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(taken) for i in range(len(keys))] + [pa.array(c, kind) for c, (_, _, kind) in zip(columns, made, strict=True)],
                names=[f"k{i}" for i in range(len(keys))] + [f"m{i}" for i in range(len(made))],
            )

    schema = ", ".join([f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keys)] + [f"m{i} {kind}" for i, (_, kind, _) in enumerate(made)])
    return picked.mapInArrow(run, schema).toDF(*keys, *[name for name, _, _ in made])


def chunk_rows(df: DataFrame, keys: Sequence[str], target: int, *, text_col: str = "text", repaired: bool = False) -> DataFrame:
    """Chunks of each row's text: keys, `chunk_index`, `text`, `char_start`, `char_end`, `boundary_strategy`."""

    def rows(text: str | None) -> list[tuple]:
        text = text or ""
        pieces = [(text[a:b], a, b, how) for a, b, how in chunks(text, target)]
        if repaired:
            pieces, _ = repair(pieces, target)
        return [(k, *piece) for k, piece in enumerate(pieces)]

    made = [("chunk_index", "long", pa.int64()), ("text", "string", pa.string()), ("char_start", "long", pa.int64()), ("char_end", "long", pa.int64()), ("boundary_strategy", "string", pa.string())]
    return apply_per_row(df, keys, [text_col], made, rows)


def plan_rows(df: DataFrame, keys: Sequence[str], budget: int, *, units_col: str = "units") -> DataFrame:
    """Planned segments of each row's `units` (array of order, chapter, title, text structs)."""

    def rows(units: list[dict] | None) -> list[tuple]:
        given = sorted((u["order"], u["chapter"], u["title"], u["text"] or "") for u in units or [])
        return [(k + 1, *segment) for k, segment in enumerate(plan(given, budget))]

    made = [("order_index", "long", pa.int64()), ("chapter_index", "long", pa.int64()), ("segment_index", "long", pa.int64()), ("text", "string", pa.string()), ("source_orders", "array<long>", pa.list_(pa.int64()))]
    return apply_per_row(df, keys, [units_col], made, rows)


def repair_rows(df: DataFrame, keys: Sequence[str], *, size: int, target: int, text_col: str = "text") -> DataFrame:
    """Texts cut every `size` characters, with cut sentences repaired: keys, `chunk_index`, `text`, offsets, `boundary_strategy`."""

    def rows(text: str | None) -> list[tuple]:
        text = text or ""
        pieces = [(text[a : a + size], a, min(a + size, len(text)), FORCED) for a in range(0, len(text), size)]
        return [(k, *piece) for k, piece in enumerate(repair(pieces, target)[0])]

    made = [("chunk_index", "long", pa.int64()), ("text", "string", pa.string()), ("char_start", "long", pa.int64()), ("char_end", "long", pa.int64()), ("boundary_strategy", "string", pa.string())]
    return apply_per_row(df, keys, [text_col], made, rows)
