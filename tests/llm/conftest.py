import random

import pytest

#: A null, empties, white space, one word, a very long text, a very long word, mixed scripts, ties and repeated rows.
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\x0c\r "),
    (4, "one"),
    (5, "two words"),
    (6, "the quick brown fox jumps over the lazy dog. " * 3000),
    (7, "x" * 50_000),
    (8, "ÀÉß ğ 東京 \U0001f600 \u00a0 \u3000 mixed CASE it's 12 345 don't"),
    (9, "same text here and there it is"),
    (10, "same text here and there it is"),
    (11, "Same TEXT here and there it is"),
    (11, "Same TEXT here and there it is"),
    (None, "a row without an id has a text"),
]
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) if r.random() < 0.7 else r.choice(("the", "of", "and", "to")) for _ in range(words)]
    return " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(made))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Awkward rows, with extra columns whose names operators use themselves."""
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 2}" if k % 4 else None, len(t or ""), 1, "x", 2) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, kept string, id int")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
