"""Text cleaning and naming rules as Column -> Column functions.

Patterns use the flags `(?mdU)`: multi-line with \\n alone as line end, and
Unicode classes, which is how the rules are specified.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that end a line.
BLOCKS = (
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul"
).split()


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Named and numeric character references as characters."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def ascii_letters(text: pd.Series) -> pd.Series:
    """Characters by their compatibility decomposition, without those that ASCII lacks."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


@F.pandas_udf(StringType())
def title_case(text: pd.Series) -> pd.Series:
    """Letters after anything but a letter are capitals, the others small."""
    return text.str.title()


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def blank_page_numbers(text: Column) -> Column:
    """Lines of digits alone become empty, blank lines around them with them."""
    return F.regexp_replace(text, r"(?mdU)^\s*\d+\s*$", "")


def join_hyphens(text: Column) -> Column:
    """A word broken by a hyphen at the end of a line is joined."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")


def plain_quotes(text: Column) -> Column:
    """Curly double quotes and the right single one become straight."""
    return F.translate(text, "“”’", "\"\"'")


def collapse_blanks(text: Column) -> Column:
    """Runs of spaces and tabs become one space, and none is left before a line end."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), " \n", "\n")


def drop_figure_refs(text: Column) -> Column:
    """Bracketed figure references go."""
    return F.regexp_replace(text, r"(?iu)\[\s*fig(?:ure)?\.?\s*\d+\s*\]", "")


def _body(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def merge_drop_caps(text: Column) -> Column:
    """Struct of `text` and `merges`: a lone capital is put before the word it was cut from.

    A line that is one letter A-Z joins the next non-empty line, at most two
    lines on, if that begins with three capitals, isn't a heading of one or two
    words in capitals, and no bare list marker stands before.  A fold over the
    lines keeps the lines done, the letter that waits and the gap after it.
    """
    marker = r"^(?:[0-9]+[.)]|[A-Za-z][.)]|[-*])"
    none = F.lit(None).cast("string")

    def state(done: Column, letter: Column, gap: Column, last: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), letter.alias("letter"), gap.alias("gap"), last.alias("last"), n.alias("n"))

    def put_back(s: Column) -> Column:
        return F.when(s["letter"].isNull(), s["done"]).when(s["gap"] == 1, F.concat(s["done"], F.array(s["letter"], F.lit("")))).otherwise(F.concat(s["done"], F.array(s["letter"])))

    def step(s: Column, x: Column) -> Column:
        body = _body(x)
        words = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w.rlike(r"\p{L}")))
        heading = words.between(1, 2) & body.rlike(r"(?U)^[A-Z][A-Z\s'\"&-]*$")
        fits = s["letter"].isNotNull() & body.rlike("^[A-Z]{3}") & ~heading & ~s["last"].rlike(marker + "$") & ~body.rlike("(?U)" + marker + r"\s")
        joined = F.concat(F.regexp_extract(x, r"(?U)^\s*", 0), _body(s["letter"]), F.regexp_replace(x, r"(?U)^\s+", ""))
        return (
            F.when(s["letter"].isNotNull() & (body == "") & (s["gap"] == 0), state(s["done"], s["letter"], F.lit(1), s["last"], s["n"]))
            .when(fits, state(F.concat(s["done"], F.array(joined)), none, F.lit(0), body, s["n"] + 1))
            .when(body.rlike("^[A-Z]$"), state(put_back(s), x, F.lit(0), F.coalesce(_body(s["letter"]), s["last"]), s["n"]))
            .otherwise(state(F.concat(put_back(s), F.array(x)), none, F.lit(0), F.when(body == "", s["last"]).otherwise(body), s["n"]))
        )

    empty = state(F.array().cast("array<string>"), none, F.lit(0), F.lit(""), F.lit(0))
    return F.aggregate(F.split(text, "\n", -1), empty, step, lambda s: F.struct(F.array_join(put_back(s), "\n").alias("text"), s["n"].alias("merges")))


def keep_headers(text: Column) -> Column:
    """The place of a rule for running headers and footers, which leaves them as they are."""
    return text


#: The cleaning rules in their order.
RULES: tuple[Callable[[Column], Column], ...] = (blank_page_numbers, keep_headers, join_hyphens, lambda t: merge_drop_caps(t)["text"], plain_quotes, collapse_blanks, drop_figure_refs)


def clean(text: Column, rules: Sequence[Callable[[Column], Column]] = RULES) -> Column:
    """The rules in order, then stripped."""
    return strip(reduce(lambda t, rule: rule(t), rules, text))


def html_to_text(page: Column) -> Column:
    """Text of a page: no scripts and styles, a line end at either end of a block, entities decoded."""
    t = F.regexp_replace(page, r"(?is)<!--.*?-->|<!doctype[^>]*>|<\?.*?>", "")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    # an empty element both opens and closes
    t = F.regexp_replace(t, rf"(?i)<(?:{'|'.join(BLOCKS)})\b[^>]*/>", "\n\n")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)</?[A-Za-z][^>]*>", "")
    t = decode_entities(t)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t\f\x0b]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def collapse_title(text: Column) -> Column:
    """White space collapsed; null if nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def slug(text: Column, default: str = "part") -> Column:
    """Lower-case ASCII letters and digits with single dashes between."""
    token = F.regexp_replace(F.regexp_replace(F.lower(ascii_letters(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(token == "", default).otherwise(token)


def reader_token(text: Column, default: str = "book") -> Column:
    """As `slug`, but an accented letter is a dash too."""
    token = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(token == "", default).otherwise(token)


def part_id(chapter: Column, part: Column, title: Column) -> Column:
    named = F.coalesce(collapse_title(title), F.format_string("chapter-%03d", chapter))
    return F.format_string("%03d_%02d_%s", chapter, part, slug(named))


def packaged_name(number: Column, title: Column, extension: str, *, friendly: bool) -> Column:
    """File name of a packaged chapter, deterministic or for readers."""
    if friendly:
        shown = collapse_title(F.regexp_replace(title, r'[\\/:*?"<>|]+', "-"))
        return F.concat(F.format_string("%03d - ", number), F.coalesce(shown, F.lit("Untitled Chapter")), F.lit(f".{extension}"))
    return F.concat(F.format_string("chapter_%03d_%s", number, slug(title)), F.lit(f".{extension}"))


def latin1(text: Column) -> Column:
    """Characters that Latin-1 has; a tab is four spaces, a line end or hard space one, anything else a question mark."""
    t = F.replace(F.regexp_replace(text, r"\r\n?", "\n"), F.lit("\t"), F.lit("    "))
    t = F.regexp_replace(t, "[\u00a0\n]", " ")
    return F.regexp_replace(t, r"[^\x20-\u00ff]", "?")


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def redact(text: Column, most: int = 180) -> Column:
    """Key-like and bearer tokens hidden, white space collapsed; beyond `most` characters cut to one less, with dots."""
    t = F.regexp_replace(text, r"(?U)\bsk-[A-Za-z0-9_-]{8,}\b", "[redacted-key]")
    t = F.regexp_replace(t, r"(?iU)bearer\s+[A-Za-z0-9._-]{12,}", "Bearer [redacted-token]")
    t = F.btrim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("..."))).otherwise(t)


def log_token(value: Column) -> Column:
    """A value in a log line: anything but letters, digits and `-_.:/` is an underscore; nothing is `none`."""
    token = F.regexp_replace(strip(value), r"[^\p{L}\p{N}_.:/-]", "_")
    return F.when(token == "", "none").otherwise(token)


def scope_token(mode: Column, indices: Column) -> Column:
    """File name part of a chapter scope: `all`, `chapters-1-3-5`, or `selected` where no index is known."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(indices, F.lit("")), "[^0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.lower(F.btrim(mode)) == "all", "all").when(digits == "", "selected").otherwise(F.concat(F.lit("chapters-"), digits))


def merged_path(mode: Column, indices: Column, label: Column) -> Column:
    """Where the merged audio of a scope lies in a run's folder."""
    part = F.replace(F.coalesce(F.nullif(indices, F.lit("")), label, F.lit("selected")), F.lit(","), F.lit("_"))
    return F.when(F.coalesce(mode, F.lit("all")) == "all", "audio/merged.wav").otherwise(F.concat(F.lit("audio/merged.chapters_"), part, F.lit(".wav")))


def permissive_boolean(text: Column) -> Column:
    """True, false or null of a word."""
    word = F.lower(F.btrim(text))
    return F.when(word.isin("1", "true", "yes", "on"), True).when(word.isin("0", "false", "no", "off"), False)
