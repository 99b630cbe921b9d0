"""Translated books as files for readers: one row for each book and format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import reader_token, scope_token
from folioforge.sources import epub, pdf

#: What each format is built by; in this order they are listed.
BUILDERS = {"epub": epub.build_epubs, "pdf": pdf.build_pdfs}


def reader_exports(books: DataFrame, formats: Sequence[str]) -> DataFrame:
    """`book_id`, `format`, `name` (below the run's folder) and `content` of each book in each format.

    `books` has what the builders take, and `stem` (of the source's name), `mode` and
    `indices` (of the chapter scope).  A format that isn't known is an error.
    """
    unknown = sorted(set(formats) - set(BUILDERS))
    if unknown:
        raise ValueError(f"unknown reader formats: {', '.join(unknown)}")
    scope = scope_token(F.col("mode"), F.col("indices"))
    token = lambda name, default: reader_token(F.coalesce(name, F.lit("")), default)
    base = F.concat_ws(".", token("stem", "document"), token("language", "lang"), scope, F.lit("translated"))
    names = books.select("book_id", F.concat(F.lit("reader/"), base).alias("base"))
    found = None
    for kind, builder in BUILDERS.items():
        if kind in formats:
            made = builder(books).join(names, "book_id").select("book_id", F.lit(kind).alias("format"), F.concat("base", F.lit(f".{kind}")).alias("name"), "content")
            found = made if found is None else found.unionByName(made)
    if found is None:
        return names.where("false").select("book_id", F.lit("").alias("format"), F.col("base").alias("name"), F.lit(None).cast("binary").alias("content"))
    return found
