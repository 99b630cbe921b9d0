"""License scans: TF-IDF cosine to licence templates, then inheritance by directory.

A file's statements are its lines, its paragraphs and its whole text, whatever
their length; each is a sparse TF-IDF vector, and the file's licence is the
template of highest cosine over all of them, if that reaches `LEAST`.  Inverse
document frequencies of all terms come from all files.  An SPDX identifier line
is one term, so it fits its licence and no other.

Document frequencies are counted in one pass, pre-aggregated in each task.  Those
of the `FREQUENT` most frequent terms and of the templates' own are broadcast;
they give each statement's products with the templates and a bound on its cosine,
as the terms that are missing can only lower it.  Statements that can't be told
from the bound alone send their missing terms to a join with the counts, which no
very frequent term takes part in.  A statement can only reach `LEAST` if it has
one of a template's heaviest terms (Cauchy-Schwarz bounds what the others can
add), so texts without any such anchor are passed over exactly.

Licence files then cover their directory: a file without a licence of its own
inherits from the nearest ancestor directory that has licence files, found by
joining the distinct directories' ancestor paths with the licensed directories.
Joins are on distinct directories, so a directory with very many files is one
row there; the join back to files is left to Spark's splitting of skewed joins.

Defined cases: a null or empty text states no licence; a null path lies in no
directory and inherits nothing; of equal cosines the earliest statement counts
(lines before paragraphs before the whole text), then the licence least by name;
of several licences in one directory the most frequent counts, of equals the
least by name; of an SPDX expression the first identifier counts; repeated rows
are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import most_frequent, saved, shared_dir

#: Least cosine of a match.
LEAST = 0.7
#: Terms whose document frequencies are broadcast (16 bytes each); the others are joined.
FREQUENT = 1 << 16
#: Distinct terms that a task counts before it sends them on.
GATHER = 1 << 20
#: Texts above this length are read as a stream of terms.
STREAM = 1 << 20
TERM = re.compile(r"spdx-license-identifier:[ \t]*[a-z0-9.+-]+|[a-z0-9]+(?:[.-][a-z0-9]+)*")

_WARRANTY = "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

#: Notices, headers and texts of common licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        f"version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but {_WARRANTY} See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "This program is free software under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        f"version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but {_WARRANTY} See the GNU General Public License for more details.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "Proprietary": ("All rights reserved.",),
}


def _clean(found: Iterable[str]) -> Iterator[str]:
    """Terms as they are counted: an SPDX line without its spaces, a very long term as a digest of it."""
    for t in found:
        if len(t) > 24:
            if t.startswith("spdx-"):
                t = "".join(t.split()).rstrip(".-")
            if len(t) > 64:
                t = blake2b(t.encode(), digest_size=16).hexdigest()
        yield t


def terms(low: str) -> Counter:
    """Counts of the terms of a text in lower case."""
    return Counter(_clean(TERM.findall(low) if len(low) < STREAM else (m.group() for m in TERM.finditer(low))))


def named(term: str) -> int:
    """A 64-bit name of a term."""
    return int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


def idf(frequency: int, files: int) -> float:
    return math.log((1 + files) / (1 + frequency)) + 1.0


def notices(templates: Mapping[str, Iterable[str]]) -> list[tuple[str, Counter]]:
    """Licence and terms of every template, the licence's SPDX lines with them."""
    out = []
    for name in sorted(templates):
        ids = [name] + [f"{name}{x}" for x in ("-only", "-or-later", "+") if "GPL" in name]
        out += [(name, terms(t.lower())) for t in [*templates[name], *(f"SPDX-License-Identifier: {i}" for i in ids)]]
    return out


class Statement:
    """What is known of a statement: the best template, its product, the known terms' squares, and the missing terms."""

    def __init__(self, line: int, name: str, dot: float, square: float, missing: list[tuple[int, int]]) -> None:
        self.line, self.name, self.dot, self.square, self.missing = line, name, dot, square, missing

    @property
    def cosine(self) -> float:
        """The cosine if nothing is missing, else a bound on it."""
        return round(self.dot / math.sqrt(self.square), 12) if self.square else 0.0


class Matcher:
    """Templates as unit TF-IDF vectors, the terms that a match can't do without, and the document frequencies that are known."""

    def __init__(self, templates: Mapping[str, Iterable[str]], frequency: Mapping[int, int], files: int) -> None:
        self.files, self.frequency = files, frequency
        given = notices(templates)
        self.known = {t: idf(frequency.get(named(t), 0), files) for _, counts in given for t in counts}
        self.vectors: list[tuple[str, dict[str, float]]] = []
        anchors: set[str] = set()
        for name, counts in given:
            raw = {t: n * self.known[t] for t, n in counts.items()}
            norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
            vector = {t: x / norm for t, x in raw.items()}
            self.vectors.append((name, vector))
            # the lightest terms together stay below LEAST; the others are anchors
            mass = 0.0
            for t, x in sorted(vector.items(), key=lambda i: (i[1], i[0])):
                mass += x * x
                if math.sqrt(mass) >= LEAST - 1e-9:
                    anchors.add(t)
        self.anchors = frozenset(anchors)
        words = sorted({t.split(":")[0] for t in anchors}, key=lambda t: (-len(t), t))
        self.anchor = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + r")(?![a-z0-9])")

    def _idf(self, term: str) -> float | None:
        value = self.known.get(term)
        if value is None and (n := self.frequency.get(named(term))) is not None:
            if len(self.known) > FREQUENT * 2:
                self.known = {t: x for t, x in self.known.items() if any(t in v for _, v in self.vectors)}
            value = self.known[term] = idf(n, self.files)
        return value

    def weigh(self, line: int, counts: Counter) -> Statement | None:
        """The statement, if it can reach `LEAST`."""
        best, name = 0.0, ""
        near = {t: n * self.known[t] for t, n in counts.items() if t in self.known}
        for which, vector in self.vectors:
            dot = sum(x * near[t] for t, x in vector.items() if t in near)
            if dot > best + 1e-12:
                best, name = dot, which
        square, missing = sum(x * x for x in near.values()), []
        if not square or best / math.sqrt(square) < LEAST - 1e-9:
            return None
        for t in sorted(counts.keys() - near.keys()):
            known = self._idf(t)
            if known is None:
                missing.append((named(t), counts[t]))
            else:
                square += (counts[t] * known) ** 2
        found = Statement(line, name, best, square, missing)
        return found if found.cosine >= LEAST - 1e-9 else None

    def scan(self, text: str) -> list[Statement]:
        """The statements, in order, that the best one must be among."""
        low = text.lower()
        if not self.anchor.search(low):
            return []
        lines = [terms(x) for x in low.split("\n")]
        hit = self.anchors.intersection
        candidates = [(k, c) for k, c in enumerate(lines) if hit(c)]
        at, block, whole = 0, [], Counter()
        for k, counts in enumerate([*lines, Counter()]):
            if counts:
                block.append(counts)
                whole.update(counts)
                continue
            if len(block) > 1:
                paragraph = Counter()
                for c in block:
                    paragraph.update(c)
                if hit(paragraph):
                    candidates.append((at, paragraph))
            at, block = k + 1, []
        candidates.append((0, whole))
        out: list[Statement] = []
        met, least = set(), LEAST - 1e-9
        for k, counts in candidates:
            key = frozenset(counts.items())
            if key in met:
                continue
            met.add(key)
            found = self.weigh(k, counts)
            if found and found.cosine >= least:
                out.append(found)
                if not found.missing:
                    least = max(least, found.cosine)
        return [s for s in out if s.cosine >= least]


def term_frequencies(files: DataFrame, folder: str, *, text_col: str = "text") -> tuple[DataFrame, int]:
    """In how many files each term is (`h`, `n`), written to `folder`, and the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        n = 0

        def sent(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([named(t) for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["h", "n"])

        for batch in batches:
            for value in batch.column(0):
                low = (value.as_py() or "").lower()
                found.update(set(_clean(set(TERM.findall(low)) if len(low) < STREAM else (m.group() for m in TERM.finditer(low)))))
                n += 1
                if len(found) > GATHER:
                    yield sent(found)
                    found = Counter()
        yield sent(found)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["h", "n"])

    sums = files.select(files[text_col].alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = saved(sums, f"{folder}/terms")
    rows = counted.where("h IS NULL").collect()
    return counted.where("h IS NOT NULL"), rows[0]["n"] if rows else 0


def match_files(
    files: DataFrame, templates: Mapping[str, Iterable[str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, folder: str | None = None
) -> DataFrame:
    """Id, `license`, `cosine` and `at_line` of each file's own statement (null, 0 and -1: none)."""
    spark = files.sparkSession
    folder = folder or shared_dir(spark)
    counted, n_files = term_frequencies(files, folder, text_col=text_col)
    own = sorted({named(t) for _, counts in notices(templates) for t in counts})
    # bounded, as the templates' terms are
    known = dict(most_frequent(counted, "h", frequent)) | {r["h"]: r["n"] for r in counted.where(F.col("h").isin(own)).collect()}
    shared = spark.sparkContext.broadcast((known, n_files))
    pending = "pending array<struct<k: int, line: int, name: string, dot: double, square: double, missing: array<struct<h: bigint, c: bigint>>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, *shared.value)
        part = pa.struct([("k", pa.int32()), ("line", pa.int32()), ("name", pa.string()), ("dot", pa.float64()), ("square", pa.float64()), ("missing", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))])
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(part)]
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(1):
                sure: tuple = (None, 0.0, -1, 0)
                open_: list[dict] = []
                for k, s in enumerate(matcher.scan(value.as_py() or "")):
                    if s.missing:
                        open_.append({"k": k, "line": s.line, "name": s.name, "dot": s.dot, "square": s.square, "missing": [{"h": h, "c": c} for h, c in s.missing]})
                    elif s.cosine > sure[1]:
                        sure = s.name, s.cosine, s.line, k
                out.append((uuid.uuid4().hex if open_ else None, *sure, open_ or None))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=["id", "row", "license", "cosine", "at_line", "k", "pending"])

    kind = files.schema[id_col].dataType.simpleString()
    found = files.select(files[id_col].alias("id"), files[text_col].alias("text")).mapInArrow(run, f"id {kind}, row string, license string, cosine double, at_line int, k int, {pending}")
    found = saved(found, f"{folder}/found")  # rows have their names from here on
    statements = found.where("row IS NOT NULL").select("row", F.explode("pending").alias("s"))
    parts = statements.select("row", "s.k", F.explode("s.missing").alias("m")).select("row", "k", "m.h", "m.c")
    weight = F.col("c") * (F.log((1.0 + n_files) / (1.0 + F.coalesce("n", F.lit(0)))) + 1.0)
    rest = parts.join(counted, "h", "left").groupBy("row", "k").agg(F.sum(weight * weight).alias("rest"))
    weighed = statements.select("row", "s.k", "s.line", "s.name", "s.dot", "s.square").join(rest, ["row", "k"])
    weighed = weighed.withColumn("x", F.round(F.col("dot") / F.sqrt(F.col("square") + F.col("rest")), 12)).where(F.col("x") >= LEAST)
    best = weighed.groupBy("row").agg(F.max_by(F.struct("name", "x", "line", "k"), F.struct("x", -F.col("k"))).alias("b"))
    joined = found.join(best, "row", "left")
    better = F.coalesce((F.col("b.x") > F.col("cosine")) | ((F.col("b.x") == F.col("cosine")) & (F.col("b.k") < F.col("k"))), F.lit(False))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(better, F.col("b.name")).otherwise(F.col("license")).alias("license"),
        F.when(better, F.col("b.x")).otherwise(F.col("cosine")).alias("cosine"),
        F.when(better, F.col("b.line")).otherwise(F.col("at_line")).alias("at_line"),
    )


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at its end; empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, licence_file: Column) -> DataFrame:
    """Adds `origin` (own, inherited or none), `license_dir` and the inherited `license`.

    `files` has `path`, `license`; `licence_file` says which rows license their directory.
    """
    placed = files.withColumn("dir", directory(F.col("path")))
    counts = placed.where(licence_file & F.col("license").isNotNull()).groupBy("dir", "license").agg(F.count("*").alias("k"))
    licensed = counts.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("k"), F.col("license"))).alias("dir_license"))
    # every ancestor of a distinct directory, itself included, and the top
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    chain = placed.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("up"))
    found = chain.join(licensed.withColumnRenamed("dir", "up"), "up")
    nearest = found.groupBy("dir").agg(F.max_by(F.struct("up", "dir_license"), F.length("up")).alias("near"))
    joined = placed.join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return joined.select(
        *[c for c in files.columns if c != "license"],
        F.when(own, F.col("license")).otherwise(F.col("near.dir_license")).alias("license"),
        F.when(own, F.lit("own")).when(F.col("near").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(~own, F.col("near.up")).alias("license_dir"),
    )


def scan_licenses(files: DataFrame, licence_file: Column, templates: Mapping[str, Iterable[str]] = TEMPLATES, *, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, `path`, `cosine`, `at_line`, `license`, `origin`, `license_dir` of each file.

    `path` and `licence_file` may use the columns of `match_files`.
    """
    own = saved(match_files(files, templates, id_col=id_col, text_col=text_col), shared_dir(files.sparkSession))
    return inherit(own.withColumn("path", path), licence_file)
