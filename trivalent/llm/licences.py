"""Licence scans: TF-IDF cosine to templates, and inheritance from the nearest directory above.

Templates are whole licence texts (licence_texts), standard headers, short notices and SPDX
tags. A file's candidates are its lines, all of it, and for each template of m words the runs
of whole lines from every line on that hold m words: up to the last line that fits and up to
the first that fills them. A candidate and the templates are sparse TF-IDF vectors over words;
a word weighs log((1 + files) / (1 + files that hold it)) + 1, counted over all files. A file's
licence is that of the template of the greatest cosine, if that reaches the threshold.

Most texts need no cosine: per template, words are left out from the most common one on as
long as those left out could not reach the threshold by themselves, by Cauchy and Schwarz;
a text that has none of the words that remain can't match. The scan knows the weights of the
templates' words; other words weigh between 1 and what a word of a single file does, which
bounds each cosine from both sides. Candidates that can still be the best one go on with
their other words, and a join with the counted words gives the exact cosine.

A licence file (a name like LICENSE or COPYING, or a text that is mostly the notice) speaks
for its directory. A file without a licence inherits that of the nearest directory above
that has one: directories are resolved first, each once, by a join on their ancestors' paths.

Cases: null and empty texts have no licence of their own; a null path has no directory;
of equal cosines the template that sorts first wins, of several licence files in a
directory the one of greatest cosine, then of least path; repeated rows give repeated
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivalent.llm.shared import batch_rows, materialize, release_memory, text_or_empty

# Notices and headers of common licences; whole texts are in licence_texts.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "BSD 3-Clause License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0, the Creative Commons Attribution License.", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "MIT License"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ),
}
TEXTS = ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "MIT", "MPL-2.0")
TAGS = {
    "Apache-2.0": ("Apache-2.0",), "BSD-3-Clause": ("BSD-3-Clause",), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"), "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",), "MPL-2.0": ("MPL-2.0",),
}
WORD = re.compile(r"[a-z0-9]+")
THRESHOLD, FILE_SHARE, SLACK = 0.8, 0.5, 1e-9
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
#: Distinct words that a task counts before it hands them on.
COUNT_WORDS = 200_000
#: A common word's document frequency is joined in this many places.
SPREAD = 32
FOUND = "array<struct<name: string, dot: double, known: double, size: int, words: array<string>, counts: array<int>>>"
CANDIDATES = pa.list_(pa.struct([("name", pa.string()), ("dot", pa.float64()), ("known", pa.float64()), ("size", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def templates() -> list[tuple[str, list[str]]]:
    """Licence and words of every template."""
    found = [(name, text) for name, texts in NOTICES.items() for text in texts]
    found += [(name, f"SPDX-License-Identifier: {tag}") for name, tags in TAGS.items() for tag in tags]
    found += [(name, resources.files("trivalent.llm").joinpath("licence_texts", f"{name}.txt").read_text("utf-8")) for name in TEXTS]
    return sorted((name, words(text)) for name, text in found)


class Text:
    """A text's words with sums over all words before each place: of dot products with templates, squared weights, and hashes (of a bag of words)."""

    def __init__(self, every: list[str], ends: list[int], scanner: Scanner, live: list[int]):
        self.every, self.ends = every, np.array(ends)
        number = {w: i for i, w in enumerate(dict.fromkeys(every))}
        codes = np.fromiter((number[w] for w in every), np.int64, len(every))
        before = lambda table: np.concatenate([np.zeros((1, *table.shape[1:]), table.dtype), np.cumsum(table[codes], 0, dtype=table.dtype)])
        self.dots = {}
        for t in live:
            vector = scanner.templates[t][2]
            self.dots[t] = before(np.fromiter((scanner.idf[w] * vector[w] if w in vector else 0.0 for w in number), float, len(number)))
        self.least = before(np.fromiter((scanner.idf.get(w, 1.0) ** 2 for w in number), float, len(number)))
        self.bags = before(np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in number), np.uint64).reshape(-1, 2))


class Scanner:
    def __init__(self, texts: list[tuple[str, list[str]]], frequencies: dict[str, int], files: int, threshold: float):
        self.threshold = threshold
        self.idf = {w: math.log((1 + files) / (1 + frequencies.get(w, 0))) + 1 for _, t in texts for w in t}
        self.rarest = math.log((1 + files) / 2) + 1  # a word of this file is in one file at least
        #: Licence, number of words and unit vector of each template.
        self.templates, self.triggers, self.of_word = [], set(), {}
        for name, text in texts:
            weights = {w: n * self.idf[w] for w, n in Counter(text).items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            vector = {w: x / norm for w, x in weights.items()}
            for w, x in vector.items():
                self.of_word.setdefault(w, []).append((len(self.templates), x * x))
            self.templates.append((name, len(text), vector))
            left_out = 0.0
            for w in sorted(vector, key=lambda w: (self.idf[w], w)):
                left_out += vector[w] ** 2
                if math.sqrt(left_out) >= threshold - SLACK:
                    self.triggers.add(w)

    def live(self, found: set[str]) -> list[int]:
        """Templates that a bag of these words can match, by the part of their vector that the words cover."""
        covered: dict[int, float] = {}
        for w in found:
            for t, x in self.of_word.get(w, ()):
                covered[t] = covered.get(t, 0.0) + x
        return sorted(t for t, x in covered.items() if math.sqrt(x) >= self.threshold - SLACK)

    def squares(self, bag: dict[str, int]) -> tuple[float, float]:
        """Squared length of a bag's vector over the words of templates, and the sum of squared counts of all others."""
        return sum((n * self.idf[w]) ** 2 for w, n in bag.items() if w in self.idf), float(sum(n * n for w, n in bag.items() if w not in self.idf))

    def runs(self, text: Text, t: int) -> dict[tuple[int, int], tuple[float, float]]:
        """Runs of lines, of about a template's number of words, whose cosine can reach the threshold, with their squares().

        A count squared is no less than the count, so sums over words bound the length of a run's vector from below and
        drop most runs at once; what is left is counted, each run for itself or all of them in one pass.
        """
        size, dot, out = self.templates[t][1], text.dots[t], {}
        starts = np.concatenate([[0], text.ends[:-1]])
        lines = np.arange(len(starts))
        for filled in (False, True):
            at = np.searchsorted(text.ends, starts + size, "left" if filled else "right") - (0 if filled else 1)
            stops = text.ends[np.clip(np.maximum(at, lines), 0, len(lines) - 1)]
            own, least = dot[stops] - dot[starts], np.sqrt(text.least[stops] - text.least[starts])
            left = np.flatnonzero(own >= (self.threshold - 1e-6) * least - 1e-9)
            pairs = list(zip(starts[left].tolist(), stops[left].tolist()))
            each = sum(b - a for a, b in pairs) <= 2 * len(text.every)
            for i, (pair, found) in enumerate(zip(pairs, (self.squares(Counter(text.every[a:b])) for a, b in pairs) if each else self.sliding(text, pairs))):
                if own[left[i]] >= (self.threshold - 1e-6) * math.sqrt(max(sum(found), 0.0)):
                    out[pair] = found
        return out

    def sliding(self, text: Text, pairs: list[tuple[int, int]]) -> Iterator[tuple[float, float]]:
        """squares() of runs whose starts and stops both rise, in one pass over the words."""
        counts: dict[str, int] = {}
        a = b = 0
        known = rest = 0.0
        for start, stop in pairs:
            if start > b:
                counts, a, b, known, rest = {}, start, start, 0.0, 0.0
            while a < start or b < stop:
                step = -1 if a < start else 1
                w = text.every[a] if step < 0 else text.every[b]
                n, x = counts.get(w, 0), self.idf.get(w)
                counts[w] = n + step
                if x is None:
                    rest += 2 * step * n + 1
                else:
                    known += (2 * step * n + 1) * x * x
                a, b = (a + 1, b) if step < 0 else (a, b + 1)
            yield known, rest

    def best(self, text: Text, spans: dict[tuple[int, int], tuple[float, float]], live: list[int]) -> list[tuple[int, int]]:
        """The spans that can have the greatest cosine of all, by bounds; of equal bags of words one."""
        pairs, squares = np.array(list(spans)), np.array(list(spans.values()))
        dot = np.max([text.dots[t][pairs[:, 1]] - text.dots[t][pairs[:, 0]] for t in live], axis=0)
        least, most = (dot / np.sqrt(np.maximum(squares[:, 0], 0.0) + squares[:, 1] * x * x + 1e-30) for x in (self.rarest, 1.0))
        keep = pairs[most >= max(self.threshold, float(least.max()) - 1e-6) - 1e-6]
        bags = text.bags[keep[:, 1]] - text.bags[keep[:, 0]]
        return [(int(a), int(b)) for a, b in {bag.tobytes(): pair for bag, pair in zip(bags, keep)}.values()]

    def candidate(self, found: list[str], live: list[int]) -> tuple[float, float, tuple]:
        """Least and greatest cosine that a bag of words can have, and what its exact cosine needs."""
        bag = Counter(found)
        dot, name = min((-sum(n * self.idf[w] * self.templates[t][2].get(w, 0.0) for w, n in bag.items() if w in self.idf), self.templates[t][0]) for t in live)
        known = sum((n * self.idf[w]) ** 2 for w, n in bag.items() if w in self.idf)
        rest = sorted((w, n) for w, n in bag.items() if w not in self.idf)
        squares = sum(n * n for _, n in rest)
        least, most = (-dot / math.sqrt(known + squares * x * x) for x in (self.rarest, 1.0))
        return least, most, (name, -dot, known, len(found), tuple(w for w, _ in rest), tuple(n for _, n in rest))

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """Number of words, and the candidates that can have the file's greatest cosine."""
        every = words(text)
        if self.triggers.isdisjoint(every):
            return len(every), []
        live = self.live(set(every))
        if not live:
            return len(every), []
        ends, at = [], 0
        for line in text.split("\n"):
            if found := words(line):
                at += len(found)
                ends.append(at)
        spans = {(a, b): self.squares(Counter(every[a:b])) for a, b in {*((a, b) for a, b in zip([0, *ends], ends) if not self.triggers.isdisjoint(every[a:b])), (0, len(every))}}
        whole = Text(every, ends, self, live)
        for t in live:
            spans = self.runs(whole, t) | spans
        bags = {tuple(sorted(every[a:b])) for a, b in self.best(whole, spans, live)}
        if not bags:
            return len(every), []
        found = [self.candidate(bag, live) for bag in bags]
        floor = max(self.threshold, max(least for least, _, _ in found)) - SLACK
        return len(every), sorted(c for _, most, c in found if most >= floor)


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan_licences(files: DataFrame, id_column: str = "doc_id", path_column: str = "path", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, path, licence, cosine, origin (own, inherited, none) and the directory that an inherited licence comes from."""
    own = files.select(files[id_column].alias("id"), files[path_column].cast("string").alias("path"), files[text_column].cast("string").alias("text"))
    texts = templates()
    vocabulary = sorted({w for _, t in texts for w in t})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, files = Counter(), 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*totals, ""], pa.string()), pa.array([*totals.values(), files], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in batch_rows(batch, "text"):
                for text in text_or_empty(part.column("text")):
                    totals.update(set(words(text)))
                    files += 1
                    if len(totals) > COUNT_WORDS:
                        yield counted()
                        totals, files = Counter(), 0
        yield counted()
        totals.clear()
        release_memory()

    counted = materialize(own.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "licence-words")
    # As many rows as the templates have words come to the driver.
    frequencies = {r["word"]: r["n"] for r in counted.where(F.col("word").isin(["", *vocabulary])).collect()}
    number = frequencies.pop("", 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, fields = Scanner(texts, frequencies, number, threshold), [f.name for f in CANDIDATES.value_type]
        for batch in (part for whole in batches for part in batch_rows(whole, "text")):
            done = [scanner.scan(t) for t in text_or_empty(batch.column("text"))]
            found = pa.array([[dict(zip(fields, c)) for c in x] for _, x in done], CANDIDATES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), pa.array([n for n, _ in done], pa.int64()), found], ["id", "path", "size", "found"])
        release_memory()

    kind = own.schema["id"].dataType.simpleString()
    rows = materialize(own.mapInArrow(scan, f"id {kind}, path string, size long, found {FOUND}").withColumn("row", F.monotonically_increasing_id()), "licence-candidates")
    candidates = rows.select("row", F.posexplode("found").alias("at", "c")).select("row", "at", "c.*")
    others = candidates.select("row", "at", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", "at", "w.words", "w.counts", F.pmod("row", F.lit(SPREAD)).alias("part")).withColumnRenamed("words", "word")
    weights = others.select("word", "part").distinct().join(counted, "word").select("word", "part", (F.log(F.lit(1.0 + number) / (1 + F.col("n"))) + 1).alias("idf"))
    squares = others.join(weights, ["word", "part"]).groupBy("row", "at").agg(F.array_sort(F.collect_list(F.pow(F.col("counts") * F.col("idf"), F.lit(2.0)))).alias("squares"))
    exact = candidates.join(squares, ["row", "at"], "left").withColumn("square", F.aggregate(F.coalesce("squares", F.array().cast("array<double>")), F.lit(0.0), lambda x, y: x + y))
    cosines = exact.select("row", "name", F.col("size").alias("length"), F.round(F.col("dot") / F.sqrt(F.col("known") + F.col("square")), 12).alias("cosine")).where(F.col("cosine") >= threshold)
    best = cosines.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("cosine"), "name", (-F.col("length")).alias("length"))).alias("best"))
    scanned = rows.select("row", "id", "path", "size").join(best, "row", "left").select(
        "id", "path", F.col("best.name").alias("licence"), F.coalesce(-F.col("best.cosine"), F.lit(0.0)).alias("cosine"), F.coalesce(-F.col("best.length") / F.col("size"), F.lit(0.0)).alias("share"), _parent(F.col("path")).alias("directory")
    )
    speaks = scanned.where(F.col("licence").isNotNull() & F.col("path").isNotNull() & ((F.col("share") >= FILE_SHARE) | F.col("path").rlike(FILE_NAME)))
    by_directory = speaks.groupBy("directory").agg(F.min(F.struct((-F.col("cosine")).alias("cosine"), "path", "licence"))["licence"].alias("licence"))
    directories = scanned.where("directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    above = directories.select("directory", F.posexplode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("depth", "ancestor"))
    nearest = above.join(by_directory.withColumnRenamed("directory", "ancestor"), "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "licence", "ancestor")).alias("near"))
    joined = scanned.join(nearest, "directory", "left")
    inherits = F.col("licence").isNull() & F.col("near").isNotNull()
    return joined.select(
        "id",
        "path",
        F.coalesce("licence", "near.licence").alias("licence"),
        "cosine",
        F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("near.ancestor")).alias("inherited_from"),
    )
