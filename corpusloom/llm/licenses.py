"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

Vectors are sparse: document frequencies of the templates' terms are counted over all files, and words
that no template has weigh as the rarest term, so foreign words lower a cosine. What is compared is
every window of one to ``LINES`` neighbouring lines (a header may be wrapped) and the file as a whole;
the templates are usual headers and whole licence texts. A file is a licence file if a window that
matches holds half of its terms. Files without a licence of their own take that of the nearest
directory above them that holds a licence file.

Only files with a heavy term of some template can reach the cosine; their texts are scored row by row
in Python, the others only pass by. Every row keeps to itself: no join by path brings its own result back.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, written

#: The usual one-line headers of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Whole licence texts and the notices that files carry, as published.
TEXTS = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
)
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
COSINE, FILE_SHARE = 0.6, 0.5
#: Most neighbouring lines of a window.
LINES = 6


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def templates(spark: SparkSession, rows=TEMPLATES + TEXTS) -> DataFrame:
    """(template, license, text)."""
    return literal_table(spark, [(i, name, text) for i, (name, text) in enumerate(rows)], "template", "license", "text")


def literal_table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small table as literals of the plan; no job and no Python worker makes it."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, row)]) for row in rows])))


def vocabulary(files: DataFrame, known: DataFrame) -> DataFrame:
    """(term, idf) of the templates' terms; idf = ln((1 + files) / (1 + files with the term)) + 1."""
    words = [r.w for r in known.select(F.explode(terms(F.col("text"))).alias("w")).distinct().collect()]
    own = F.array(*[F.lit(w) for w in sorted(words)])
    have = F.array_intersect(terms(F.coalesce(F.col("text"), F.lit(""))), own)
    # one row of the whole table (the empty word) counts the files
    df = files.select(F.explode_outer(F.concat(F.array(F.lit("")), have)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    every = literal_table(known.sparkSession, [(w,) for w in [*sorted(words), ""]], "term")
    df = every.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0).cast("long")).alias("df"))
    n = F.max(F.when(F.col("term") == "", F.col("df"))).over(Window.partitionBy(F.lit(0)))
    return df.withColumn("n", n).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.when(F.col("term") == "", 0).otherwise(F.col("df")))) + 1.0).alias("idf"))


def anchors(vectors: list[tuple[int, str, dict[str, float]]], idf: dict[str, float], cosine: float) -> list[str]:
    """Terms of which a text needs one to reach ``cosine`` with any template (number, license, weights).

    A text that shares only terms of total squared weight r with a unit vector has a cosine of sqrt(r)
    at most; of each template the most frequent terms are left out as long as they stay below that.
    """
    heavy: set[str] = set()
    for _, _, vector in vectors:
        left = 0.0
        for term in sorted(vector, key=lambda t: (idf[t], t)):
            if left + vector[term] ** 2 < cosine * cosine * 0.999:
                left += vector[term] ** 2
            else:
                heavy.add(term)
    return sorted(heavy)


def trie(words: list[str]) -> str:
    """A pattern of exactly ``words`` that shares their beginnings."""
    ends = "" in words
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    some = "|".join(re.escape(c) + trie(rest) for c, rest in sorted(heads.items()))
    if not heads:
        return ""
    return f"(?:{some})?" if ends else f"(?:{some})" if len(heads) > 1 else some


class Scorer:
    """Cosines of a text's windows to the templates."""

    def __init__(self, idf: dict[str, float], rare: float, vectors: list[tuple[int, str, dict[str, float]]], heavy: list[str], cosine: float, lines: int):
        self.idf, self.rare, self.cosine, self.lines = idf, rare, cosine, lines
        self.names = {number: name for number, name, _ in vectors}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for number, _, vector in vectors:
            for term, w in vector.items():
                self.by_term.setdefault(term, []).append((number, w))
        self.heavy = frozenset(heavy)
        self.find = re.compile(TERM).findall

    def best(self, counts: Counter) -> tuple[float, int] | None:
        """(rounded cosine, template) of the nearest template that is near enough; ties go to the first."""
        norm, dots = 0.0, {}
        for term, n in counts.items():
            w = n * self.idf.get(term, self.rare)
            norm += w * w
            for number, tw in self.by_term.get(term, ()):
                dots[number] = dots.get(number, 0.0) + w * tw
        found = [(-round(dot / math.sqrt(norm), 6), number) for number, dot in dots.items()]
        top = min(found, default=(0.0, 0))
        return (-top[0], top[1]) if -top[0] >= self.cosine else None

    def __call__(self, text: str) -> tuple[str, float, str] | None:
        """(license, cosine, its share of the text's terms) of the best window: the highest cosine, then the first, then the shortest."""
        lines = [self.find(line) for line in text.split("\n")]
        total = sum(map(len, lines))
        marked = [not self.heavy.isdisjoint(line) for line in lines]
        found = []

        def look(start: int, size: int, counts: Counter, terms: int) -> None:
            got = self.best(counts)
            if got:
                found.append((-got[0], start, size, got[1], terms))

        last = -1  # the latest marked line seen
        for start in range(len(lines)):
            last = max(last, start)
            while last < len(lines) and not marked[last]:
                last += 1
            if last >= len(lines):
                break
            if last - start >= self.lines:
                continue
            counts, terms = Counter(), 0
            for size in range(1, min(self.lines, len(lines) - start) + 1):
                own = lines[start + size - 1]
                counts.update(own)
                terms += len(own)
                if start + size > last and own:  # a line without terms changes nothing
                    look(start, size, counts, terms)
        if len(lines) > self.lines and any(marked):
            look(0, len(lines), Counter(t for line in lines for t in line), total)
        if not found:
            return None
        top = min(found)
        share = max(x[4] for x in found) / total
        return self.names[top[3]], -top[0], share


def scorer(files: DataFrame, known: DataFrame, cosine: float, lines: int) -> Scorer:
    """The scorer for ``files``: what reaches the driver are the templates' terms."""
    idf = {r.term: r.idf for r in written(vocabulary(files, known), "idf").collect()}
    rare = idf.pop("")
    vectors = []
    for r in known.select("template", "license", terms(F.col("text")).alias("ts")).orderBy("template").collect():
        w = {t: n * idf[t] for t, n in Counter(r.ts).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors.append((r.template, r.license, {t: x / norm for t, x in w.items()}))
    return Scorer(idf, rare, vectors, anchors(vectors, idf, cosine), cosine, lines)


def own_licenses(files: DataFrame, known: DataFrame | None = None, cosine: float = COSINE, file_share: float = FILE_SHARE, lines: int = LINES) -> DataFrame:
    """(path, own, own_cosine, kind) for every row of ``files``: the licence that its text names, and whether the text is one (file) or names it (header)."""
    spark = files.sparkSession
    arrow_batches(spark)
    known = templates(spark) if known is None else known
    score = scorer(files, known, cosine, lines)
    words, numbers = (sorted(t for t in score.heavy if t.isalpha() == kind) for kind in (True, False))
    whole = [rf"(?<!{kind}){trie(own)}(?!{kind})" for kind, own in (("[a-z]", words), ("[0-9]", numbers)) if own]
    sent = spark.sparkContext.broadcast(score)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                got = sent.value(text.as_py()) if text.is_valid else None
                rows.append((None, None, None) if got is None else (got[0], got[1], "file" if got[2] >= file_share else "header"))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.string())))], ["path", "own", "own_cosine", "kind"])

    low = F.lower("text")
    rows = files.select("path", F.when(low.rlike("|".join(whole) or "(?!)"), low).alias("low"))
    return rows.mapInArrow(run, "path string, own string, own_cosine double, kind string")


def parents(path: Column) -> Column:
    """All directories above a path, the nearest last: /a/b/c has '', '/a' and '/a/b'."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, known: DataFrame | None = None, cosine: float = COSINE, file_share: float = FILE_SHARE, lines: int = LINES) -> DataFrame:
    """(path, license, origin, cosine, licensed_from) for every row of ``files`` (path, text).

    ``origin`` is file (the text is a licence), header, inherited or none; of several licence files in
    a directory the licence that most name wins, then the first by name. Rows that repeat a path are
    scored by their own texts and inherit alike; a row without a path has its own licence or none. A
    null or empty text names no licence. A very long text costs its length, and each line of it that
    holds a heavy term ``lines`` squared windows. Further columns are ignored; no files give no rows.
    """
    own = written(own_licenses(files.select("path", "text"), known, cosine, file_share, lines), "own")
    votes = own.where("kind = 'file' and path is not null").groupBy(directory(F.col("path")).alias("dir"), "own").agg(F.count(F.lit(1)).alias("n"))
    held = votes.groupBy("dir").agg(F.min(F.struct(-F.col("n"), "own")).alias("b")).select(F.col("dir").alias("above"), F.col("b.own").alias("passed"))
    # each directory once: the nearest one above (itself included) that holds a licence
    dirs = own.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    up = dirs.select("dir", F.posexplode_outer(F.concat(parents(F.col("dir")), F.array("dir"))).alias("depth", "above")).join(held, "above")
    up = up.groupBy("dir").agg(F.max(F.struct("depth", "above", "passed")).alias("b")).select(F.col("dir").alias("_dir"), F.col("b.above").alias("above"), F.col("b.passed").alias("passed"))
    rows = own.join(written(up, "inherited"), directory(F.col("path")) == F.col("_dir"), "left")
    return rows.select("path", F.coalesce("own", "passed").alias("license"), F.coalesce("kind", F.when(F.col("passed").isNotNull(), "inherited"), F.lit("none")).alias("origin"), F.col("own_cosine").alias("cosine"), F.when(F.col("own").isNull(), F.col("above")).alias("licensed_from"))


def document_path(source: Column, lang: Column, doc_id: Column) -> Column:
    """A place for a document in a tree: every tenth lies in its source's language folder, others in subfolders of a hundred."""
    top = F.concat(F.lit("/"), F.coalesce(source, F.lit("_")), F.lit("/"), F.coalesce(lang, F.lit("_")))
    deep = F.when(F.pmod(doc_id, F.lit(10)) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.floor(doc_id / 100).cast("string")))
    return F.concat(top, deep, F.lit("/"), doc_id.cast("string"))
