"""License scans with native operations (operator 9).

A document is cut into overlapping windows of three-word shingles, and MinHash bands over the windows retrieve
templates; a retrieved template counts if the document holds at least ``CONTAINMENT`` of its shingles, which is
checked exactly.

Windows and bands follow the templates' lengths.  Templates are put into size classes a quarter apart; for a class
that spans ``run`` shingles, windows start every ``step``, about half of that, and hold run + step - 1, so that
every run of so many shingles lies in one of them as a whole.  A band is one MinHash value, and a class has so many
bands that a window with half of the shingles that a template needs misses all of them with a probability of at
most ``MISS`` = 1e-6.  A template of one shingle has windows of one shingle, which can't miss.  So a notice is found
whatever its length, if at least half of what it needs stands together; one in smaller pieces may be missed.

Most of a text is passed over first, without loss: a text that holds none of a chosen fifth of a template's words
(the longest ones) lacks more than a fifth of its shingles, and a window without a shingle of a template has no
band in common with it.

The templates are a parameter.  They are a table: only the number of their words and, of a small table, its words are looked at beforehand.
What is made of them is broadcast if its bytes, which are summed first, are few, and else joined by a shuffle.

Defined results: null and empty texts and texts of fewer than three words match nothing, as do templates of
fewer than three words; repeated rows are reported each; null ids are reported; with no templates there are
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.decontaminate import words
from weir.llm.tables import BROADCAST_BYTES, Saved, small

SHINGLE = 3
CONTAINMENT = 0.8
MISS = 1e-6
#: Words of all templates up to which some are chosen, and chosen ones up to which texts are passed over by them; beyond, every text is probed.
LOOKED_AT, MOST_WORDS = 20_000, 2_000

# Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-line": "Released under the MIT License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED
BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
}


def templates(spark: SparkSession) -> DataFrame:
    """The built-in notices: (license_id, text)."""
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license_id string, text string")


def _shingles(w):
    n = F.size(w) - SHINGLE + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def size_class(n: int) -> int:
    """The run of shingles that a template of n shingles is looked for in: up to a quarter more, for words put in between, rounded up to a step of the ladder."""
    run = 1
    while run < n + n // 4:
        run = max(run + 1, run * 5 // 4)
    return run


def bands_of(run: int, smallest: int, containment: float) -> tuple[int, int, int]:
    """Step and length of a class's windows, and its bands, of which a template of at least ``smallest`` shingles is missed by all with a probability of MISS at most."""
    step = max(1, run // 2)
    length = run + step - 1
    held = max(1, math.ceil(math.ceil(containment * smallest) / 2))
    likeness = held / (length + smallest - held)
    return step, length, 1 if likeness >= 1 else math.ceil(math.log(MISS) / math.log1p(-likeness))


def _values(shingles: Column, bands: Column) -> Column:
    """The MinHash value of each band."""
    return F.transform(F.sequence(F.lit(1), bands), lambda k: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, k))))


def _chosen_words(known: list, containment: float) -> set[str]:
    """Of each template so many words that a text without all of them lacks too many of its shingles."""
    chosen: set[str] = set()
    for r in known:
        lost, most = 0, len(r["t"]) - math.ceil(containment * len(r["t"]) - 1e-9)
        for word in sorted(set(r["w"]), key=lambda x: (-len(x), x)):
            if lost > most:
                break
            chosen.add(word)
            # without this word, every shingle that holds it is missing
            lost = len({tuple(r["w"][k : k + SHINGLE]) for k in range(len(r["w"]) - SHINGLE + 1) if chosen.intersection(r["w"][k : k + SHINGLE])})
    return chosen


def scan(docs: DataFrame, notices: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Rows (id_col, license_id, containment) of the notices that documents hold."""
    spark = docs.sparkSession
    own = notices.select(F.col("license_id").cast("string").alias("license_id"), words(F.col("text")).alias("w")).select("license_id", "w", F.array_distinct(_shingles(F.col("w"))).alias("t")).where(F.size("t") > 0)
    own = Saved(own, "templates").df
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # a row for each number of words that a template has
    lengths = own.groupBy(F.size("w").alias("n_words")).agg(F.min(F.size("t")).alias("least"), F.count(F.lit(1)).alias("n")).collect()
    if not lengths:
        return docs.select(F.col("id").alias(id_col), F.lit("").alias("license_id"), F.lit(0.0).alias("containment")).limit(0)
    run_of = {r["n_words"]: size_class(r["n_words"] - SHINGLE + 1) for r in lengths}
    by_run: dict[int, int] = {}
    for r in lengths:
        run = run_of[r["n_words"]]
        by_run[run] = min(by_run.get(run, r["least"]), r["least"])
    settings = spark.createDataFrame([(run, *bands_of(run, n, containment)) for run, n in sorted(by_run.items())], "run int, step int, length int, bands int")
    runs = spark.createDataFrame(sorted(run_of.items()), "n_words int, run int")
    classed = own.join(F.broadcast(runs), F.size("w") == F.col("n_words")).join(F.broadcast(settings), "run").select("license_id", "t", "run", "step", "length", "bands")

    looked_at = sum(r["n_words"] * r["n"] for r in lengths) <= LOOKED_AT
    chosen = _chosen_words(own.select("w", "t").collect(), containment) if looked_at else set()
    cut = docs.select("id", words(F.col("text")).alias("w"))
    if chosen and len(chosen) <= MOST_WORDS:
        cut = cut.where(F.arrays_overlap("w", F.array(*[F.lit(x) for x in sorted(chosen)])))
    # each text is split once; a row's place in its partition names it
    rows = Saved(cut.select(F.monotonically_increasing_id().alias("key"), "id", _shingles(F.col("w")).alias("s")).where(F.size("s") > 0), "shingles").df

    probe = classed.select(F.explode("t").alias("x"), "run", "step", "length").distinct()
    hits = rows.select("key", F.posexplode("s").alias("at", "x")).join(small(probe, BROADCAST_BYTES), "x")
    # the windows over a shingle that a template has
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("length") + 1) / F.col("step"))).cast("int")
    windows = hits.select("key", "run", F.explode(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int"))).alias("window")).distinct()
    held = windows.join(F.broadcast(settings), "run").join(rows.select("key", "s"), "key").select("key", "run", "bands", F.slice("s", F.col("window") * F.col("step") + 1, F.col("length")).alias("x"))
    banded = held.select("key", "run", F.posexplode(_values(F.col("x"), F.col("bands"))).alias("band", "value"))
    theirs = classed.select("license_id", "run", F.posexplode(_values(F.col("t"), F.col("bands"))).alias("band", "value"))
    found = banded.join(small(theirs, BROADCAST_BYTES), ["run", "band", "value"]).select("key", "license_id").distinct()

    share = F.size(F.array_intersect("t", "s")) / F.size("t")
    verified = found.join(rows, "key").join(small(own.select("license_id", "t"), BROADCAST_BYTES), "license_id").select(F.col("id").alias(id_col), "license_id", share.alias("containment"))
    return verified.where(F.col("containment") >= containment)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """The built-in notices in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), templates(spark))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP9_SQL = f"""
WITH t AS (SELECT license_id, {_WORDS} AS w FROM (VALUES {_VALUES}) v(license_id, text)),
ts AS (SELECT DISTINCT license_id, w[i:i+2] AS s FROM (SELECT license_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
tn AS (SELECT license_id, count(*) AS n FROM ts GROUP BY license_id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dss AS (SELECT doc_id, w[i:i+2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT doc_id, license_id, count(DISTINCT dss.s) AS m FROM dss JOIN ts ON dss.s = ts.s GROUP BY doc_id, license_id)
SELECT doc_id, license_id, m / CAST(n AS DOUBLE) AS containment FROM h JOIN tn USING (license_id) WHERE m / CAST(n AS DOUBLE) >= {CONTAINMENT}
"""
