"""Benchmark decontamination with native operations (operator 8).

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z has been lower-cased.  Every run of 13
words of a benchmark item is a window; an item of fewer words, but not none, is one window.  The
windows' 64-bit hashes are broadcast as a hash set, if their number is proven small; each document's word
windows are hashed once for each window length that occurs, probed, and hits are verified on the words
themselves.  Each document also probes one marker entry, so that a single pass gives a row for clean
documents too.  A larger benchmark is shuffled by hash: then hashes and places alone are sent to it, hits go
back to their documents to be verified, and clean documents come in by a left join.

Defined results: a null or empty text has no words and is clean; an item without words has no window;
repeated rows get the same result each; a null id is an id like any other; null item ids are left out
of the lists; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.tables import Saved

WINDOW = 13
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows (a few tens of megabytes) up to which the benchmark is broadcast.
BROADCAST_WINDOWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")


def _window_hash(array: Column, at: Column, size: Column) -> Column:
    return F.xxhash64(F.slice(array, at, size))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (hash, size, window, items) of the distinct windows; items: the sorted ids, as strings, that have it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    rows = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("window"))
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("window").alias("hash"), F.size("window").alias("size"), "window", "items")


def _places(sizes: list[int], *more: Column) -> Column:
    """Rows (at, n) of every window of each length; at counts from 1."""
    parts = list(more)
    pair = lambda size: lambda i: F.struct(i.alias("at"), F.lit(size).alias("n"))
    for size in sizes:
        ends = F.size("w") - size + 1
        parts.append(F.when(ends >= 1, F.transform(F.sequence(F.lit(1), F.greatest(ends, F.lit(1))), pair(size))).otherwise(F.array().cast("array<struct<at:int,n:int>>")))
    return F.explode(F.concat(*parts))


def _same(window: str = "window") -> Column:
    return F.slice("w", F.col("at"), F.col("n")) == F.col(window)


def _broadcast_hits(w: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Rows (id, text_key, at, n, n_words, items) of all hits and, with n = 0, of every text."""
    marker = windows.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"), F.lit(0).alias("size"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
    probe = F.broadcast(windows.unionByName(marker))
    starts = w.select("id", "text_key", "w", _places(sizes, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")))).alias("p"))
    probed = starts.select("id", "text_key", "w", F.col("p.at").alias("at"), F.col("p.n").alias("n"), F.when(F.col("p.n") == 0, F.lit(0).cast("long")).otherwise(_window_hash(F.col("w"), F.col("p.at"), F.col("p.n"))).alias("hash"))
    found = probed.join(probe, (probed["hash"] == probe["hash"]) & (probed["n"] == probe["size"]) & ((probed["n"] == 0) | _same()))
    return found.select("id", "text_key", "at", "n", F.size("w").alias("n_words"), "items")


def _shuffled_hits(w: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """The same where the windows are too many to broadcast: only hashes and places meet them."""
    key = F.xxhash64("id", "text_key").alias("key")
    starts = w.select(key, "w", _places(sizes).alias("p")) if sizes else w.select(key, "w", F.lit(None).cast("struct<at:int,n:int>").alias("p")).limit(0)
    probes = starts.select("key", F.col("p.at").alias("at"), F.col("p.n").alias("n"), _window_hash(F.col("w"), F.col("p.at"), F.col("p.n")).alias("hash"))
    met = probes.join(windows.select("hash", F.col("size").alias("n"), "window", "items"), ["hash", "n"]).select("key", "at", "n", "window", "items").distinct()
    # texts whose keys are equal by chance are verified each
    found = w.select(key, "id", "text_key", "w").join(met, "key").where(_same()).select("id", "text_key", "at", "n", F.size("w").alias("n_words"), "items")
    every = w.select("id", "text_key", F.lit(0).alias("at"), F.lit(0).alias("n"), F.size("w").alias("n_words"), F.lit(None).cast("array<string>").alias("items"))
    return found.union(every)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per distinct (id, text): id, text_key, n_words, n_hit, spans (array of hit start and end, 0-based, merged), items, copies (equal rows)."""
    windows = Saved(benchmark_windows(benchmark, window), "windows").df
    n = windows.count()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window`` numbers
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("\0")), 256)
    w = docs.select(F.col(id_col).alias("id"), key.alias("text_key"), words(F.col(text_col).cast("string")).alias("w"))
    found = _broadcast_hits(w, windows, sizes) if n <= BROADCAST_WINDOWS else _shuffled_hits(w, windows, sizes)
    per_doc = found.groupBy("id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.struct((F.col("at") - 1).alias("s"), (F.col("at") - 1 + F.col("n")).alias("e"))))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count_if(F.col("n") == 0).alias("copies"),
    )
    # merged spans: a start that no earlier span reaches begins one
    starts_at = F.expr("aggregate(raw, struct(-1 as e, cast(array() as array<struct<s:int,e:int>>) as out), (a, x) -> if(x.s > a.e, struct(x.e as e, concat(a.out, array(struct(x.s as s, x.e as e))) as out), struct(greatest(a.e, x.e) as e, concat(slice(a.out, 1, size(a.out) - 1), array(struct(element_at(a.out, -1).s as s, greatest(a.e, x.e) as e))) as out)), a -> a.out)")
    n_hit = F.expr("aggregate(raw, struct(0 as e, 0L as n), (a, x) -> struct(greatest(a.e, x.e) as e, a.n + greatest(0, x.e - greatest(a.e, x.s)) as n), a -> a.n)")
    return per_doc.select("id", "text_key", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), starts_at.alias("spans"), "items", "copies")


def judged(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_words, n_hit, items, spans and contaminated (n_hit > 0 and n_hit >= share * n_words)."""
    out = hits(docs, benchmark, window, id_col, text_col)
    rows = out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    # the share as a fraction, so that no rounding decides
    part = Fraction(str(share))
    return rows.select(F.col("id").alias(id_col), "text_key", "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (part.denominator * F.col("n_hit") >= part.numerator * F.col("n_words"))).alias("contaminated"))


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that docs has no column of."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated documents, all columns as they were."""
    of_id, of_key = _fresh(docs, "__id", "__key")
    bad = judged(docs, benchmark, share, window, id_col, text_col).where("contaminated").select(F.col(id_col).alias(of_id), F.col("text_key").alias(of_key)).distinct()
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("\0")), 256)
    return docs.join(bad, docs[id_col].eqNullSafe(bad[of_id]) & (key == bad[of_key]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the hit words of each text cut out, from the first to the last character of each span; all other text and columns as they were."""
    of_id, of_key, spans, parts = _fresh(docs, "__id", "__key", "__spans", "__parts")
    found = hits(docs, benchmark, window, id_col, text_col).where("n_hit > 0").select(F.col("id").alias(of_id), F.col("text_key").alias(of_key), F.col("spans").alias(spans))
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("\0")), 256)
    joined = docs.join(found, docs[id_col].eqNullSafe(found[of_id]) & (key == found[of_key]), "left")
    # the text as alternating breaks and words: word k is element 2k+1 of the cut text
    kept = F.concat(F.array(F.lit("")), F.split(F.col(text_col), r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])|(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"))
    is_word = lambda x: ~x.rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]") & (x != "")
    with_parts = joined.withColumn(parts, F.when(F.col(spans).isNotNull(), kept))
    first = F.when(is_word(F.element_at(parts, 2)), 0).otherwise(1)
    word_no = lambda i: F.floor((i - 1 - first) / 2)
    inside = lambda i, word: F.exists(spans, lambda s: (s["s"] <= word_no(i)) & (word_no(i) + F.when(word, 0).otherwise(1) < s["e"]) & (word_no(i) >= 0))
    left = F.filter(F.transform(parts, lambda x, i: F.when(inside(i, is_word(x)), None).otherwise(x)), lambda x: x.isNotNull())
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(left, ""))
    return with_parts.withColumn(text_col, text).select(*[F.col(c) for c in docs.columns])


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = judged(docs, benchmark)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i+12] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i+n-1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
