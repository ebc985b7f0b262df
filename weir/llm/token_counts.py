"""Token counts through an exact length histogram (operator 5).

Documents are encoded once and summed up by encoded length; the histogram is bounded by the number of
different lengths.  Suffix sums over it answer, for every context limit at once, how many documents are
longer, how many tokens they hold, and how many tokens remain when each document is cut at the limit.

Suffix sums run in two steps, so that no task needs all lengths: within blocks of ``BLOCK`` lengths, and
over the blocks' totals.

Defined results: a null or empty text has length 0; repeated rows count each; an empty table has an empty
histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.tables import Saved

BLOCK = 4096


def token_lengths(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", piece: int = 200_000) -> DataFrame:
    """Rows (length) of the byte-pair token counts of each text.

    A text longer than ``piece`` characters is cut into whole pre-tokens, which encode on their own, so that
    the encoder's buffers stay small; the count is that of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        word = regex.compile(pattern)

        def count(text: str | None) -> int:
            if not text:
                return 0
            if len(text) <= piece:
                return len(encoder.encode_ordinary(text))
            total = start = 0
            for m in word.finditer(text):
                # what comes after a character that is no white space has no effect on the pre-tokens before it
                if m.end() - start >= piece and not m.group()[-1].isspace():
                    total += len(encoder.encode_ordinary(text[start : m.end()]))
                    start = m.end()
            return total + len(encoder.encode_ordinary(text[start:]))

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([count(t.as_py()) for t in batch.column(0)], pa.int64())], names=["length"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Rows (length, n_docs) of rows (length)."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length: n_docs and n_tokens of it; docs_longer and tokens_longer of all greater lengths; docs_total and tokens_total; tokens_cut, all tokens when texts are cut at this length."""
    # written once: the sums read the histogram twice, the texts are encoded once
    counts = Saved(counts.select("length", "n_docs"), "lengths").df
    rows = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    after = blocks.select("block", zero(F.sum("d").over(later)).alias("d_later"), zero(F.sum("t").over(later)).alias("t_later"), F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(after, "block").select(
        "length", "n_docs", "n_tokens",
        (zero(F.sum("n_docs").over(inside)) + F.col("d_later")).alias("docs_longer"), (zero(F.sum("n_tokens").over(inside)) + F.col("t_later")).alias("tokens_longer"),
        "docs_total", "tokens_total",
    )
    return out.withColumn("tokens_cut", F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: docs_longer, tokens_cut (tokens left when texts are cut at it) of all texts; with no text, zeros."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "limit long")
    best = asked.join(sums, F.col("length") <= F.col("limit")).groupBy("limit").agg(F.max_by(F.struct("docs_longer", "tokens_longer", "tokens_total"), "length").alias("s"))
    whole = sums.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t"))
    rows = asked.join(best, "limit", "left").join(F.broadcast(whole))
    longer, tokens = F.coalesce("s.docs_longer", "d", F.lit(0)), F.coalesce("s.tokens_longer", "t", F.lit(0))
    return rows.select("limit", longer.alias("docs_longer"), (F.coalesce("t", F.lit(0)) - tokens + longer * F.col("limit")).alias("tokens_cut"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of all texts does not exceed; no row for an empty histogram."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    reached: Column = (F.col("docs_total") - F.col("docs_longer")) >= F.col("share") * F.col("docs_total")
    return asked.join(sums, reached).groupBy("share").agg(F.min("length").alias("length"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """The exact length histogram of documents with its suffix sums."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_suffix_sums(histogram(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)))
