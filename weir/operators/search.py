"""Text search by trigrams: a posting list tells which rows can hold a term before any text is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that postings are dealt to by their trigram.
PARTS = 64


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text, case ignored; none of a shorter one."""
    one = F.split(F.lower(text), "")
    rest = lambda k: F.slice(one, k + 1, F.greatest(F.size(one) - k, F.lit(0)))
    runs = F.transform(F.arrays_zip(one.alias("a"), rest(1).alias("b"), rest(2).alias("c")), lambda x: F.concat(x["a"], x["b"], x["c"]))
    return F.filter(F.array_distinct(runs), lambda g: F.length(g) == 3)


def part_of(trigram: Column) -> Column:
    return F.pmod(F.crc32(trigram), F.lit(PARTS)).cast("int")


def postings(rows: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """Posting list (part, trigram, id) of the trigrams of rows' text columns.

    The longest column alone would give as many rows as it has different trigrams; each is kept once a row."""
    own = F.array_distinct(F.flatten(F.array(*[trigrams(F.coalesce(c, F.lit(""))) for c in columns])))
    return rows.select(F.col(id_col).alias("id"), F.explode(own).alias("trigram")).select(part_of(F.col("trigram")).alias("part"), "trigram", "id")


def write_postings(index: DataFrame, path: str) -> None:
    """Keeps a posting list by part, and sorted by trigram within, so that a search reads a term's parts and skips most of their row groups.

    Trigrams that all rows have make large parts: Spark deals those to as many tasks as their size asks for, each of which sorts its own file."""
    index.hint("rebalance", "part").sortWithinPartitions("part", "trigram", "id").write.mode("overwrite").partitionBy("part").parquet(path)


def pieces(term: str) -> list[str]:
    """The runs of a term between its wildcards ``%`` and ``_``."""
    return [p for p in term.replace("_", "%").split("%") if p]


def wanted_trigrams(spark, term: str) -> list[str]:
    """The trigrams that every text matching the term has: lower-cased by Spark, as texts are."""
    rows = spark.createDataFrame([(p,) for p in pieces(term)], "p string")
    return sorted({t for r in rows.select(trigrams(F.col("p")).alias("t")).collect() for t in r.t})


def candidates(index: DataFrame, term: str) -> DataFrame | None:
    """Ids (id) of the rows that have all trigrams of a term; None if the term is too short to have any."""
    wanted = wanted_trigrams(index.sparkSession, term)
    if not wanted:
        return None
    parts = sorted({r[0] for r in index.sparkSession.createDataFrame([(t,) for t in wanted], "t string").select(part_of(F.col("t"))).collect()})
    hits = index.where(F.col("part").isin(parts) & F.col("trigram").isin(wanted))
    return hits.groupBy("id").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted)).select("id")


def matching(rows: DataFrame, index: DataFrame, term: str | None, columns: list[str], id_col: str = "id") -> DataFrame:
    """Rows one of whose columns has the term, as by a scan with ilike: only candidates of the posting list are compared."""
    t = (term or "").strip()
    if not t:
        return rows
    found = candidates(index, t)
    some = rows if found is None else rows.join(found.withColumnRenamed("id", id_col), id_col, "left_semi")
    has = F.lit(False)
    for c in columns:
        has = has | F.coalesce(F.col(c).ilike(f"%{t}%"), F.lit(False))
    return some.where(has)
