"""A corpus pipeline over ``documents``: each stage works on all rows that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last keep the columns of documents.
The stages cannot be expressed in SQL; their test compares them with plain versions on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm import decontaminate, language_id, near_dup, secrets, sentencepiece_bpe
from weir.llm.tables import Saved, fixed

ORACLE_SQL = None


LANG, ROW, OLD = "__weir_lang", "__weir_row", "__weir_old"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in no language: a null or empty text, or one without letters.

    The model learns from rows with an id, a text and a language that are not held out; without any, every document is in no
    language.  Repeated rows and those with null ids are judged by their texts like all others, however long; an empty table stays empty."""
    labelled = docs.where(~language_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    found = language_id.predict(docs, language_id.fit(labelled))
    return docs.withColumn(LANG, found).where(F.col(LANG)["lang_pred"] != "und").drop(LANG)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the document of the smallest id of each group of near duplicates.

    A row without an id is a document of its own, which comes after those with ids; of rows with one id, which are one document,
    the row of the smallest text stays.  Null and empty texts are like nothing.  An empty table stays empty."""
    last = F.lit((1 << 63) - 1) - F.monotonically_increasing_id()
    # rows without an id are named by their places, which have to be the same in both uses
    keyed = fixed(docs, "docs").withColumn(ROW, F.coalesce(F.col("doc_id").cast("long"), last))
    gone = near_dup.near_duplicates(keyed, id_col=ROW).where("not kept").select(ROW).distinct()
    kept = keyed.join(gone, ROW, "left_anti")
    again = Saved(keyed.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ROW), "repeated").df
    if not again.isEmpty():
        first = F.row_number().over(Window.partitionBy(ROW).orderBy("text", *[F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))]))
        one = kept.join(again, ROW, "left_semi").withColumn(OLD, first).where(F.col(OLD) == 1).drop(OLD)
        kept = kept.join(again, ROW, "left_anti").unionByName(one)
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more stands in benchmark items.

    Null and empty texts are clean, repeated rows and null ids are judged each, and an empty benchmark removes nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; n_chars follows a text that changes.

    Null and empty texts stay as they are, and so does every other column; repeated rows and null ids stay rows of their own."""
    import public_tokenizers

    clean = secrets.redact(docs.withColumn(OLD, F.col("text")), public_tokenizers.path("word_bpe_49k.json"))
    n_chars = F.when(F.col("text").eqNullSafe(F.col(OLD)), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with their number and the digests of the ids and of the text they decode to.

    A null or empty text has no ids; every row stays, repeated ones and those with null ids too."""
    import public_tokenizers

    return sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = Saved(stage(spark, docs, sf_dir), f"stage-{name}").df
    return docs
