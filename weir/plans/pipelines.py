"""Offline pipelines: parse stored HTML again, export document links, fill in document types, follow sitemaps."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weir.functions import url as U
from weir.functions.html import page_assets
from weir.operators import ingest
from weir.operators.frontier import enqueue, merge_batch
from weir.operators.numbering import checkpointed, numbered

LINKS_PER_PAGE = 30
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def stored_html(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """HTML pages with URL and text, by id; a limit is the caller's wish."""
    rows = pages.where((F.col("page_type_code") == "HTML") & F.col("url").isNotNull() & (F.length("html_content") > 0))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def candidates(pages: DataFrame, per_page: int | None = None) -> DataFrame:
    """Rows (page_id, source_url, url, page_type_code, data_type_code, ord) that stored pages link to, merged by page and URL; images and documents are BINARY."""
    parsed = stored_html(pages).select(F.col("id").alias("page_id"), F.col("url").alias("source_url"), page_assets(F.col("html_content"), F.col("url")).alias("a"))
    cut = (lambda c: F.slice(c, 1, per_page)) if per_page else (lambda c: c)
    found = F.concat(F.transform(cut(F.col("a.links")), lambda u: F.struct(u.alias("url"), F.lit(False).alias("image"))), F.transform(cut(F.col("a.images")), lambda u: F.struct(u.alias("url"), F.lit(True).alias("image"))))
    rows = parsed.select("page_id", "source_url", F.posexplode(found).alias("ord", "f")).select("page_id", "source_url", "ord", "f.url", "f.image").where("url <> source_url")
    kind = U.document_type(F.col("url"))
    typed = rows.withColumn("data_type_code", kind).withColumn("page_type_code", F.when(F.col("image") | kind.isNotNull(), "BINARY").otherwise("FRONTIER"))
    merged = ingest.merge_candidates(typed.withColumn("discovered_in", F.when(F.col("image"), "image").otherwise("link")))
    return merged.join(typed.select("page_id", "source_url").distinct(), "page_id")


def reparse(pages: DataFrame, links: DataFrame, frontier: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The page, link, frontier and document tables after all stored pages have been parsed again."""
    # read by pages, links and documents: the HTML is parsed once
    found = checkpointed(candidates(pages))
    best = found.groupBy("url").agg(F.when(F.max(F.col("page_type_code") == "BINARY"), "BINARY").otherwise("FRONTIER").alias("t"), F.min_by("data_type_code", F.when(F.col("data_type_code").isNotNull(), F.struct("page_id", "ord"))).alias("d"))
    both = pages.join(best, "url", "full_outer")
    last = pages.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long"))
    # the new URLs alone are numbered
    new = numbered(best.select("url").join(pages.select("url"), "url", "left_anti"), "__id", ["url"], last)
    promoted = (F.col("page_type_code") == "FRONTIER") & (F.col("t") == "BINARY")
    every = both.join(new, "url", "left").select(F.coalesce("id", "__id").cast(dict(pages.dtypes)["id"]).alias("id"), "url", F.when(F.coalesce(promoted, F.lit(False)), "BINARY").otherwise(F.coalesce("page_type_code", "t")).alias("page_type_code"), *[F.col(c) for c in pages.columns if c not in ("id", "url", "page_type_code")])
    ids = every.select("url", F.col("id").alias("to_page"))
    edges = links.select("from_page", "to_page").union(found.join(ids, "url").select(F.col("page_id").alias("from_page"), "to_page")).distinct()
    queued = found.where("page_type_code = 'FRONTIER'").select("url", F.lit(0).alias("priority"), F.lit(1).alias("depth"), "source_url", now.alias("discovered_at"), "ord")
    documents = best.where("d is not null").join(ids, "url").select(F.col("to_page").alias("page_id"), F.col("d").alias("data_type_code"))
    return {"pages": every, "links": edges, "frontier": enqueue(frontier, merge_batch(queued), keep_terminal=True), "page_data": documents}


def reparse_counts(before: DataFrame, after: dict[str, DataFrame]) -> DataFrame:
    """One row: pages, those inserted and promoted, edges, documents."""
    old = before.select("id", F.col("page_type_code").alias("t"), F.lit(True).alias("known"))
    p = after["pages"].join(old, "id", "left").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if((F.col("t") == "FRONTIER") & (F.col("page_type_code") == "BINARY")).alias("promoted"))
    return p.crossJoin(after["links"].agg(F.count(F.lit(1)).alias("edges"))).crossJoin(after["page_data"].agg(F.count(F.lit(1)).alias("documents")))


def document_links(pages: DataFrame, frontier: DataFrame, only_unfetched: bool = False) -> DataFrame:
    """Links from stored pages to documents, with what is known of the target: its page, status and queue state."""
    found = candidates(pages).where("data_type_code is not null").select("page_id", "source_url", "url", "data_type_code", "discovered_in")
    target = pages.select("url", F.col("id").alias("target_id"), F.col("page_type_code").alias("target_type"), "http_status_code", "accessed_time")
    rows = found.join(target, "url", "left").join(frontier.select("url", F.col("state").alias("queue_state")), "url", "left")
    unfetched = F.col("target_id").isNull() | (F.col("http_status_code").isNull() & F.col("accessed_time").isNull())
    rows = rows.withColumn("unfetched", unfetched)
    return rows.where("unfetched") if only_unfetched else rows


def export_rows(links: DataFrame) -> DataFrame:
    """document_links() under the twelve names of the export."""
    named = {"page_id": "source_page_id", "source_url": "source_page_url", "url": "candidate_url", "data_type_code": "inferred_doc_type", "discovered_in": "discovered_in", "target_id": "target_page_id", "target_type": "target_page_type", "http_status_code": "target_http_status", "accessed_time": "target_accessed_time", "queue_state": "frontier_state"}
    return links.select(*[F.col(c).alias(n) for c, n in named.items()], F.col("target_id").isNotNull().alias("has_page_row"), (~F.col("unfetched")).alias("has_fetch_result"))


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header: a file from each task, or one file, which one task copies from stored rows without holding them.  Texts are quoted, so that line breaks and empty texts come back as they are."""
    (checkpointed(rows).coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").option("timestampNTZFormat", CSV_TIME).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """What write_csv() wrote."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").option("timestampNTZFormat", CSV_TIME).schema(schema).csv(path)


def backfill_types(pages: DataFrame, page_data: DataFrame) -> DataFrame:
    """New document rows (page_id, data_type_code) for binary pages without one whose URL tells the type."""
    from weir.operators.pages import without_document_type

    rows = without_document_type(pages, page_data).select(F.col("id").alias("page_id"), U.document_type(F.col("url")).alias("data_type_code"))
    return rows.where("data_type_code is not null")


def parse_sitemap(xml: str | None) -> dict:
    """Whether it is an index, and its distinct locations; nothing for malformed XML."""
    try:
        root = ET.fromstring((xml or "").strip())
    except ET.ParseError:
        return {"is_index": False, "locs": []}
    plain = lambda tag: tag.rsplit("}", 1)[-1].lower()
    locs = [e.text.strip() for e in root.iter() if plain(e.tag) == "loc" and (e.text or "").strip()]
    return {"is_index": plain(root.tag) == "sitemapindex", "locs": list(dict.fromkeys(locs))}


def sitemap(xml: Column) -> Column:
    @F.pandas_udf("is_index boolean, locs array<string>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(t) for t in texts], columns=["is_index", "locs"])

    return parse(xml)


def sitemap_urls(documents: DataFrame, roots: list[str], source_host: str, most_documents: int = 30, most_urls: int = 1000) -> DataFrame:
    """Pages (url) that stored sitemaps (url, xml) reach from the roots, level by level, on the source's host; at most so many documents and URLs, as crawls allow themselves."""
    parsed = documents.select("url", sitemap(F.col("xml")).alias("s")).select("url", "s.is_index", "s.locs")
    spark = documents.sparkSession
    front, seen, pages = list(dict.fromkeys(roots))[:most_documents], set(), None
    while front:
        seen.update(front)
        level = parsed.join(F.broadcast(spark.createDataFrame([(u,) for u in front], "url string")), "url")
        found = level.where("not is_index").select(F.explode("locs").alias("url")).where(U.host(F.col("url")) == source_host.lower())
        pages = found if pages is None else pages.union(found)
        room = most_documents - len(seen)
        below = level.where("is_index").select(F.explode("locs").alias("url")).distinct().orderBy("url").limit(most_documents).collect() if room > 0 else []
        front = [r["url"] for r in below if r["url"] not in seen][:room]
    return (pages if pages is not None else spark.createDataFrame([], "url string")).distinct().orderBy("url").limit(most_urls)
