"""Page search, relevance, sites and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import scoring
from weir.functions import url as U

SUMMARY_PAGES = 5000


def collected(pages: DataFrame) -> DataFrame:
    """Pages with a URL that are more than a frontier entry (a null type counts as collected)."""
    return pages.where(F.col("url").isNotNull() & ~F.col("page_type_code").eqNullSafe("FRONTIER"))


def of_type(pages: DataFrame, page_type: str | None) -> DataFrame:
    """ALL or blank: every page; DUPLICATE: those that point at another; else by type."""
    kind = (page_type or "").strip().upper()
    if kind in ("", "ALL"):
        return pages
    return pages.where(F.col("duplicate_of_page_id").isNotNull()) if kind == "DUPLICATE" else pages.where(F.col("page_type_code") == kind)


def matching(pages: DataFrame, term: str | None) -> DataFrame:
    """Pages whose URL or HTML has the term, case ignored; ``%`` and ``_`` stand for any text and character."""
    t = (term or "").strip()
    return pages.where(F.col("url").ilike(f"%{t}%") | F.col("html_content").ilike(f"%{t}%")) if t else pages


def with_hints(pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """Pages with source_url and depth of their URL's newest frontier row; null and 0 where there is none."""
    newest = frontier.groupBy(F.trim("url").alias("__url")).agg(F.max_by(F.struct("source_url", "depth"), F.struct("discovered_at", "id")).alias("h"))
    out = pages.join(newest, F.trim(pages["url"]) == F.col("__url"), "left")
    return out.select(*[pages[c] for c in pages.columns], F.col("h.source_url").alias("source_url"), F.coalesce("h.depth", F.lit(0)).alias("depth"))


def scored(pages: DataFrame, policy: scoring.Policy) -> DataFrame:
    """Pages (url, source_url, depth, …) with score and the three marks of evidence."""
    keyword, suffix, same, _ = scoring.page_evidence(F.col("url"), F.col("source_url"), policy)
    score = scoring.page_score(F.col("url"), F.col("source_url"), F.col("depth"), policy)
    return pages.withColumns({"score": F.round(score, 6), "has_keyword": keyword, "has_suffix": suffix, "has_same_host": same})


def search(pages: DataFrame, sites: DataFrame, term: str | None = None, page_type: str | None = None, order: str = "latest", skip: int = 0, take: int = 50) -> DataFrame:
    """A page of results with their site's domain; order: latest or best_score (then pages need a score)."""
    found = matching(of_type(pages, page_type), term).join(sites.select(F.col("domain").alias("__d"), F.col("domain").alias("site_domain")), F.col("domain") == F.col("__d"), "left").drop("__d", "html_content")
    keys = [F.desc("accessed_time"), F.col("id")]
    return found.orderBy(*([F.desc("score"), *keys] if order == "best_score" else keys)).offset(max(0, skip)).limit(take)


def relevance_report(pages: DataFrame, skip: int = 0, take: int = 100) -> DataFrame:
    """Scored pages, best first; 1 to 500 of them."""
    return pages.orderBy(F.desc("score"), F.desc("accessed_time"), "id").offset(max(0, skip)).limit(min(max(take, 1), 500))


def upper_median(values: Column) -> Column:
    """Element n / 2 of the sorted array, counted from zero; 0 of none."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def relevance_summary(pages: DataFrame, top: int = SUMMARY_PAGES) -> DataFrame:
    """Counts and averages over the best scored pages; the limit is the report's own."""
    best = pages.orderBy(F.desc("score"), F.desc("accessed_time"), "id").limit(top)
    return best.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if("has_keyword").alias("keyword"), F.count_if("has_suffix").alias("suffix"), F.count_if("has_same_host").alias("same_host"),
        F.count_if(F.col("has_keyword") | F.col("has_suffix")).alias("relevant"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("average"), upper_median(F.collect_list("score")).alias("median"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top"),
    )


def site_summary(pages: DataFrame, sites: DataFrame, term: str | None = None) -> DataFrame:
    """For each site (also those without pages): pages, average, upper median and top score, last access, composite score.

    The median is taken by row number, so that no task holds a large site's scores."""
    t = (term or "").strip().lower()
    wanted = sites.where(F.contains(F.lower("domain"), F.lit(t))) if t else sites
    rows = collected(pages).join(wanted.select("domain"), "domain", "left_semi")
    stats = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("average"), F.max("score").alias("top"), F.max("accessed_time").alias("last_access"))
    # how many pages of the site have each score: the median is the first score whose running count passes n / 2
    by_score = rows.groupBy("domain", "score").agg(F.count(F.lit(1)).alias("m")).join(stats.select("domain", "n"), "domain")
    running = F.sum("m").over(Window.partitionBy("domain").orderBy("score"))
    median = by_score.withColumn("c", running).where(F.col("c") > F.floor(F.col("n") / 2)).groupBy("domain").agg(F.min("score").alias("median"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = wanted.select("domain").join(stats, "domain", "left").join(median, "domain", "left")
    n = F.coalesce("n", F.lit(0))
    composite = F.when(n > 0, scoring.site_score(F.col("average"), F.col("top"), n)).otherwise(0.0)
    return out.select("domain", n.alias("n_pages"), F.round(zero(F.col("average")), 6).alias("average"), zero(F.col("median")).alias("median"), zero(F.col("top")).alias("top"), "last_access", F.round(composite, 6).alias("site_score"))


def ordered_sites(summary: DataFrame, order: str = "pages", skip: int = 0, take: int = 100) -> DataFrame:
    """Sites by pages, links (columns outbound and backlinks) or relevance; names without regard to case break ties."""
    first = {"links": F.desc(F.col("outbound") + F.col("backlinks")) if "outbound" in summary.columns else F.desc("n_pages"), "relevance": F.desc("site_score")}.get(order, F.desc("n_pages"))
    return summary.orderBy(first, F.desc("n_pages"), F.lower("domain"), "domain").offset(max(0, skip)).limit(take)


def zero_filled(counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts (key, n) for all values, 0 where there is none, with their place (ord)."""
    every = counts.sparkSession.createDataFrame([(k, v) for k, v in enumerate(values)], f"ord int, {key} string")
    return F.broadcast(every).join(counts, key, "left").select("ord", key, F.coalesce("n", F.lit(0)).alias("n"))


def type_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce("page_type_code", F.lit("Unknown")).alias("page_type")).agg(F.count(F.lit(1)).alias("n"))


def document_counts(pages: DataFrame, page_data: DataFrame) -> DataFrame:
    """Binary pages by document type: the stored type of the first row if it is known, else by URL."""
    stored = page_data.where("data_type_code is not null").groupBy("page_id").agg(F.upper(F.min_by("data_type_code", "id")).alias("stored"))
    rows = pages.where("page_type_code = 'BINARY'").join(stored, F.col("id") == F.col("page_id"), "left")
    kind = F.coalesce(F.when(F.col("stored").isin(U.DOCUMENT_ORDER), F.col("stored")), U.document_type(F.col("url")))
    return zero_filled(rows.select(kind.alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", U.DOCUMENT_ORDER)


def image_counts(pages: DataFrame) -> DataFrame:
    """Binary pages by image type; whatever is no known image is OTHER."""
    rows = pages.where("page_type_code = 'BINARY' and url is not null").select(F.coalesce(U.image_type(F.col("url")), F.lit("OTHER")).alias("type"))
    return zero_filled(rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", U.IMAGE_ORDER)


def statistics(pages: DataFrame, sites: DataFrame, images: DataFrame) -> DataFrame:
    """The dashboard's one row."""
    p = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("page_type_code") == "HTML").alias("html_pages"), F.count_if(F.col("page_type_code") == "DUPLICATE").alias("duplicates"))
    rows = p.crossJoin(sites.agg(F.count(F.lit(1)).alias("sites"))).crossJoin(images.agg(F.count(F.lit(1)).alias("images")))
    return rows.withColumn("images_per_page", F.when(F.col("html_pages") > 0, F.bround(F.col("images") / F.col("html_pages"), 2)).otherwise(0.0))


def without_document_type(pages: DataFrame, page_data: DataFrame) -> DataFrame:
    """Binary pages that have no stored document row."""
    return pages.where("page_type_code = 'BINARY'").join(page_data.select(F.col("page_id").alias("id")).distinct(), "id", "left_anti")


def details(pages: DataFrame, sites: DataFrame, images: DataFrame, page_data: DataFrame) -> DataFrame:
    """Pages with their site, images and stored data nested."""
    site = sites.select(F.col("domain"), F.struct(*[F.col(c) for c in sites.columns]).alias("site"))
    media = images.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("id", "filename", "content_type"))).alias("images"))
    data = page_data.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("id", "data_type_code"))).alias("data"))
    return pages.join(site, "domain", "left").join(media.withColumnRenamed("page_id", "__i"), F.col("id") == F.col("__i"), "left").join(data.withColumnRenamed("page_id", "__d"), F.col("id") == F.col("__d"), "left").drop("__i", "__d")
