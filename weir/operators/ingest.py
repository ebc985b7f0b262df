"""Ingesting crawled pages: duplicates by content, page upserts, links, images and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import documents
from weir.functions.url import host, image_content_type, image_record_name, without_fragment
from weir.operators.numbering import checkpointed, numbered

#: Rows from which on a content is common, and shares to which the rows of a common content are dealt.
COMMON, SHARES = 10_000, 64


def looked_up(rows: DataFrame, known: DataFrame, place: str) -> DataFrame:
    """Rows (content_hash, place, …) with what known(content_hash, …), one row a content, has for their content; nulls where it has nothing.

    Every task gets a bounded part of a common content: its rows are dealt to shares by their place, and meet a copy of its known row in
    each; there is one common content in ``COMMON`` rows at most.  All others are joined by content alone."""
    of = known.columns[1:]
    common = rows.groupBy("content_hash").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > COMMON).select("content_hash", F.lit(True).alias("__common"))
    each = common.join(known, "content_hash", "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = rows.withColumn("__share", F.pmod(F.xxhash64(place), F.lit(SHARES)).cast("int"))
    marked = dealt.join(each, ["content_hash", "__share"], "left")
    rest = marked.where("__common IS NULL").select(*rows.columns).join(known, "content_hash", "left")
    return marked.where("__common").select(*rows.columns, *of).unionByName(rest.select(*rows.columns, *of))


def canonical_pages(pages: DataFrame) -> DataFrame:
    """Pages (id, content_hash, …) with canonical_id, the smallest id that has the same content."""
    first = pages.groupBy("content_hash").agg(F.min("id").alias("canonical_id"))
    # texts stay where they are: contents are looked up for ids alone
    found = looked_up(pages.select("content_hash", "id").where("content_hash IS NOT NULL").distinct(), first, "id").select("id", "content_hash", "canonical_id")
    return pages.join(found, ["id", "content_hash"], "left")


def duplicate_groups(pages: DataFrame) -> DataFrame:
    """Contents that several pages have: content_hash, n, first_id."""
    return pages.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def classify(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (id, url, content_hash): known_url (no hash then), duplicate_content or new_html, with the page meant."""
    by_url = known.groupBy("url").agg(F.min("id").alias("__u"))
    by_hash = known.groupBy("content_hash").agg(F.min("id").alias("__h"))
    rows = looked_up(candidates.join(by_url, "url", "left"), by_hash, "id")
    kind = F.when(F.col("__u").isNotNull(), "known_url").when(F.col("__h").isNotNull(), "duplicate_content").otherwise("new_html")
    return rows.select("id", "url", kind.alias("kind"), F.coalesce("__u", "__h").alias("page_id"), F.when(F.col("__u").isNull(), F.col("content_hash")).alias("content_hash"))


def _last(rows: DataFrame) -> DataFrame:
    """The greatest id, 0 of none."""
    return rows.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long"))


def site_cache(sites: DataFrame) -> DataFrame:
    """Sites by name without case and blanks around it, the smallest id of each."""
    return sites.where(F.trim("domain") != "").groupBy(F.lower(F.trim("domain")).alias("domain")).agg(F.min("id").alias("id"))


def sites_of(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """All sites (id, domain) after urls (url): new hosts get ids after the greatest, in the order of their names."""
    new = urls.select(host(F.col("url")).alias("domain")).where("domain <> ''").distinct().join(sites.select(F.lower(F.trim("domain")).alias("domain")), "domain", "left_anti")
    named = numbered(new, "id", ["domain"], _last(sites)).select(F.col("id").cast(dict(sites.dtypes)["id"]).alias("id"), "domain")
    return sites.select("id", "domain").unionByName(named)


def upsert_pages(pages: DataFrame, batch: DataFrame) -> DataFrame:
    """Pages (id, url, page_type_code, html_content, content_hash, duplicate_of_page_id, accessed_time) after a batch (url, page_type_code, html_content, accessed_time), with the status of each URL that came.

    Statuses: inserted, updated, promoted (from a frontier entry), and for content that a smaller HTML page has,
    duplicate_content, updated_duplicate, promoted_duplicate; a duplicate's HTML is dropped and it points at that page.
    Of rows with one URL in a batch the latest counts, of those as late the greatest content.  Only the new URLs are numbered, in their order."""
    content = F.struct("page_type_code", "html_content", "accessed_time")
    came = batch.withColumn("url", without_fragment(F.col("url"))).where("url is not null").groupBy("url").agg(F.max_by(content, F.struct("accessed_time", "html_content", "page_type_code")).alias("n"))
    came = came.withColumn("__hash", F.sha2("n.html_content", 256))
    new = numbered(came.select("url").join(pages.select("url"), "url", "left_anti"), "__id", ["url"], _last(pages))
    both = pages.join(came, "url", "full_outer").join(new, "url", "left")
    both = both.withColumn("__new", F.col("id").isNull()).withColumn("__old_type", F.col("page_type_code"))
    both = both.withColumn("id", F.coalesce("id", "__id").cast(dict(pages.dtypes)["id"])).withColumn("__now_hash", F.coalesce("__hash", "content_hash"))
    html = (F.coalesce("n.page_type_code", "page_type_code") == "HTML") & F.col("duplicate_of_page_id").isNull()
    # contents meet as hashes of ids; only what that has found is joined to the texts, by id
    held = checkpointed(both.where(F.col("__now_hash").isNotNull()).select("id", F.col("__now_hash").alias("content_hash"), F.coalesce(html, F.lit(False)).alias("html"), F.col("__hash").isNotNull().alias("came")))
    first = held.where("html").groupBy("content_hash").agg(F.min("id").alias("__first"))
    found = looked_up(held.where("came").select("content_hash", "id"), first, "id").where(F.col("__first") < F.col("id")).select("id", "__first")
    out = both.join(found, "id", "left")
    has, dup = F.col("n").isNotNull(), F.col("__first").isNotNull()
    promoted = F.col("__old_type") == "FRONTIER"
    status = F.when(has & F.col("__new"), F.when(dup, "duplicate_content").otherwise("inserted")).when(has & promoted, F.when(dup, "promoted_duplicate").otherwise("promoted")).when(has, F.when(dup, "updated_duplicate").otherwise("updated"))
    return out.select(
        "id", "url", F.when(dup, "DUPLICATE").otherwise(F.coalesce("n.page_type_code", "page_type_code")).alias("page_type_code"), F.when(~dup, F.coalesce("n.html_content", "html_content")).alias("html_content"),
        F.col("__now_hash").alias("content_hash"), F.when(dup, F.col("__first")).when(~has, F.col("duplicate_of_page_id")).cast(dict(pages.dtypes)["duplicate_of_page_id"]).alias("duplicate_of_page_id"), F.coalesce("n.accessed_time", "accessed_time").alias("accessed_time"), status.alias("status"),
    )


def add_links(links: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """The set of edges after new ones (from_page, to_page); those of a duplicate attach to the page it points at; none from a page to itself."""
    target = pages.where("duplicate_of_page_id is not null").select(F.col("id").alias("__id"), F.col("duplicate_of_page_id").alias("__real"))
    moved = new.join(target, new["from_page"] == F.col("__id"), "left").select(F.coalesce("__real", "from_page").alias("from_page"), "to_page")
    return links.select("from_page", "to_page").union(moved.where("from_page <> to_page")).distinct()


def discovered(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Of found(source_url, url) the distinct normalised URLs other than the source, and whether a page has them (known)."""
    rows = found.select("source_url", without_fragment(F.col("url")).alias("url")).where("url is not null and url <> source_url").distinct()
    return rows.join(pages.select("url", F.lit(True).alias("known")).distinct(), "url", "left").select("source_url", "url", F.coalesce("known", F.lit(False)).alias("known"))


def upsert_page_data(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored (page_id, data_type_code, data) after new rows: added where absent, overwritten only by data; of several new rows the greatest data counts."""
    n = new.groupBy("page_id", "data_type_code").agg(F.max("data").alias("__d"))
    both = stored.join(n, ["page_id", "data_type_code"], "full_outer")
    return both.select("page_id", "data_type_code", F.coalesce("__d", "data").alias("data"))


def merge_candidates(rows: DataFrame) -> DataFrame:
    """Candidates (page_id, url, page_type_code, data_type_code, ord, discovered_in) by page and URL: BINARY beats FRONTIER, the first known document type stays, and where it was first found."""
    return rows.groupBy("page_id", "url").agg(F.min_by("discovered_in", "ord").alias("discovered_in"), F.when(F.max(F.col("page_type_code") == "BINARY"), "BINARY").otherwise("FRONTIER").alias("page_type_code"), F.min_by("data_type_code", F.when(F.col("data_type_code").isNotNull(), F.col("ord"))).alias("data_type_code"), F.min("ord").alias("ord"))


def upsert_setting(settings: DataFrame, new: DataFrame) -> DataFrame:
    """Settings (key, value, updated_at, updated_by), the latest row of each key; of those as late a new one, then the greatest value."""
    both = settings.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy("key").agg(F.max_by(F.struct("value", "updated_at", "updated_by"), F.struct("updated_at", "__new", "value", "updated_by")).alias("v")).select("key", "v.*")


def json_settings(settings: DataFrame, asked: DataFrame, fields: str, default: str) -> DataFrame:
    """Rows (key, setting) of the asked keys: the setting's value as a struct of the fields; the default, JSON too, where it is missing, blank, no JSON object, or of other types."""
    own = settings.groupBy("key").agg(F.max("value").alias("value"))
    rows = asked.select("key").distinct().join(own, "key", "left")
    return rows.select("key", documents.typed(F.col("value"), fields, documents.read_as(F.lit(default), fields)).alias("setting"))


def add_seeds(seeds: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Seeds and those new ones whose key is not there yet."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(*key, "__r.*") if rest else new.select(*key).distinct()
    return seeds.unionByName(first.join(seeds.select(*key), key, "left_anti"))


def discovered_images(pages: DataFrame, links: DataFrame, images: DataFrame, found: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Pages (id, url, page_type_code), links and images (page_id, filename, content_type, accessed_time) after images found(page_id, url).

    Their pages are BINARY: new ones come in, frontier entries are promoted; each page that shows one links to it, and has one image row per file name."""
    rows = found.select("page_id", without_fragment(F.col("url")).alias("url")).where("url is not null").distinct()
    came = rows.select("url").distinct()
    new = numbered(came.join(pages.select("url"), "url", "left_anti"), "id", ["url"], _last(pages)).select(F.col("id").cast(dict(pages.dtypes)["id"]).alias("id"), "url", F.lit("BINARY").alias("page_type_code"))
    shown = pages.join(came.withColumn("__came", F.lit(True)), "url", "left")
    promoted = F.when(F.col("__came") & (F.col("page_type_code") == "FRONTIER"), "BINARY").otherwise(F.col("page_type_code"))
    every = shown.select("id", "url", promoted.alias("page_type_code")).unionByName(new)
    edges = rows.join(every.select("url", F.col("id").alias("to_page")), "url").select(F.col("page_id").alias("from_page"), "to_page").where("from_page <> to_page")
    mime = image_content_type(F.col("url"))
    media = rows.groupBy("page_id", image_record_name(F.col("url")).alias("filename")).agg(F.min(mime).alias("content_type")).withColumn("accessed_time", now)
    fresh = media.join(images.select("page_id", "filename").distinct(), ["page_id", "filename"], "left_anti")
    return {"pages": every, "links": links.select("from_page", "to_page").union(edges).distinct(), "images": images.select("page_id", "filename", "content_type", "accessed_time").unionByName(fresh.select("page_id", "filename", "content_type", "accessed_time"))}


def ingest_candidates(found: DataFrame, now: Column) -> DataFrame:
    """Queue candidates of what ingested pages found(source_url, url, ord): priority 0, depth 1, the page as source."""
    return found.select("url", F.lit(0).alias("priority"), F.lit(1).alias("depth"), "source_url", now.alias("discovered_at"), "ord")


def update_site_policy(sites: DataFrame, results: DataFrame) -> DataFrame:
    """Sites (id, robots_content, sitemap_content) after results(id, robots_content, robots_sitemaps), one a site, with new_sitemaps.

    Blank robots texts and empty lists change nothing; the list's distinct URLs, in order, are kept a line each, and are new only if that text changes."""
    came = results.select("id", F.col("robots_content").alias("__r"), F.array_distinct(F.filter(F.transform("robots_sitemaps", lambda u: without_fragment(u)), lambda u: u.isNotNull())).alias("__s"))
    text = F.when(F.size("__s") > 0, F.array_join("__s", "\n"))
    changed = text.isNotNull() & ~text.eqNullSafe(F.col("sitemap_content"))
    robots = F.when(F.trim(F.coalesce("__r", F.lit(""))) != "", F.col("__r"))
    return sites.join(came, "id", "left").select("id", F.coalesce(robots, "robots_content").alias("robots_content"), F.coalesce(text, "sitemap_content").alias("sitemap_content"), F.when(F.coalesce(changed, F.lit(False)), F.col("__s")).otherwise(F.array().cast("array<string>")).alias("new_sitemaps"))
