"""Queries of the column functions, each with its SQL.  Importing it adds them to the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import hashing, robots, scoring, telemetry
from weir.functions import html as H
from weir.functions import url as U
from weir.plans import pipelines
from weir.plans.crawl_queries import QUERIES, SQL
from weir.plans.queries import now, query
from weir.sources.fixtures import base, view

__all__ = ["QUERIES", "SQL"]


@query("""SELECT id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, 'crawler|' || site_key AS crawler_key, site_key AS plain, CASE WHEN length(long) > 128 THEN left(long, 90) || '...' || right(long, 34) ELSE long END AS compact, 'https://' || site_key AS site_url,
 CASE WHEN length(long) <= 255 THEN long ELSE left(long, 242) || '-' || left(sha256(long), 12) END AS record FROM (SELECT *, url || '?' || repeat('q', CAST(id % 300 AS INT)) AS long FROM v_frontier)""")
def url_parts(spark, d):
    rows = view(spark, d, "v_frontier").withColumn("long", F.concat("url", F.lit("?"), F.expr("repeat('q', CAST(id % 300 AS INT))")))
    return rows.select("id", U.origin(F.col("url")).alias("origin"), U.crawler_site_key(F.lit("crawler"), F.col("site_key")).alias("crawler_key"), U.normal_host(F.concat(F.lit(" "), F.upper("site_key"), F.lit("."))).alias("plain"), U.compact(F.col("long")).alias("compact"), U.external_site_url(F.col("site_key")).alias("site_url"), U.image_record_name(F.col("long")).alias("record"))


@query("""WITH h AS (SELECT event_id AS id, CASE WHEN event_type = 'view' THEN '::ffff:' || ip WHEN event_type = 'click' THEN '[::FFFF:' || ip || ']' WHEN event_type = 'error' THEN ' ' || ip WHEN event_type = 'signup' THEN upper(event_type) || '-' || CAST(user_id AS VARCHAR) || '.Example.ORG' ELSE '::' || CAST(user_id AS VARCHAR) END AS host
  FROM (SELECT *, CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 251 AS VARCHAR) || '.' || CAST(event_id % 7 AS VARCHAR) || '.' || CAST(CAST(floor(value) AS BIGINT) % 256 AS VARCHAR) AS ip FROM events))
SELECT id, coalesce(nullif(regexp_extract(plain, 'ffff:([0-9.]+)$', 1), ''), plain) AS ip_key FROM (SELECT id, regexp_replace(lower(trim(host)), '^\\[|\\]$', '', 'g') AS plain FROM h)""")
def ip_keys(spark, d):
    text = lambda c: c.cast("string")
    kind, user, event = F.col("event_type"), F.col("user_id"), F.col("event_id")
    ip = F.concat_ws(".", text(user % 256), text(event % 251), text(event % 7), text(F.floor("value") % 256))
    host = F.when(kind == "view", F.concat(F.lit("::ffff:"), ip)).when(kind == "click", F.concat(F.lit("[::FFFF:"), ip, F.lit("]"))).when(kind == "error", F.concat(F.lit(" "), ip))
    host = host.when(kind == "signup", F.concat(F.upper(kind), F.lit("-"), text(user), F.lit(".Example.ORG"))).otherwise(F.concat(F.lit("::"), text(user)))
    return base(spark, d, "events").select(event.alias("id"), U.normal_ip(host).alias("ip_key"))


#: Headers of responses, made of what pages say of themselves: their language, and their links' last segments as file names.
_RESPONSE = """r AS (SELECT page_id, url, html, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<a href="/([^"]*)"', 1) AS name FROM pages),
 q AS (SELECT page_id, url, html, CASE lang WHEN 'en' THEN 'Text/HTML; charset=' || lang WHEN 'fr' THEN ' Application/PDF ;q=1' WHEN 'de' THEN '' END AS header, CASE WHEN length(name) % 2 = 0 THEN 'attachment; filename="' || name || '.DOCX"' ELSE 'inline; filename*=UTF-8''''' || name || '.pptx' END AS offer,
  CASE WHEN length(name) % 3 = 0 THEN '/dl?file=' || name || '.ppt' WHEN length(name) % 3 = 1 THEN '/' || lang || '/' ELSE '/page' END AS tail FROM r)"""


@query(f"""WITH {_RESPONSE}, m AS (SELECT *, lower(trim(string_split(header, ';')[1])) AS media, lower(regexp_extract(offer, '(?i)\\.(docx|pptx)"?$', 1)) AS ext FROM q)
SELECT page_id AS id, media, CASE WHEN media = 'text/html' THEN true WHEN media <> '' THEN false WHEN tail LIKE '%/' THEN true ELSE starts_with(lower(left(ltrim(html), 64)), '<!doctype html') END AS html,
 CASE WHEN media = 'application/pdf' THEN 'PDF' WHEN contains(tail, '.ppt') THEN 'PPT' ELSE upper(ext) END AS kind FROM m""")
def media_types(spark, d):
    lang, name = F.regexp_extract("html", '<html lang="([^"]*)"', 1), F.regexp_extract("html", '<a href="/([^"]*)"', 1)
    header = F.when(lang == "en", F.concat(F.lit("Text/HTML; charset="), lang)).when(lang == "fr", " Application/PDF ;q=1").when(lang == "de", "")
    offer = F.when(F.length(name) % 2 == 0, F.concat(F.lit('attachment; filename="'), name, F.lit('.DOCX"'))).otherwise(F.concat(F.lit("inline; filename*=UTF-8''"), name, F.lit(".pptx")))
    tail = F.when(F.length(name) % 3 == 0, F.concat(F.lit("/dl?file="), name, F.lit(".ppt"))).when(F.length(name) % 3 == 1, F.concat(F.lit("/"), lang, F.lit("/"))).otherwise("/page")
    rows = base(spark, d, "pages").withColumn("at", F.concat(F.lit("https://x.example.org"), tail))
    return rows.select(F.col("page_id").alias("id"), U.content_type(header).alias("media"), U.is_html(F.col("at"), header, F.col("html")).alias("html"), U.document_type_of_response(F.col("at"), header, offer).alias("kind"))


_BYTES = "b AS (SELECT doc_id, lang, CASE length(text) % 8 WHEN 0 THEN '89504E470D0A1A0A' WHEN 1 THEN 'FFD8FF' WHEN 2 THEN '474946383961' WHEN 3 THEN '52494646' || hex(left(source, 4)) || '57454250' WHEN 4 THEN '255044462D' WHEN 5 THEN '52494646' WHEN 6 THEN '474946383861' ELSE '' END || hex(left(text, 12)) AS h FROM documents)"
_SNIFFED = "CASE WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN regexp_matches(h, '^47494638(37|39)61') THEN 'image/gif' WHEN starts_with(h, '52494646') AND substring(h, 17, 8) = '57454250' THEN 'image/webp' WHEN starts_with(h, '255044462D') THEN 'application/pdf' ELSE {} END"


def _bytes(spark, d):
    """Documents' first bytes behind those of some format, or something like it, by the length of the text."""
    n = F.length("text") % 8
    first = F.when(n == 0, "89504E470D0A1A0A").when(n == 1, "FFD8FF").when(n == 2, "474946383961").when(n == 3, F.concat(F.lit("52494646"), F.hex(F.left("source", F.lit(4))), F.lit("57454250"))).when(n == 4, "255044462D").when(n == 5, "52494646").when(n == 6, "474946383861").otherwise("")
    return base(spark, d, "documents").select("doc_id", "lang", F.unhex(F.concat(first, F.hex(F.left("text", F.lit(12))))).alias("data"))


@query(f"WITH {_BYTES} SELECT doc_id, " + _SNIFFED.format("'text/' || lang") + " AS media FROM b")
def sniffed_types(spark, d):
    return _bytes(spark, d).select("doc_id", U.sniffed_type(F.col("data"), F.concat(F.lit("text/"), "lang")).alias("media"))


@query(f"WITH {_BYTES}, m AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'fr' THEN 'application/vnd.ms-powerpoint' ELSE " + _SNIFFED.format("'application/octet-stream'") + """ END AS media FROM b)
SELECT doc_id, media, CASE media WHEN 'image/png' THEN '.png' WHEN 'image/jpeg' THEN '.jpg' WHEN 'image/gif' THEN '.gif' WHEN 'image/webp' THEN '.webp' WHEN 'application/pdf' THEN '.pdf' WHEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' THEN '.docx' WHEN 'application/vnd.ms-powerpoint' THEN '.ppt' ELSE '.bin' END AS extension FROM m""")
def stored_types(spark, d):
    """Media types and extensions of stored data, some of which has a type's code."""
    code = F.when(F.col("lang") == "de", " docx").when(F.col("lang") == "fr", "PPT ").otherwise(F.col("lang"))
    media = U.stored_content_type(code, F.col("data"))
    return _bytes(spark, d).select("doc_id", media.alias("media"), U.file_extension(F.upper(media)).alias("extension"))


@query("""SELECT ord, url || CASE WHEN ord % 3 = 0 THEN '.' || t ELSE '' END AS url, CASE WHEN ord % 3 = 0 THEN CASE lower(t) WHEN 'jpeg' THEN 'image/jpeg' WHEN 'svg' THEN 'image/svg+xml' WHEN 'ico' THEN 'image/x-icon' WHEN 'tif' THEN 'image/tiff' WHEN 'avif' THEN 'image/avif' END END AS media
 FROM (SELECT ord, url, CASE depth WHEN 0 THEN 'JPEG' WHEN 1 THEN 'svg' WHEN 2 THEN 'Ico' WHEN 3 THEN 'tif' WHEN 4 THEN 'avif' ELSE 'pdf' END AS t FROM v_found)""")
def image_media_types(spark, d):
    """Media types of images by their URLs."""
    ends = F.get(F.array(*[F.lit(x) for x in ("JPEG", "svg", "Ico", "tif", "avif", "pdf")]), F.col("depth"))
    url = F.concat("url", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("."), ends)).otherwise(""))
    return view(spark, d, "v_found").select("ord", url.alias("url")).select("ord", "url", U.image_content_type(F.concat("url", F.lit("?x=.png#y"))).alias("media"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), k AS (SELECT page_id, CASE length(href) % 5 WHEN 0 THEN '#' || href WHEN 1 THEN ' MailTo:' || href WHEN 2 THEN 'https://x.org' || href || '/download' ELSE href END AS href FROM a)
SELECT page_id, href, NOT regexp_matches(lower(trim(href)), '^(#|javascript:|mailto:|tel:)') AND trim(href) <> '' AS crawlable, regexp_matches(lower(href), 'pdf|doc|docx|ppt|pptx|download|attachment|file|document') AS likely FROM k""")
def link_kinds(spark, d):
    rows = base(spark, d, "pages").select("page_id", F.explode(H.anchor_hrefs(F.col("html"))).alias("href"))
    n = F.length("href") % 5
    href = F.when(n == 0, F.concat(F.lit("#"), "href")).when(n == 1, F.concat(F.lit(" MailTo:"), "href")).when(n == 2, F.concat(F.lit("https://x.org"), "href", F.lit("/download"))).otherwise(F.col("href"))
    return rows.select("page_id", href.alias("href")).select("page_id", "href", U.crawlable(F.col("href")).alias("crawlable"), U.likely_document(F.col("href")).alias("likely"))


@query("""SELECT page_id, array_to_string(list_filter(l, lambda u: u <> '' AND NOT starts_with(u, '#')), ',') AS urls FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^",]*)"', 1), lambda h: CASE WHEN length(h) % 4 = 0 THEN '#' || h ELSE h || '.png' END) AS l FROM pages)""")
def srcset_entries(spark, d):
    """A page's links as the entries of a set, with their densities and some blanks."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^",]*)"'), F.lit(1))
    entries = F.transform(hrefs, lambda h: F.when(F.length(h) % 4 == 0, F.concat(F.lit("#"), h, F.lit(" 3x"))).when(F.length(h) % 4 == 1, F.concat(h, F.lit(".png"))).otherwise(F.concat(F.lit("  "), h, F.lit(".png   2x "))))
    return base(spark, d, "pages").select("page_id", F.array_join(U.srcset_urls(F.array_join(entries, ",")), ",").alias("urls"))


_FAMILIES = " ".join("WHEN {} THEN '{}'".format(" OR ".join(f"contains(lower(url) || ' ' || domain, '{w}')" for w in words), name) for name, words in scoring.TOPIC_FAMILIES)
_GENERIC = ", ".join(f"'{x}'" for x in scoring.GENERIC_LABELS)


@query(f"""SELECT id, coalesce(CASE {_FAMILIES} END, list_filter(string_split(regexp_replace(domain, '^www\\.', ''), '.'), lambda p: length(p) >= 3 AND p NOT IN ({_GENERIC}))[1],
 list_filter(string_split(regexp_replace(lower(url), '^https?://', ''), '/')[2:], lambda p: length(trim(p)) >= 4)[1], 'generic') AS topic FROM v_page""")
def page_topics(spark, d):
    return view(spark, d, "v_page").select("id", scoring.topic(F.col("url"), F.col("domain")).alias("topic"))


@query("SELECT DISTINCT sale_id, total, round(CASE WHEN x IS NULL THEN 0.0 WHEN x <= 1 THEN greatest(0.0::DOUBLE, x) ELSE least(1.0::DOUBLE, (exp(x / 4) - 1) / (exp(x / 4) + 1)) END, 6) AS relevance FROM (SELECT sale_id, total, total / 20.0::DOUBLE - 2 AS x FROM sales)")
def normal_relevance(spark, d):
    return base(spark, d, "sales").select("sale_id", "total", F.round(scoring.normal_relevance(F.col("total") / 20 - 2), 6).alias("relevance")).distinct()


#: A host's rules: its pages with the smallest and the greatest path are closed, as is all below them, and it has a delay by the number of its pages.
_RULES = "p AS (SELECT id, url, domain, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM v_page), r AS (SELECT domain, min(path) AS low, max(path) AS high, count(*) AS n FROM p WHERE length(path) > 1 GROUP BY domain)"


def _rules(spark, d):
    """Pages with their host's smallest and greatest path, and the number of its pages."""
    p = view(spark, d, "v_page").select("id", "url", "domain", U.path_of(F.col("url")).alias("path"))
    r = p.where("length(path) > 1").groupBy("domain").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count(F.lit(1)).alias("n"))
    return p.join(r, "domain", "left")


@query(f"WITH {_RULES} SELECT id, n IS NULL OR NOT (starts_with(path, low) OR starts_with(path, high)) AS allowed, CAST(n % 9 AS DOUBLE) AS crawl_delay, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS n_sitemaps FROM p LEFT JOIN r USING (domain)")
def robots_policies(spark, d):
    content = F.concat(F.lit("User-agent: weir\nDisallow: "), "low", F.lit("\nDisallow: "), "high", F.lit("\nCrawl-delay: "), (F.col("n") % 9).cast("string"), F.lit("\n\nUser-agent: *\nDisallow: /\nSitemap: https://"), "domain", F.lit("/s.xml"))
    rows = _rules(spark, d).select("id", robots.robots_policy(content, F.lit("weir"), F.col("url")).alias("p"))
    return rows.select("id", "p.allowed", "p.crawl_delay", F.size("p.sitemaps").alias("n_sitemaps"))


@query("""SELECT sale_id, max(greatest(5.0::DOUBLE, amount / 300.0::DOUBLE, discount * 100, CAST(quantity AS DOUBLE))) AS delay, max(CAST(greatest(CAST(quantity AS BIGINT) * 150, 5000, CAST(ceil(greatest(coalesce(amount / 300.0::DOUBLE, 0.0), coalesce(discount * 100, 0.0)) * 1000) AS BIGINT)) AS BIGINT)) AS cooldown_ms FROM sale_lines GROUP BY sale_id""")
def politeness_delays(spark, d):
    """The longest delay and cooldown that the lines of a sale ask for."""
    configured, robots_s, rate = F.col("amount") / 300, F.col("discount") * 100, F.col("quantity").cast("double")
    delay = robots.effective_delay(F.lit(5.0), configured, robots_s, rate)
    cooldown = robots.observed_cooldown_ms(F.col("quantity").cast("long") * 150, configured, robots_s).cast("long")
    return base(spark, d, "sale_lines").groupBy("sale_id").agg(F.max(delay).alias("delay"), F.max(cooldown).alias("cooldown_ms"))


@query("SELECT id, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS preview FROM (SELECT id, array_to_string(string_split(x, chr(10))[1:2], chr(10)) AS t FROM (SELECT id, message || chr(10) || repeat('a', CAST(id % 60 AS INT)) || chr(10) || 'third' AS x FROM v_log))")
def text_previews(spark, d):
    text = F.concat("message", F.lit("\n"), F.expr("repeat('a', CAST(id % 60 AS INT))"), F.lit("\r\nthird"))
    return view(spark, d, "v_log").select("id", robots.preview(text, 2, 40).alias("preview"))


@query("""SELECT ord, array_to_string(list_sort(list_distinct(regexp_extract_all(source_url || chr(10) || url || ' seen ' || CAST(found_at AS VARCHAR) || ' <' || source_url || '>', 'https?://[^\\s<>"]+'))), ',') AS urls FROM v_found""")
def stored_sitemaps(spark, d):
    text = F.concat("source_url", F.lit("\n"), "url", F.lit(" seen "), F.col("found_at").cast("string"), F.lit(" <"), "source_url", F.lit(">"))
    return view(spark, d, "v_found").select("ord", F.array_join(robots.sitemap_urls(text), ",").alias("urls"))


_SHOWN = "CASE WHEN worker_id % 2 = 0 THEN json_extract_string(payload, '$.previousStatus') || ' -> ' || json_extract_string(payload, '$.status') ELSE 'Status=' || json_extract_string(payload, '$.status') END || ' | worker=' || CAST(worker_id AS VARCHAR) || ' '"


@query(f"""WITH t AS (SELECT id, {_SHOWN} AS text FROM v_event WHERE type = 'status-change')
SELECT id, coalesce(nullif(regexp_extract(text, '(\\w+)\\s*->', 1), ''), nullif(regexp_extract(text, '(?i)status=([^|,;\\s]+)', 1), '')) AS "from", coalesce(nullif(regexp_extract(text, '->\\s*(\\w+)', 1), ''), nullif(regexp_extract(text, '(?i)status=([^|,;\\s]+)', 1), '')) AS "to", trim(string_split(text, '|')[2]) AS details FROM t""")
def rendered_transitions(spark, d):
    at = lambda name: telemetry.field(F.col("payload"), name)
    text = F.concat(F.when(F.col("worker_id") % 2 == 0, F.concat(at("previousStatus"), F.lit(" -> "), at("status"))).otherwise(F.concat(F.lit("Status="), at("status"))), F.lit(" | worker="), F.col("worker_id").cast("string"), F.lit(" "))
    return view(spark, d, "v_event").where("type = 'status-change'").select("id", telemetry.transition_of(text).alias("t")).select("id", "t.*")


@query("""SELECT id, CASE WHEN type = 'error' THEN nullif(regexp_extract(said, 'url=([^ |,]+)', 1), '') ELSE json_extract_string(payload, '$.url') END AS url FROM (SELECT *, replace(json_extract_string(payload, '$.message'), 'for ', 'url=https://e.example.org/') AS said FROM v_event)""")
def replay_urls(spark, d):
    """The URL of each event, which one in three has under another name, and errors only say."""
    p = F.regexp_replace("payload", "failed for (\\d+)", "failed Url=https://e.example.org/$1 | later")
    named = F.when(F.col("id") % 3 == 0, F.regexp_replace(p, '"url":', '"finalUrl":')).when(F.col("id") % 3 == 1, F.regexp_replace(p, '"url":("[^"]*")', '"downloadResult":{"requestedUrl":$1}')).otherwise(p)
    return view(spark, d, "v_event").select("id", telemetry.replay_url(named).alias("url"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS digest FROM documents")
def decoded_bodies(spark, d):
    rows = base(spark, d, "documents")
    sent = F.when(F.col("doc_id") % 3 == 0, "no base64!").otherwise(F.base64(F.col("text").cast("binary")))
    return rows.select(F.col("doc_id").alias("id"), F.sha2(hashing.decoded_base64(sent), 256).alias("digest"))


@query("""SELECT sale_id, status, CASE WHEN s IN ('completed', 'complete', 'done', 'success') THEN 'COMPLETED' WHEN s IN ('failed', 'fail', 'error') THEN 'FAILED' WHEN s IN ('duplicate', 'dup') THEN 'DUPLICATE' WHEN s IN ('queued', 'queue', 'retry', 'requeue') THEN 'QUEUED' ELSE 'COMPLETED' END AS state
 FROM (SELECT sale_id, status, lower(trim(CASE WHEN status = 'held' THEN ' Re' || CASE WHEN priority % 2 = 0 THEN 'try' ELSE 'QUEUE' END WHEN status = 'open' THEN CASE WHEN total > 50 THEN 'ERROR ' ELSE 'Dup' END ELSE status END)) AS s FROM (SELECT DISTINCT sale_id, status, priority, total FROM sales))""")
def terminal_states(spark, d):
    said = F.when(F.col("status") == "held", F.concat(F.lit(" Re"), F.when(F.col("priority") % 2 == 0, "try").otherwise("QUEUE"))).when(F.col("status") == "open", F.when(F.col("total") > 50, "ERROR ").otherwise("Dup")).otherwise(F.col("status"))
    return base(spark, d, "sales").select("sale_id", "status", "priority", "total").distinct().select("sale_id", "status", telemetry.terminal_state(said).alias("state"))


@query("SELECT page_id AS id, regexp_replace(url, '^([^?#]*).*$', '\\1') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(list_sort(k), '&') ELSE '' END AS url FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|igshid|mc_cid|mc_eid|ref|ref_src)(=|$)')) AS k FROM pages)")
def untracked_urls(spark, d):
    return base(spark, d, "pages").select(F.col("page_id").alias("id"), U.without_tracking(F.col("url")).alias("url"))


# --- stored HTML --------------------------------------------------------------------------------------------------------

@query("""SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) || CASE WHEN len(k) > 0 THEN '?' || array_to_string(list_sort(k), '&') ELSE '' END AS url
 FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|igshid|mc_cid|mc_eid|ref|ref_src)(=|$)')) AS k FROM pages)""")
def canonicalize_full(spark, d):
    return base(spark, d, "pages").select("page_id", U.canonicalize(F.col("url")).alias("url"))


#: A page's anchors as canonical links, each once, in order: the pages' own links are single path segments.
_LINKS = "list_transform(regexp_extract_all({html}, '<a href=\"/([^\"]*)\"', 1), lambda p: lower(regexp_extract({url}, '^(https?://[^/?#]+)', 1)) || '/' || replace(url_encode(p), '%2C', ','))"


@query(f"SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS links, 0 AS n_images, 0 AS n_js_links FROM (SELECT page_id, {_LINKS.format(html='html', url='url')} AS l FROM pages)")
def html_assets(spark, d):
    rows = base(spark, d, "pages").select("page_id", H.page_assets(F.col("html"), F.col("url")).alias("a"))
    return rows.select("page_id", F.array_join("a.links", " ").alias("links"), F.size("a.images").alias("n_images"), F.size("a.js_links").alias("n_js_links"))


_FOUND = f"hl AS (SELECT id AS page_id, url AS source_url, {_LINKS.format(html='html_content', url='url')} AS l FROM v_page WHERE page_type_code = 'HTML'), hd AS (SELECT page_id, source_url, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)) AS url, unnest(range(0, len(list_filter(l, lambda x, i: list_position(l, x) = i)))) AS ord FROM hl)"


@query(f"WITH {_FOUND} SELECT page_id, source_url, url, 'FRONTIER' AS page_type_code, 'link' AS discovered_in, CAST(ord AS INT) AS ord FROM hd WHERE url <> source_url")
def reparse_links(spark, d):
    return pipelines.candidates(view(spark, d, "v_page")).select("page_id", "source_url", "url", "page_type_code", "discovered_in", "ord")


@query(f"""WITH {_FOUND}, n AS (SELECT DISTINCT url FROM hd WHERE url NOT IN (SELECT url FROM v_page))
SELECT (SELECT count(*) FROM v_page) + (SELECT count(*) FROM n) AS pages, (SELECT count(*) FROM n) AS inserted, CAST(0 AS BIGINT) AS promoted, (SELECT count(*) FROM v_link) + (SELECT count(*) FROM (SELECT DISTINCT page_id, url FROM hd)) AS edges, CAST(0 AS BIGINT) AS documents""")
def reparse_summary(spark, d):
    pages = view(spark, d, "v_page")
    queue = view(spark, d, "v_frontier").withColumn("source_url", F.lit(None).cast("string"))
    return pipelines.reparse_counts(pages, pipelines.reparse(pages, view(spark, d, "v_link"), queue, now()))


# --- settings -----------------------------------------------------------------------------------------------------------

@query("""SELECT ord, round(CAST(CASE WHEN regexp_extract(source_url, '^https?://([^/:?#]+)', 1) = h THEN 7 ELSE 0 END + CASE WHEN h = 'example.org' OR h LIKE '%.example.org' THEN 11 ELSE 0 END + CASE WHEN contains(p, 'clinic') THEN 3 ELSE 0 END + CASE WHEN contains(p, 'img') THEN 3 ELSE 0 END - 0.5 * depth AS DOUBLE), 6) AS score
 FROM (SELECT *, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS h, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM v_found)""")
def configured_scores(spark, d):
    config = {"topicKeywordsText": "clinic; Clinic,\nimg", "seedEntries": [{"url": "https://example.org/x"}, {"url": "https://off.example/", "enabled": False}], "relevanceSameHostBoost": 7, "relevanceAllowedSuffixBoost": 11, "relevanceKeywordBoost": 3, "relevanceDepthPenalty": 0.5}
    policy = scoring.Policy.from_config(config)
    return view(spark, d, "v_found").select("ord", F.round(scoring.crawler_score(F.col("url"), F.col("source_url"), F.col("depth"), policy), 6).alias("score"))
