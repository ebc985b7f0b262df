"""Ingest requests as a stream of JSON bodies: those that keep to the schema go to one table, all others, with the reason, to a dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import documents
from weir.functions.url import without_fragment

DOWNLOAD = (
    "requestedUrl string, finalUrl string, statusCode int, contentType string, dataTypeCode string, binaryContentBase64 string, pageTypeCode string, htmlContent string, usedRenderer boolean, contentLength int, "
    "robotsAllowed boolean, robotsUrl string, robotsFetched boolean, robotsCrawlDelaySeconds double, robotsSitemaps array<string>, robotsContent string, effectiveDelaySeconds double"
)
REQUEST = f"rawUrl string, daemonId string, siteId int, sourcePageId int, discoveredUrls array<string>, discoveredImageUrls array<string>, downloadResult struct<{DOWNLOAD}>"


def judged(bodies: DataFrame, schema: str, complete: Column | None = None) -> DataFrame:
    """Rows of bodies (body, …) with ``request``, the body as a struct of the schema, and ``reason``, null for those accepted.

    Reasons: empty; malformed, which is no JSON; not-an-object; wrong-type, where a property isn't what the schema says; incomplete, where
    ``complete``, a condition on the request, doesn't hold.  Properties that the schema doesn't name are ignored."""
    doc = documents.document(F.col("body"))
    rows = bodies.withColumn("__doc", doc).withColumn("__own", documents.properties(F.col("__doc")).isNotNull())
    rows = rows.withColumn("request", documents.read_as(F.col("body"), schema))
    reason = F.when(F.trim(F.coalesce("body", F.lit(""))) == "", "empty").when(F.col("__doc").isNull(), "malformed").when(~F.col("__own"), "not-an-object").when(F.col("request").isNull(), "wrong-type")
    if complete is not None:
        reason = reason.when(~F.coalesce(complete, F.lit(False)), "incomplete")
    return rows.withColumn("reason", reason).withColumn("request", F.when(F.col("reason").isNull(), F.col("request"))).drop("__doc", "__own")


def page_url() -> Column:
    """The page that a request is about: the URL it ended at, else the one it asked for."""
    clean = lambda c: F.nullif(F.trim(without_fragment(F.col(c))), F.lit(""))
    return F.coalesce(clean("request.downloadResult.finalUrl"), clean("request.rawUrl"))


def ingest_requests(bodies: DataFrame) -> DataFrame:
    """judged() for ingest requests, which have to name a URL."""
    return judged(bodies, REQUEST, page_url().isNotNull())


def page_kind() -> Column:
    """The type that a request gives its page, HTML unless it says another."""
    return F.coalesce(F.upper(F.nullif(F.trim("request.downloadResult.pageTypeCode"), F.lit(""))), F.lit("HTML"))


def page_batch(requests: DataFrame) -> DataFrame:
    """Accepted requests (request, received_at, …) as a batch for upsert_pages(): url, page_type_code, html_content, accessed_time."""
    return requests.select(page_url().alias("url"), page_kind().alias("page_type_code"), F.col("request.downloadResult.htmlContent").alias("html_content"), F.col("received_at").alias("accessed_time"))


def stored(requests: DataFrame, out: str, checkpoint: str):
    """Starts a query that keeps each batch's accepted requests below out/accepted and the others, as they came, below out/dead_letter.

    A batch that is run again writes its own folders again."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("reason IS NULL").drop("reason", "body").write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        batch.where("reason IS NOT NULL").drop("request").write.mode("overwrite").parquet(f"{out}/dead_letter/batch={number}")
        batch.unpersist()

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
