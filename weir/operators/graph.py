"""Link graphs of pages and sites, roll-ups, neighbourhoods and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.functions import scoring
from weir.functions.url import host, registrable_domain
from weir.operators.numbering import checkpointed, numbered


def incoming_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("to_page").agg(F.count(F.lit(1)).alias("n"))


def degrees(links: DataFrame) -> DataFrame:
    """Of every page with a link: links in and out, and the score of its backlinks."""
    ends = links.select(F.explode(F.array(F.struct(F.col("from_page").alias("page"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to_page").alias("page"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.page").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))
    return sums.withColumn("backlink_score", F.round(scoring.backlink_score(F.col("n_in")), 6))


def site_edges(links: DataFrame) -> DataFrame:
    """Undirected links between different sites of links(from_site, to_site), with their number."""
    pair = links.where("from_site <> to_site").select(F.least("from_site", "to_site").alias("site_a"), F.greatest("from_site", "to_site").alias("site_b"))
    return pair.groupBy("site_a", "site_b").agg(F.count(F.lit(1)).alias("n"))


def backlinks(links: DataFrame) -> DataFrame:
    """Links that come to a site from others."""
    return links.where("from_site <> to_site and to_site > 0").groupBy(F.col("to_site").alias("site")).agg(F.count(F.lit(1)).alias("n"))


def outbound(links: DataFrame) -> DataFrame:
    """Links that go out from a site's pages, to itself too."""
    return links.where("from_site > 0").groupBy(F.col("from_site").alias("site")).agg(F.count(F.lit(1)).alias("n"))


def recent_links(links: DataFrame, limit: int) -> DataFrame:
    """The newest links, until they name ``limit`` different pages: a link counts if both its pages are among the first so many named."""
    order = [F.desc("newest"), F.col("from_page"), F.col("to_page")]
    rows = links.withColumn("newest", F.greatest("from_page", "to_page")).orderBy(*order).limit(max(8 * limit, 2000))
    rows = rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)))
    named = rows.select(F.explode(F.array(F.struct((2 * F.col("ord")).alias("k"), F.col("from_page").alias("page")), F.struct((2 * F.col("ord") + 1).alias("k"), F.col("to_page").alias("page")))).alias("p")).groupBy("p.page").agg(F.min("p.k").alias("k"))
    kept = named.orderBy("k").limit(limit).select("page")
    return rows.join(kept.withColumnRenamed("page", "from_page"), "from_page", "left_semi").join(kept.withColumnRenamed("page", "to_page"), "to_page", "left_semi").select("from_page", "to_page")


def newest_nodes(pages: DataFrame, limit: int) -> DataFrame:
    return pages.orderBy(F.desc("id")).limit(limit)


def page_graph(pages: DataFrame, links: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, url, domain, size, score) and links among them; without links, the newest pages."""
    edges = recent_links(links.join(pages.where("url is not null").select(F.col("id").alias("from_page")), "from_page", "left_semi").join(pages.where("url is not null").select(F.col("id").alias("to_page")), "to_page", "left_semi"), limit)
    ids = edges.select(F.explode(F.array("from_page", "to_page")).alias("id")).distinct()
    spare = newest_nodes(pages, limit).select("id").crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("m")))).where("m = 0").select("id")
    sizes = incoming_counts(links).select(F.col("to_page").alias("id"), "n")
    nodes = pages.join(ids.union(spare).distinct(), "id", "left_semi").join(sizes, "id", "left")
    domain = F.coalesce("domain", F.lit("unknown"))
    return nodes.select("id", "url", domain.alias("domain"), F.coalesce("n", F.lit(1)).alias("size"), F.round(scoring.graph_score(F.col("url"), domain), 6).alias("score")), edges


def site_nodes(pages: DataFrame) -> DataFrame:
    """Sites of pages (url, domain): pages, average and top graph score."""
    rows = pages.where("domain is not null").withColumn("s", scoring.graph_score(F.col("url"), F.col("domain")))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("s"), 6).alias("average"), F.round(F.max("s"), 6).alias("top"))


def roll_up(nodes: DataFrame, edges: DataFrame, key: Column, groups: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, score, queued) by key, the largest groups; undirected edge weights among those, the heaviest."""
    named = nodes.withColumn("key", F.coalesce(key, F.lit("unknown")))
    top = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("queued").alias("n_queued"), F.round(F.avg("score"), 6).alias("score")).orderBy(F.desc("n"), "key").limit(groups)
    ends = named.select("id", "key")
    pairs = edges.join(ends.withColumnsRenamed({"id": "from_page", "key": "a"}), "from_page").join(ends.withColumnsRenamed({"id": "to_page", "key": "b"}), "to_page").where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    keys = F.broadcast(top.select("key"))
    kept = pairs.join(keys.withColumnRenamed("key", "a"), "a", "left_semi").join(keys.withColumnRenamed("key", "b"), "b", "left_semi")
    return top, kept.select("a", "b", "weight").orderBy(F.desc("weight"), "a", "b").limit(most_edges)


def domain_roll_up(sites: DataFrame) -> DataFrame:
    """Site nodes by registrable domain: sites, pages, the pages' average score and the top."""
    rows = sites.withColumn("root", registrable_domain(F.col("domain")))
    return rows.groupBy("root").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("n_pages").alias("n_pages"), F.round(F.sum(F.col("average") * F.col("n_pages")) / F.sum("n_pages"), 6).alias("average"), F.max("top").alias("top"))


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """How many keys came and went between two snapshots."""
    a, b = old.select(*key).distinct().withColumn("o", F.lit(1)), new.select(*key).distinct().withColumn("w", F.lit(1))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("w").isNull()).alias("removed"))


def replay_frames(events: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frame at which each page of events(page, ts, id) first shows, and each link: as soon as both its pages have."""
    first = events.groupBy("page").agg(F.min(F.struct("ts", "id")).alias("at"))
    frames = numbered(first, "frame", ["at", "page"]).select("page", "frame")
    f = links.join(frames.withColumnsRenamed({"page": "from_page", "frame": "x"}), "from_page").join(frames.withColumnsRenamed({"page": "to_page", "frame": "y"}), "to_page")
    return frames, f.select("from_page", "to_page", F.greatest("x", "y").alias("frame"))


def neighbourhood(links: DataFrame, page: int, depth: int = 2) -> DataFrame:
    """Pages at most ``depth`` links from a page, either way, with their distance.

    Every step reads the links anew: they should be stored.  What has been seen is, so Spark knows its size and joins it accordingly."""
    seen = checkpointed(links.sparkSession.createDataFrame([(page, 0)], "page long, distance int"))
    for d in range(1, depth + 1):
        last = seen.where(F.col("distance") == d - 1).select("page")
        step = [links.join(last.withColumnRenamed("page", a), a, "left_semi").select(F.col(b).alias("page")) for a, b in (("from_page", "to_page"), ("to_page", "from_page"))]
        seen = checkpointed(seen.union(step[0].union(step[1]).distinct().withColumn("distance", F.lit(d))).groupBy("page").agg(F.min("distance").alias("distance")))
    return seen


def connected(nodes: DataFrame, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Each node's component, named by its smallest node; links to other nodes than those given don't count.

    In every round each node that still has links hooks to the least node next to it, jumps double until all name the root of their tree,
    and the links become links of roots: those within a tree, and repeated ones, go, and with them at least half of the nodes."""
    labels = checkpointed(nodes.select("id", F.col("id").alias("label")))
    both = links.where("from_page <> to_page").select(F.explode(F.array(F.struct(F.col("from_page").alias("a"), F.col("to_page").alias("b")), F.struct(F.col("to_page").alias("a"), F.col("from_page").alias("b")))).alias("p")).select("p.a", "p.b").distinct()
    for end in ("a", "b"):
        both = both.join(labels.select(F.col("id").alias(end)), end, "left_semi")
    both = checkpointed(both.select("a", "b"))
    for _ in range(most_rounds):
        roots = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumn("moved", F.lit(True)))
        if roots.isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        while not roots.where("moved").isEmpty():
            up = roots.select(F.col("a").alias("l"), F.col("l").alias("up"))
            roots = checkpointed(roots.join(up, "l").select("a", F.col("up").alias("l"), (F.col("up") != F.col("l")).alias("moved")))
        roots = roots.select("a", "l")
        labels = checkpointed(labels.join(roots.withColumnsRenamed({"a": "label", "l": "root"}), "label", "left").select("id", F.coalesce("root", "label").alias("label")))
        ends = both.join(roots.withColumnRenamed("l", "x"), "a").join(roots.withColumnsRenamed({"a": "b", "l": "y"}), "b")
        both = checkpointed(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    raise RuntimeError("components did not settle")


def seed_nodes(nodes: DataFrame, keywords: list[str], total: int) -> DataFrame:
    """Up to eight nodes that a keyword names, if there are three; else the largest, by the graph's size."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.lower(F.concat_ws(" ", "url", "domain")), F.lit(k.lower()))
    largest = [F.desc("size"), F.col("id")]
    named = nodes.where(hit).orderBy(*largest).limit(8)
    few = named.agg((F.count(F.lit(1)) < 3).alias("few"))
    most = min(8, max(3, total // 40 + 2))
    every = nodes.orderBy(*largest).limit(most).crossJoin(F.broadcast(few)).where("few").drop("few")
    return named.crossJoin(F.broadcast(few)).where("not few").drop("few").unionByName(every)


def replay_seeds(nodes: DataFrame, take: int = 12) -> DataFrame:
    """The nodes a replay begins with: the largest, then by id."""
    return nodes.orderBy(F.desc("size"), "id").limit(take)


def frontier_candidates(nodes: DataFrame, take: int) -> DataFrame:
    """Nodes (id, score, size, queued) shown as next to be crawled: queued ones, or all if none is; the best by score and a twentieth of their size."""
    any_queued = nodes.agg(F.coalesce(F.max("queued"), F.lit(False)).alias("__any"))
    pool = nodes.crossJoin(F.broadcast(any_queued)).where(F.col("queued") | ~F.col("__any")).drop("__any")
    return pool.orderBy(F.desc(F.coalesce("score", F.lit(0.0)) + F.coalesce("size", F.lit(0)) * 0.05), "id").limit(max(0, take))


def visible_subset(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, size, in_view) shown, the largest in view and then the largest of the rest, and the edges among them."""
    shown = nodes.orderBy(F.desc("in_view"), F.desc("size"), "id").limit(limit)
    ids = F.broadcast(shown.select("id"))
    kept = edges.join(ids.withColumnRenamed("id", "from_page"), "from_page", "left_semi").join(ids.withColumnRenamed("id", "to_page"), "to_page", "left_semi")
    return shown, kept


def focused_node(nodes: DataFrame, term: str) -> DataFrame:
    """The first node (by id) whose URL or domain has the term, whatever the case; none for an empty term."""
    t = (term or "").lower()
    hit = F.contains(F.lower(F.coalesce("url", F.lit(""))), F.lit(t)) | F.contains(F.lower(F.coalesce("domain", F.lit(""))), F.lit(t))
    return nodes.where(hit if t else F.lit(False)).orderBy("id").limit(1)


def scaled_nodes(nodes: DataFrame) -> DataFrame:
    """Site nodes (n_pages, average) with a radius of 12 to 44 by the square root of their pages, and their place between the least and the greatest score, 0 to 1."""
    ext = nodes.agg(F.least(F.lit(1), F.coalesce(F.min("n_pages"), F.lit(1))).alias("__p0"), F.greatest(F.lit(1), F.coalesce(F.max("n_pages"), F.lit(1))).alias("__p1"), F.least(F.lit(0.0), F.coalesce(F.min("average"), F.lit(0.0))).alias("__s0"), F.greatest(F.lit(1.0), F.coalesce(F.max("average"), F.lit(1.0))).alias("__s1"))
    share = (F.sqrt("n_pages") - F.sqrt("__p0")) / (F.sqrt("__p1") - F.sqrt("__p0"))
    radius = F.when(F.col("__p0") == F.col("__p1"), 28.0).otherwise(12 + 32 * share)
    return nodes.crossJoin(F.broadcast(ext)).select(*nodes.columns, F.round(radius, 6).alias("radius"), F.round((F.col("average") - F.col("__s0")) / (F.col("__s1") - F.col("__s0")), 6).alias("shade"))


def scaled_edges(edges: DataFrame) -> DataFrame:
    """Edges (weight) with a width of 1.2 to 5.4 by the square root of their weight."""
    most = edges.agg(F.greatest(F.lit(1), F.coalesce(F.max("weight"), F.lit(1))).alias("__m"))
    width = F.when(F.col("__m") == 1, 3.3).otherwise(1.2 + 4.2 * (F.sqrt("weight") - 1) / (F.sqrt("__m") - 1))
    return edges.crossJoin(F.broadcast(most)).select(*edges.columns, F.round(width, 6).alias("width"))


def group_key(url: Column, domain: Column, level: str) -> Column:
    """``domain:`` and the registrable domain, or ``subdomain:`` and the host, of a node's URL or else its domain; ``unknown`` for neither."""
    name = F.coalesce(F.nullif(host(F.coalesce(url, F.lit(""))), F.lit("")), F.lower(F.coalesce(domain, F.lit(""))))
    return F.concat(F.lit("domain:"), registrable_domain(name)) if level == "domain" else F.concat(F.lit("subdomain:"), F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")))


def url_index(nodes: DataFrame, variants: Column) -> DataFrame:
    """Keys (key, id) under which nodes (id, url) are found: of several nodes with a key the first by id."""
    return nodes.select("id", F.explode(variants).alias("key")).groupBy("key").agg(F.min("id").alias("id"))
