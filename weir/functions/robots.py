"""robots.txt and politeness."""

from __future__ import annotations

from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_DELAY_MS = 5000


def _policy(content: str | None, agent: str, url: str) -> dict:
    if content is None:
        return {"allowed": True, "crawl_delay": None, "sitemaps": []}
    parser = RobotFileParser()
    parser.parse(content.splitlines())
    delay = parser.crawl_delay(agent)
    delay = parser.crawl_delay("*") if delay is None else delay
    return {"allowed": parser.can_fetch(agent, url), "crawl_delay": None if delay is None else float(delay), "sitemaps": parser.site_maps() or []}


def robots_policy(content: Column, agent: Column, url: Column) -> Column:
    """struct<allowed, crawl_delay, sitemaps>; a robots.txt that was not fetched (null) allows."""

    @F.pandas_udf("allowed boolean, crawl_delay double, sitemaps array<string>")
    def policy(contents: pd.Series, agents: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = [_policy(c, a, u) for c, a, u in zip(contents, agents, urls, strict=True)]
        return pd.DataFrame(rows, columns=["allowed", "crawl_delay", "sitemaps"])

    return policy(content, agent, url)


def wildcard_verdict(content: str | None, url: str | None) -> tuple[bool | None, str]:
    """Whether the rules for all agents allow a URL: the longest matching rule decides, Allow on a tie; None if there is nothing to go by."""
    if not (content or "").strip():
        return None, "no robots content"
    try:
        parts = urlsplit(url or "")
        path = (parts.path or "/") + ("?" + parts.query if parts.query else "") if parts.scheme and parts.netloc else "/"
    except ValueError:
        path = "/"
    longest, applies, any_rule = {"allow": -1, "disallow": -1}, False, False
    for line in (content or "").replace("\r\n", "\n").split("\n"):
        key, colon, value = line.split("#")[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon or not key:
            continue
        if key == "user-agent":
            applies = value == "*"
        elif applies and key in longest:
            any_rule = True
            plain = value.removesuffix("$").replace("*", "")
            if plain and (path == plain if value.endswith("$") else path.startswith(plain)):
                longest[key] = max(longest[key], len(value))
    if max(longest.values()) < 0:
        return (True, "no matching allow/disallow rule") if any_rule else (None, "no wildcard user-agent rule")
    return (False, "matched Disallow rule") if longest["disallow"] > longest["allow"] else (True, "matched Allow/default rule")


def evaluate(content: Column, url: Column) -> Column:
    """wildcard_verdict() over columns: struct<allowed, reason>."""

    @F.pandas_udf("allowed boolean, reason string")
    def verdict(contents: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wildcard_verdict(c, u) for c, u in zip(contents, urls, strict=True)], columns=["allowed", "reason"])

    return verdict(content, url)


def effective_delay(ip_minimum: Column, configured: Column, robots: Column, group_rate: Column) -> Column:
    """Seconds: the greatest of the four, nulls left out."""
    return F.greatest(ip_minimum, configured, robots, group_rate)


def observed_cooldown_ms(policy_ms: Column, effective_s: Column, robots_s: Column) -> Column:
    observed = F.ceil(F.greatest(F.coalesce(effective_s, F.lit(0.0)), F.coalesce(robots_s, F.lit(0.0))) * 1000)
    return F.greatest(policy_ms, F.lit(MIN_DELAY_MS), observed)


def preview(content: Column, lines: int, chars: int) -> Column:
    """The first lines, cut at so many characters."""
    text = F.array_join(F.slice(F.split(content, r"\r?\n"), 1, lines), "\n")
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def sitemap_urls(content: Column) -> Column:
    """Distinct URLs of a stored list, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit(r"(https?://[^\s<>\"]+)"), F.lit(1))))
