"""Links and media of HTML: one Arrow UDF per page, a table function, and a native form for plain anchors."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.url import IMAGE_TYPES, canonical

ASSETS = "links array<string>, images array<string>, js_links array<string>"
#: Ways in which inline scripts navigate.
NAVIGATION = re.compile(r"""(?i)(?:\blocation(?:\.href)?\s*=\s*|\blocation\.(?:assign|replace)\(\s*|\bwindow\.open\(\s*)(['"])(.+?)\1""")
SKIP = ("javascript:", "mailto:", "tel:")


def _usable(value: str | None) -> str | None:
    value = (value or "").strip()
    return None if not value or value.startswith("#") or value.lower().startswith(SKIP) else value


class _Collector(HTMLParser):
    """Gathers raw link and media values by where they come from."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[str] = []
        self.scripts: list[str] = []
        self.media: dict[str, list[str]] = {"img": [], "source": []}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(reversed(attrs))
        href = _usable(named.get("href")) if tag == "a" else None
        if href:
            self.anchors.append(href)
        if named.get("onclick"):
            found = [u for m in NAVIGATION.finditer(named["onclick"] or "") if (u := _usable(m.group(2)))]
            self.scripts.extend(found)
            if tag == "a":
                self.anchors.extend(found)
        if tag in self.media:
            names = ("src", "data-src", "data-original") if tag == "img" else ("src",)
            first = next((v for n in names if (v := (named.get(n) or "").strip())), None)
            entries = [part.split()[0] for part in (named.get("srcset") or "").split(",") if part.strip()]
            self.media[tag].extend(u for v in [first, *entries] if (u := _usable(v)))

    handle_startendtag = handle_starttag


def assets(html: str | None, page_url: str | None) -> dict[str, list[str]]:
    """Canonical links, images (media and links to images) and links that only scripts have, in order, each once."""
    collector = _Collector()
    collector.feed(html or "")
    collector.close()

    def absolute(values: list[str]) -> list[str]:
        out = []
        for v in values:
            try:
                url = canonical(urljoin(page_url or "", v)) if _usable(v) else None
            except ValueError:
                url = None
            if url:
                out.append(url)
        return out

    found = absolute(collector.anchors + collector.scripts)
    ends = tuple("." + e for e in IMAGE_TYPES)
    is_image = lambda u: u.split("?")[0].lower().endswith(ends)
    links = [u for u in found if not is_image(u)]
    images = absolute(collector.media["img"] + collector.media["source"]) + [u for u in found if is_image(u)]
    from_anchors = set(absolute([a for a in collector.anchors if a not in collector.scripts]))
    js = [u for u in absolute(collector.scripts) if u not in from_anchors]
    return {"links": list(dict.fromkeys(links)), "images": list(dict.fromkeys(images)), "js_links": list(dict.fromkeys(js))}


def page_assets(html: Column, url: Column) -> Column:
    """assets() over columns: struct<links, images, js_links>."""

    @F.pandas_udf(ASSETS)
    def parse(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([assets(h, u) for h, u in zip(pages, urls, strict=True)], columns=["links", "images", "js_links"])

    return parse(html, url)


def anchor_hrefs(html: Column) -> Column:
    """The href values of anchors, natively; enough for pages with quoted attributes."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))


@F.udtf(returnType="kind string, url string, pos int", useArrow=True)
class AssetRows:
    """The table of a page's links, images and script links: kind (link, image, script), url, and its place among its kind."""

    def eval(self, html: str, page_url: str):
        found = assets(html, page_url)
        for kind, name in (("link", "links"), ("image", "images"), ("script", "js_links")):
            for pos, url in enumerate(found[name]):
                yield kind, url, pos


def asset_rows(pages: DataFrame, html_col: str = "html_content", url_col: str = "url") -> DataFrame:
    """Pages without their HTML, a row for each of their assets: the page's columns, kind, asset_url and pos."""
    rows = pages.lateralJoin(AssetRows(F.col(html_col).outer(), F.col(url_col).outer()).toDF("kind", "asset_url", "pos"))
    return rows.select(*[c for c in pages.columns if c != html_col], "kind", "asset_url", "pos")
