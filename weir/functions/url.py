"""URL and host functions.  Native column expressions where URLs are already canonical, Arrow UDFs where parsing must be lenient."""

from __future__ import annotations

import posixpath
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, extensions and their types.
TRACKING_KEYS = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src")
PATH_SAFE = "/:@!$&'()*+,;=-._~"
DOCUMENT_TYPES = {"pdf": "PDF", "docx": "DOCX", "pptx": "PPTX", "doc": "DOC", "ppt": "PPT"}
DOCUMENT_ORDER = ["PDF", "DOC", "DOCX", "PPT", "PPTX"]
IMAGE_TYPES = {"jpeg": "JPG", "jpg": "JPG", "png": "PNG", "webp": "WEBP", "gif": "GIF", "svg": "SVG", "bmp": "BMP", "tiff": "TIFF", "tif": "TIFF", "ico": "ICO", "avif": "AVIF"}
IMAGE_ORDER = ["JPG", "PNG", "WEBP", "GIF", "SVG", "BMP", "TIFF", "ICO", "AVIF", "OTHER"]
MIME_OF_TYPE = {"PDF": "application/pdf", "DOC": "application/msword", "DOCX": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "PPT": "application/vnd.ms-powerpoint", "PPTX": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
EXTENSION_OF_MIME = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", **{mime: f".{kind.lower()}" for kind, mime in MIME_OF_TYPE.items()}}
IMAGE_MIMES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "tif": "image/tiff", "tiff": "image/tiff", "avif": "image/avif"}
DOCUMENT_HINTS = "pdf|doc|docx|ppt|pptx|download|attachment|file|document"


def canonical(raw: str | None, base: str | None = None) -> str | None:
    """An absolute http(s) URL with lower-case scheme and host, without default port, fragment and tracking keys, its path normalised and its query sorted; None if it is none."""
    try:
        parts = urlsplit(urljoin(base, raw) if base else raw or "")
        host, port = parts.hostname, parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not host:
        return None
    default = {"http": 80, "https": 443}[parts.scheme]
    where = host.lower() if port in (None, 0, default) else f"{host.lower()}:{port}"
    path = posixpath.normpath(unquote(parts.path or "/"))
    path = path + "/" if parts.path.endswith("/") and not path.endswith("/") else path
    path = path if path.startswith("/") else "/" + path
    path = quote("/" if path == "/." else path, safe=PATH_SAFE)
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING_KEYS)
    return urlunsplit((parts.scheme, where, path, urlencode(kept), ""))


def canonicalize(url: Column, base: Column | None = None) -> Column:
    """canonical() over columns."""

    @F.pandas_udf("string")
    def alone(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: canonical(u), na_action="ignore")

    @F.pandas_udf("string")
    def based(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else canonical(u, b) for u, b in zip(urls, bases, strict=True)], dtype=object)

    return alone(url) if base is None else based(url, base)


def without_fragment(url: Column) -> Column:
    """The trimmed URL up to ``#``; blank gives null."""
    return F.nullif(F.regexp_replace(F.trim(url), "#.*$", ""), F.lit(""))


def without_tracking(url: Column) -> Column:
    """The URL without tracking keys in its query, and with the rest of the query sorted."""
    base, query = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    tracking = "(?i)^(utm_[^=]*|" + "|".join(TRACKING_KEYS) + ")(=|$)"
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracking)))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def host(url: Column) -> Column:
    """The lower-case host of an http(s) URL, or an empty string."""
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def site_key(url: Column) -> Column:
    """The host, or the whole URL where there is none, in lower case."""
    return F.coalesce(F.nullif(host(url), F.lit("")), F.lower(url))


def origin(url: Column) -> Column:
    """scheme://authority, or null."""
    return F.nullif(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def host_in(host_: Column, suffixes: list[str]) -> Column:
    """Whether the host is one of the suffixes or below one."""
    out = F.lit(False)
    for s in suffixes:
        s = s.strip().lower().lstrip(".")
        if s:
            out = out | (host_ == s) | host_.endswith("." + s)
    return out


def normal_host(host_: Column) -> Column:
    return F.lower(F.rtrim(F.trim(host_), F.lit(".")))


def registrable_domain(host_: Column) -> Column:
    """The last two labels; three where the top level has two letters and the label before it three at most; ``unknown`` for none."""
    parts = F.filter(F.split(F.lower(F.trim(host_)), r"\."), lambda p: p != "")
    n = F.size(parts)
    cut = F.when(n <= 2, parts).when((F.length(F.element_at(parts, -1)) == 2) & (F.length(F.try_element_at(parts, F.lit(-2))) <= 3), F.slice(parts, F.greatest(n - 2, F.lit(1)), 3)).otherwise(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2))
    return F.when(F.trim(host_) == "", "unknown").otherwise(F.coalesce(F.array_join(cut, "."), F.lit("unknown")))


def crawler_site_key(crawler: Column, ip: Column) -> Column:
    return F.concat_ws("|", crawler, ip)


def _type_of(url: Column, types: dict[str, str]) -> Column:
    """Type by extension of the path or of a query value (or key); longest extension first."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: p != "")
    values = F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.when(p.rlike("=."), F.regexp_extract(p, "=(.*)$", 1)).otherwise(p)), p))
    trimmed = F.transform(F.concat(F.array(path_of(url)), values), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"^[\"')\]}>;]+|[\"')\]}>;]+$", ""), r"[?#].*$", ""))
    known = "|".join(sorted(types, key=len, reverse=True))
    found = F.filter(F.transform(trimmed, lambda c: F.lower(F.regexp_extract(c, rf"(?i)\.({known})$", 1))), lambda e: e != "")
    codes = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
    return codes[F.get(found, 0)]


def document_type(url: Column) -> Column:
    """PDF, DOC, DOCX, PPT or PPTX, or null."""
    return _type_of(url, DOCUMENT_TYPES)


def image_type(url: Column) -> Column:
    """One of IMAGE_ORDER but OTHER, or null."""
    return _type_of(url, IMAGE_TYPES)


def is_image_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(r"\.(" + "|".join(IMAGE_TYPES) + ")$")


def likely_document(url: Column) -> Column:
    return F.lower(url).rlike(DOCUMENT_HINTS)


def content_type(header: Column) -> Column:
    """The media type of a Content-Type header."""
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def disposition_name(header: Column) -> Column:
    """File name of a Content-Disposition header, with its escapes resolved, or an empty string."""
    raw = F.trim(F.regexp_extract(header, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)\"?", 1))
    plain = F.regexp_replace(raw, r"^[\"']+|[\"']+$", "")
    return F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)


def document_type_of_response(url: Column, header: Column, disposition: Column) -> Column:
    """By media type, then by URL, then by the file name offered."""
    by_mime = F.create_map(*[x for k, v in MIME_OF_TYPE.items() for x in (F.lit(v), F.lit(k))])[content_type(header)]
    offered = F.lower(F.regexp_extract(disposition_name(disposition), r"(?i)\.(pdf|docx|pptx|doc|ppt)$", 1))
    by_name = F.create_map(*[x for k, v in DOCUMENT_TYPES.items() for x in (F.lit(k), F.lit(v))])[offered]
    return F.coalesce(by_mime, document_type(url), by_name)


def is_html(url: Column, header: Column, body: Column) -> Column:
    """By media type, else by the path's end, else by the body's first 64 characters."""
    kind, path = content_type(header), F.lower(path_of(url))
    probe = F.lower(F.substring(F.ltrim(body), 1, 64))
    return F.when(kind.isin("text/html", "application/xhtml+xml"), True).when(F.coalesce(kind, F.lit("")) != "", False).when(path.rlike(r"(\.html?|/)$") | (path == ""), True).otherwise(F.coalesce(probe.startswith("<!doctype html") | probe.startswith("<html"), F.lit(False)))


def sniffed_type(data: Column, fallback: Column) -> Column:
    """Media type by the first bytes of binary data."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("474946383761") | h.startswith("474946383961"), "image/gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp").when(h.startswith("255044462D"), "application/pdf").otherwise(fallback)


def _of(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def stored_content_type(kind: Column, data: Column) -> Column:
    """Media type of stored data: by its type's code, else by its first bytes."""
    return F.coalesce(_of(MIME_OF_TYPE, F.upper(F.trim(kind))), sniffed_type(data, F.lit("application/octet-stream")))


def file_extension(media: Column) -> Column:
    """The extension that a download of a media type gets."""
    return F.coalesce(_of(EXTENSION_OF_MIME, F.lower(media)), F.lit(".bin"))


def image_content_type(url: Column) -> Column:
    """Media type of an image by the end of its URL's path, or null."""
    return _of(IMAGE_MIMES, F.lower(F.regexp_extract(path_of(url), r"\.([A-Za-z]+)$", 1)))


def normal_ip(host_: Column) -> Column:
    """A site's key by its host: an IPv4 address written as IPv6 as IPv4, anything else in lower case; names are not resolved."""
    plain = F.lower(F.regexp_replace(F.trim(host_), r"^\[|\]$", ""))
    mapped = F.regexp_extract(plain, r"^(?:0*:)*:?ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    return F.coalesce(F.nullif(mapped, F.lit("")), plain)


def crawlable(href: Column) -> Column:
    """Not blank, no fragment, script, mail or telephone link."""
    return F.coalesce((F.trim(href) != "") & ~F.trim(href).rlike("(?i)^(#|javascript:|mailto:|tel:)"), F.lit(False))


def srcset_urls(srcset: Column) -> Column:
    """The URLs of a srcset attribute."""
    urls = F.transform(F.split(srcset, ","), lambda s: F.element_at(F.split(F.trim(s), r"\s+"), 1))
    return F.filter(urls, lambda u: crawlable(u))


def compact(url: Column) -> Column:
    """URLs of more than 128 characters as head, dots and tail."""
    return F.when(F.length(url) > 128, F.concat(F.left(url, F.lit(90)), F.lit("..."), F.right(url, F.lit(34)))).otherwise(url)


def external_site_url(domain: Column) -> Column:
    return F.when(F.trim(domain).rlike("(?i)^https?://"), F.trim(domain)).otherwise(F.concat(F.lit("https://"), F.trim(domain)))


def image_record_name(url: Column) -> Column:
    """At most 255 characters: the URL, or its beginning and a digest."""
    return F.when(F.length(url) <= 255, url).otherwise(F.concat(F.left(url, F.lit(242)), F.lit("-"), F.left(F.sha2(url, 256), F.lit(12))))
