"""Relevance scores of URLs as native expressions.  The five formulas differ on purpose."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions import url as U

# The built-in policy, topics and families of words.
DEFAULT_KEYWORDS = [
    "medicine", "medicina", "medic", "health", "zdrav", "zdravje", "doctor", "zdravnik", "clinic", "klinika", "ambul", "ambulanta", "hospital", "bolnis", "bolnisnica",
    "treatment", "zdravljenje", "disease", "bolezen", "cepl", "preven", "higi", "fitness", "fitnes", "exercise", "training", "workout", "wellness", "nutrition", "prehrana", "vadba",
]
DEFAULT_SUFFIXES = ["gov.si", "nijz.si", "kclj.si", "zdravljenjenadom.si"]
TOPICS = ["medicine", "health", "medover", "symptom", "clinic", "hospital", "treatment", "disease", "doctor"]
GRAPH_FAMILIES = [
    (0.18, [".gov", "government", "ministr", "uprava"]),
    (0.24, ["health", "medic", "hospital", "clinic", "doctor", "disease", "nijz", "who.int"]),
    (0.14, ["research", "science", "university", "faculty", "edu"]),
    (0.10, ["news", "blog", "article"]),
    (0.18, ["covid", "epidem", "pandem", "vaccine", "virus"]),
]
TOPIC_FAMILIES = [
    ("medicine", ["med", "health", "clinic", "hospital", "doctor", "disease", "who", "ema", "nijz"]),
    ("government", ["gov", "uprava", "policy", "public", "parliament", "ministr"]),
    ("media", ["news", "blog", "press", "article", "media"]),
    ("education", ["edu", "school", "university", "faculty", "campus"]),
    ("science", ["research", "science", "lab", "institute", "academy"]),
    ("travel", ["tour", "travel", "visit", "hotel", "museum", "heritage"]),
]
GENERIC_LABELS = ["com", "org", "net", "eu", "si", "gov"]


@dataclass
class Policy:
    """Weights and lists of the relevance formulas; weights are not negative."""

    keywords: list[str] = field(default_factory=lambda: list(DEFAULT_KEYWORDS))
    suffixes: list[str] = field(default_factory=lambda: list(DEFAULT_SUFFIXES))
    same_host: float = 10.0
    suffix: float = 20.0
    keyword: float = 5.0
    depth: float = 0.2

    @classmethod
    def from_config(cls, config: dict | None) -> Policy:
        """From a settings object: lists, else texts split at line ends, commas and semicolons; no suffixes: the hosts of the seeds."""
        if not config:
            return cls()
        import re
        from urllib.parse import urlsplit

        def listed(name: str) -> list[str]:
            values = config.get(name) or [v.strip() for v in re.split(r"[\r\n,;]", config.get(name + "Text") or "")]
            return list({v.lower(): v for v in reversed(values) if v.strip()}.values())[::-1]

        keywords, suffixes = listed("topicKeywords"), [s.lower().lstrip(".") for s in listed("relevanceAllowedDomainSuffixes")]
        if not suffixes:
            seeds = [e["url"].strip() for e in config.get("seedEntries") or [] if e.get("enabled", True) and (e.get("url") or "").strip()]
            seeds += [u.strip() for u in re.split(r"[\r\n]", config.get("seedUrlsText") or "")]
            suffixes = list(dict.fromkeys(h for u in seeds if (h := urlsplit(u).hostname)))
        weight = lambda name, default: max(0.0, float(config.get(name, default)))
        return cls(keywords or list(DEFAULT_KEYWORDS), suffixes, weight("relevanceSameHostBoost", 10), weight("relevanceAllowedSuffixBoost", 20), weight("relevanceKeywordBoost", 5), weight("relevanceDepthPenalty", 0.2))


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _hits(text: Column, words: list[str], weight: float) -> Column:
    return _sum([F.when(F.contains(text, F.lit(w)), F.lit(weight)).otherwise(0.0) for w in dict.fromkeys(k.strip().lower() for k in words) if w])


def crawler_score(url: Column, parent: Column, depth: Column, policy: Policy) -> Column:
    """Score of a link to crawl; may be negative; 0 for what is no http(s) URL."""
    h = U.host(url)
    same = F.when(F.coalesce(U.host(parent) == h, F.lit(False)), policy.same_host).otherwise(0.0)
    suffix = F.when(U.host_in(h, policy.suffixes), policy.suffix).otherwise(0.0)
    text = F.lower(F.concat(U.path_of(url), F.lit("?"), U.query_of(url)))
    score = same + suffix + _hits(text, policy.keywords, policy.keyword) - policy.depth * F.greatest(depth, F.lit(0))
    return F.when(F.coalesce(h, F.lit("")) == "", 0.0).otherwise(score)


def crawler_priority(score: Column) -> Column:
    """The score as a queue priority, rounded half to even."""
    return F.bround(score).cast("int")


def page_evidence(url: Column, source: Column, policy: Policy) -> tuple[Column, Column, Column, Column]:
    """Whether a page's URL has a keyword, an allowed suffix, its source's host; and the sum for keywords."""
    h = U.host(url)
    decoded = lambda c: F.coalesce(F.try_url_decode(c), c)
    query = U.query_of(url)
    text = F.lower(F.concat(h, F.lit(" "), decoded(U.path_of(url)), F.lit(" "), decoded(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))))
    ok = F.coalesce(h, F.lit("")) != ""
    return ok & _any(text, [k.strip().lower() for k in policy.keywords if k.strip()]), ok & U.host_in(h, policy.suffixes), ok & F.coalesce(U.host(source) == h, F.lit(False)), _hits(text, policy.keywords, policy.keyword)


def page_score(url: Column, source: Column, depth: Column, policy: Policy) -> Column:
    """Score of a collected page: at least 0; 0.1 before the depth's part where there is no evidence."""
    has_keyword, has_suffix, same, hits = page_evidence(url, source, policy)
    base = F.when(same, policy.same_host).otherwise(0.0) + F.when(has_suffix, policy.suffix).otherwise(0.0) + hits
    base = base + F.when(has_keyword | has_suffix | same, 0.0).otherwise(0.1)
    score = F.greatest(F.lit(0.0), base - policy.depth * F.greatest(depth, F.lit(0)))
    return F.when(F.coalesce(U.host(url), F.lit("")) == "", 0.0).otherwise(score)


def preferential(url: Column, anchor: Column, topics: list[str] | None = None, hosts: list[str] | None = None) -> Column:
    """struct<score: int, level: string, reason: string>."""
    low, said = F.lower(url), F.lower(F.coalesce(anchor, F.lit("")))
    words = [t.lower() for t in (TOPICS if topics is None else topics)]
    topic = _any(low, words) | _any(said, words)
    preferred = _any(U.host(url), [h.lower() for h in hosts or []])
    binary = F.lower(U.path_of(url)).rlike(r"\.(pdf|docx?|pptx?)$")
    news = F.contains(low, F.lit("/news"))
    value = F.lit(50) + F.when(topic, 40).otherwise(0) + F.when(preferred, 20).otherwise(0) - F.when(binary, 35).otherwise(0) - F.when(news, 15).otherwise(0)
    level = F.when(value >= 80, "high").when(value >= 40, "medium").otherwise("low")
    reason = F.concat_ws(", ", F.lit("base=50"), F.when(topic, F.lit("topic+40")), F.when(preferred, F.lit("preferred-host+20")), F.when(binary, F.lit("binary-ext-35")), F.when(news, F.lit("news-15")))
    return F.struct(value.alias("score"), level.alias("level"), reason.alias("reason"))


def graph_score(url: Column, domain: Column) -> Column:
    """0 to 1 by families of words."""
    u, d = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (url, domain))
    text = F.concat(u, F.lit(" "), d)
    score = _sum([F.lit(0.05), *(F.when(_any(text, words), F.lit(w)).otherwise(0.0) for w, words in GRAPH_FAMILIES)])
    return F.when((u == "") & (d == ""), 0.0).otherwise(F.least(F.lit(1.0), score))


def topic(url: Column, domain: Column) -> Column:
    """First family that the URL or domain names; else the first telling label of the domain, else of the path, else ``generic``."""
    u, d = (F.lower(F.coalesce(c, F.lit(""))) for c in (url, domain))
    text = F.concat(u, F.lit(" "), d)
    named = F.coalesce(*[F.when(_any(text, words), F.lit(name)) for name, words in TOPIC_FAMILIES])
    labels = F.filter(F.transform(F.split(F.regexp_replace(d, r"^www\.", ""), r"\."), lambda p: F.trim(p)), lambda p: (F.length(p) >= 3) & ~p.isin(GENERIC_LABELS))
    segments = F.filter(F.slice(F.split(F.regexp_replace(u, "^https?://", ""), "/"), 2, 1000), lambda p: F.length(F.trim(p)) >= 4)
    return F.coalesce(named, F.get(labels, 0), F.trim(F.get(segments, 0)), F.lit("generic"))


def normal_relevance(value: Column) -> Column:
    """0 to 1: as it is up to one, tanh(x / 8) above."""
    x = F.when(F.isnan(value) | value.isNull(), 0.0).otherwise(value)
    return F.when(x <= 1, F.greatest(F.lit(0.0), x)).otherwise(F.least(F.lit(1.0), F.tanh(x / 8)))


def backlink_score(n_in: Column) -> Column:
    return F.log10(n_in + 1) * 10


def site_score(average: Column, top: Column, n: Column) -> Column:
    return 0.65 * average + 0.35 * top + F.least(F.lit(3.0), F.log10(n + F.lit(1.0)))
