"""Events, log levels, metrics and states as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types that are kept as logs, statuses and their synonyms.
LOGGED_TYPES = ["worker-log", "error", "status-change", "worker-spawned", "queue-change", "frontier-lease", "frontier-release", "frontier-complete", "frontier-prune", "frontier-lease-expired", "page-reported"]
TERMINAL = {"COMPLETED": ["completed", "complete", "done", "success"], "FAILED": ["failed", "fail", "error"], "DUPLICATE": ["duplicate", "dup"], "QUEUED": ["queued", "queue", "retry", "requeue"]}
STATES = ["QUEUED", "LOCKED", "PROCESSING", "COMPLETED", "DUPLICATE", "FAILED"]
WORKER_STATUSES = ["Active", "Idle", "Paused", "Stopped", "Error"]
TRANSITIONS = [("IDLE", "ACTIVE"), ("ACTIVE", "IDLE"), ("IDLE", "STOPPED"), ("ACTIVE", "STOPPED"), ("ACTIVE", "PAUSED"), ("PAUSED", "ACTIVE"), ("PAUSED", "STOPPED"), ("STOPPED", "IDLE")]


def field(payload: Column, name: str) -> Column:
    """A property of a JSON text, blank as null."""
    # bound to a variable, as nullif would read the payload twice
    return F.get(F.filter(F.array(F.trim(F.get_json_object(payload, f"$.{name}"))), lambda v: v != ""), F.lit(0))


def level(event_type: Column, payload: Column) -> Column:
    """The payload's level, else by the type's name."""
    low = F.lower(event_type)
    return F.coalesce(field(payload, "level"), F.when(F.contains(low, F.lit("error")) | F.contains(low, F.lit("failed")), "Error").when(F.contains(low, F.lit("warn")), "Warning").otherwise("Info"))


#: Properties that make a message, where an event has none.
TELLING = ["status", "previousStatus", "reason", "action", "url", "queueMode", "workerId", "priority", "depth"]


def message(event_type: Column, payload: Column, keys: Column | None = None) -> Column:
    """The payload's message, else its telling properties as k=v in a fixed order, else the type.

    keys: the payload's property names, if they are known; null where they could not be read.  Properties it hasn't are not looked for."""
    own = lambda n: field(payload, n) if keys is None else F.when(F.coalesce(F.array_contains(keys, n), F.lit(True)), field(payload, n))
    # a concatenation with null is null, and left out
    parts = [F.concat(F.lit(f"{n}="), own(n)) for n in TELLING]
    return F.coalesce(own("message"), F.get(F.filter(F.array(F.concat_ws(" | ", *parts)), lambda v: v != ""), F.lit(0)), event_type)


def metric_increment(payload: Column) -> Column:
    """How many pages an event says were processed, by the first property that tells; null if none does."""
    number = lambda name: F.get_json_object(payload, f"$.{name}").try_cast("double")
    kind = F.coalesce(field(payload, "type"), field(payload, "event_type"), F.lit(""))
    done = F.lower(F.coalesce(field(payload, "status"), F.lit(""))).isin("completed", "success", "done") & field(payload, "url").isNotNull()
    nested = F.get_json_object(F.get_json_object(payload, "$.message"), "$.page_processed").try_cast("double")
    return F.coalesce(F.when(kind == "page-reported", F.lit(1.0)), number("page_processed"), F.when(field(payload, "metric_name") == "page_processed", number("metric_value")), F.when(done, F.lit(1.0)), nested)


def log_row(event_type: Column, payload: Column) -> tuple[Column, Column, Column]:
    """Whether an event is kept as a log; its level and message.  A message with ``failed`` or ``error`` makes an error."""
    log = logged(event_type, payload)
    return event_type.isin(LOGGED_TYPES), log["level"], log["message"]


def logged(event_type: Column, payload: Column) -> Column:
    """struct<level, message> of an event kept as a log; keep it as a column of its own where both fields are needed.

    Every property asked for is another pass over the payload.  So its names are read first, and properties it hasn't are not asked for;
    names and message are bound to variables, so that they are not worked out again."""

    def told(text: Column, keys: Column) -> Column:
        low = F.lower(text)
        own = F.when(F.coalesce(F.array_contains(keys, "level"), F.lit(True)), field(payload, "level"))
        lvl = F.when((event_type == "error") | F.contains(low, F.lit("failed")) | F.contains(low, F.lit("error")), "Error").when(event_type == "frontier-prune", "Warning").otherwise(F.coalesce(own, F.lit("Info")))
        return F.struct(lvl.alias("level"), text.alias("message"))

    return F.transform(F.array(F.json_object_keys(payload)), lambda keys: F.transform(F.array(message(event_type, payload, keys)), lambda text: told(text, keys))[0])[0]


def metrics(event_type: Column, payload: Column) -> Column:
    """map<name, value>: one page for a reported page, each numeric property of a worker's metrics, else empty."""
    values = F.from_json(payload, "map<string,string>")
    numbers = F.map_filter(F.transform_values(values, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return F.when(event_type == "page-reported", F.create_map(F.lit("page_processed"), F.lit(1.0))).when(event_type == "worker-metric", F.coalesce(numbers, empty)).otherwise(empty)


def queue_numbers(payload: Column) -> Column:
    """map<name, int> of the payload's whole numbers."""
    whole = F.transform_values(F.from_json(payload, "map<string,string>"), lambda _, v: F.when(v.rlike(r"^-?\d+$"), v.try_cast("int")))
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def terminal_state(status: Column) -> Column:
    """The state a completion asks for; COMPLETED if it says nothing known."""
    low = F.lower(F.trim(status))
    out = F.when(low.isin(TERMINAL["COMPLETED"]), "COMPLETED")
    for state, words in list(TERMINAL.items())[1:]:
        out = out.when(low.isin(words), state)
    return out.otherwise("COMPLETED")


def capitalised(status: Column) -> Column:
    s = F.trim(status)
    return F.when(F.coalesce(s, F.lit("")) == "", "Unknown").otherwise(F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substring(s, 2, 1000))))


def worker_name(worker_id: Column) -> Column:
    return F.concat(F.lit("Worker-"), worker_id.cast("string"))


def activity(status: Column, reason: Column, current_url: Column) -> Column:
    """What a worker does, in words."""
    s, r = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(reason, F.lit("")))
    return F.when(s == "paused", "Paused").when(s == "stopped", "Stopped").when(s == "error", "Error").when((s == "active") & (F.coalesce(current_url, F.lit("")) != ""), "Crawling").when(r.rlike("queue|empty|wait"), "Waiting for URLs").when(s == "active", "Working").otherwise("Idle")


def transition_of(text: Column) -> Column:
    """struct<from, to, details> of a rendered message; both states come from the first ``status=`` there is, as rendered messages have always been read."""
    state = F.nullif(F.regexp_extract(text, r"(?i)status=([^|,;\s]+)", 1), F.lit(""))
    arrow = r"(?i)(\w+)\s*(?:->|→)\s*(\w+)"
    has = text.rlike(arrow)
    return F.struct(F.when(has, F.regexp_extract(text, arrow, 1)).otherwise(state).alias("from"), F.when(has, F.regexp_extract(text, arrow, 2)).otherwise(state).alias("to"), F.nullif(F.trim(F.regexp_extract(text, r"\|(.*)$", 1)), F.lit("")).alias("details"))


def replay_url(payload: Column) -> Column:
    """The URL an event is about: of its properties, its message, or its download result."""
    named = [field(payload, n) for n in ("url", "finalUrl", "requestedUrl", "rawUrl")]
    said = F.nullif(F.regexp_extract(F.coalesce(field(payload, "message"), F.lit("")), "(?i)url=([^ |,]+)", 1), F.lit(""))
    nested = [field(payload, f"downloadResult.{n}") for n in ("finalUrl", "requestedUrl")]
    return F.coalesce(*named, said, *nested)


def url_variants(url: Column) -> Column:
    """The keys a URL may be known under, best first: as it is, without fragment, without query, without the last slash."""
    plain = F.regexp_replace(url, "#.*$", "")
    bare = F.regexp_replace(plain, r"\?.*$", "")
    return F.array_distinct(F.transform(F.array(url, plain, bare, F.regexp_replace(bare, "/$", "")), lambda u: F.lower(u)))


def success_rate(pages: Column, errors: Column) -> Column:
    return F.when(pages + errors > 0, pages * 100.0 / (pages + errors)).otherwise(100.0)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
