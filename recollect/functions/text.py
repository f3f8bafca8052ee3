"""Column functions over payloads and texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and cues the jobs agree on.
CONTEXT_URGENCY = (
    "urgent", "critical", "blocked", "deadline", "asap", "emergency", "breaking", "outage", "downtime", "compliance", "sla", "escalat",
    "immediately", "production down", "p0", "p1", "severity",
)
HEALTH_URGENCY = "urgent critical asap emergency escalat broken down outage blocker p0 p1 sev1 sev2".split()
ISSUE_STOPWORDS = (
    "i me my we our you your he she it they them their this that is am are was were be been being have has had do does "
    "did will would shall should can could may might must a an the and but or nor for so yet at by from in into of on "
    "to up with as if then else when where how what which who whom why all any each every no not only very just also "
    "too hi hello thanks thank okay ok yes please hey sure got get let know think want need help"
).split()
OVERLAP_STOPWORDS = "the a an is are was were it to of and or for in on at by my i we you this that with".split()
#: Words of the reader's own product name belong here too; they are a parameter of breadcrumb_bonus.
BREADCRUMB_STOPWORDS = (
    "documentation guide overview the a an of for to on in with is are be use using how what why which when where do "
    "does i my we & > › -"
).split()

MESSAGES = "array<struct<role:string,content:string>>"


def payload_text(payload: Column) -> Column:
    """Text of an episode's JSON payload: messages as `role: content` lines, else text, else content, else ''.

    The first key that is there counts, even if it is empty.
    """
    messages = F.get_json_object(payload, "$.messages")
    lines = F.transform(
        F.from_json(messages, MESSAGES),
        lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit(""))),
    )
    return F.coalesce(
        F.when(messages.isNotNull(), F.coalesce(F.array_join(lines, "\n"), F.lit(""))),
        F.get_json_object(payload, "$.text"),
        F.get_json_object(payload, "$.content"),
        F.lit(""),
    )


def message_contents(payload: Column) -> Column:
    """The non-empty contents of a payload's messages; empty where there are none."""
    found = F.transform(F.from_json(F.get_json_object(payload, "$.messages"), MESSAGES), lambda m: m["content"])
    kept = F.filter(found, lambda c: c.isNotNull() & (c != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def word_tokens(text: Column) -> Column:
    """Distinct lower-case words between (Unicode) white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def issue_keywords(text: Column) -> Column:
    return F.array_except(word_tokens(text), words(ISSUE_STOPWORDS))


def overlap_keywords(text: Column) -> Column:
    long_ = F.filter(word_tokens(text), lambda w: F.length(w) > 2)
    return F.array_except(long_, words(OVERLAP_STOPWORDS))


def keyword_overlap(current: Column, prior: Column) -> Column:
    """Share of the current keywords that are among the prior ones; 0 if either set is empty."""
    n = F.size(F.array_intersect(current, prior))
    return F.when((F.size(current) == 0) | (F.size(prior) == 0), 0.0).otherwise(n / F.size(current))


def min_overlap(a: Column, b: Column) -> Column:
    """Shared words relative to the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def has_cue(text: Column, cues: Iterable[str]) -> Column:
    """Whether a lower-cased text holds any cue, also inside words."""
    return F.lower(text).rlike("|".join(cues))


# What a fact about a person looks like, in order.
_END = r"\s+(.+?)(?:\.|,|\n|$)"
FACT_PATTERNS = (
    r"(?dU)(?i:my name is|i'm|i am)\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)",
    r"(?idU)(?:i work at|i'm at|i am at)" + _END,
    r"(?idU)(?:i am on|i'm on)" + _END,
    r"(?idU)(?:i live in|i'm from|i am from)" + _END,
    r"(?idU)(?:i use|i prefer|my favorite)" + _END,
)


def profile_facts(text: Column) -> Column:
    """All facts of a text, pattern after pattern, without white space and marks at their ends."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in FACT_PATTERNS]))
    trimmed = F.transform(found, strip)
    return F.transform(trimmed, lambda x: F.regexp_replace(F.regexp_replace(x, r"\.+$", ""), ",+$", ""))


def strip(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_summary(text: Column) -> Column:
    """A summary's lines without role marks: up to two joined by an arrow, of more the first and last."""
    lines = F.transform(F.split(strip(text), "\n"), lambda x: F.regexp_replace(strip(x), r"^(user|assistant|system):\s*", ""))
    parts = F.filter(lines, lambda x: x != "")
    ends = F.concat(F.element_at(parts, 1), F.lit(" → "), F.element_at(parts, -1))
    return F.when(F.size(parts) <= 2, F.array_join(parts, " → ")).otherwise(ends)


def memory_line(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("- "), F.when(kind == "episode_summary", clean_summary(content)).otherwise(content))


def short_episode(source: Column, type_: Column, text: Column, n: int = 150) -> Column:
    body = F.when(text == "", "(no text content)").otherwise(F.substring(text, 1, n))
    return F.concat(F.lit("["), source, F.lit("/"), type_, F.lit("] "), body)


def approx_tokens(text: Column) -> Column:
    """Stand-in for a tokenizer: runs of word characters and single marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def approx_cut(text: Column, most: Column) -> Column:
    """The text up to the end of the last of its first `most` tokens, as approx_tokens counts them. White space goes with the token after it."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\s*(?:\w+|[^\w\s])"), F.lit(0)), F.lit(1), most), "")


def slugify(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(strip(text)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(strip(kept), r"\s+", "-")


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between two times, rounded down."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000).cast("int")


def stable_id(*parts: Column | str) -> Column:
    """A new row's id: a hash of what it is made from, so that a rerun gives the same."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def json_merge(*objects: Column) -> Column:
    """Keys of several JSON objects, the last one's value winning."""
    maps = [F.from_json(F.coalesce(o, F.lit("{}")), "map<string,variant>") for o in objects]
    names = F.array_distinct(F.flatten(F.array(*[F.map_keys(m) for m in maps])))
    last = lambda k: F.coalesce(*[F.try_element_at(m, k) for m in reversed(maps)])
    return F.to_json(F.map_from_arrays(names, F.transform(names, last)))


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000.0


def backoff_seconds(attempt: Column, base: float = 30.0, factor: float = 4.0) -> Column:
    return F.lit(base) * F.pow(F.lit(factor), attempt - 1)
