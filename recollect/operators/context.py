"""Ranked context bundles within a token budget, for many requests at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import (
    BREADCRUMB_STOPWORDS,
    CONTEXT_URGENCY,
    approx_tokens,
    has_cue,
    issue_keywords,
    memory_line,
    payload_text,
    short_episode,
    word_tokens,
    words,
)
from recollect.operators.common import ANY_TENANT, SCOPE, in_scope, scoped, scoped_top
from recollect.sources.scratch import materialize

# Scores.
KIND_PRIORITY = {"profile_fact": 10.0, "procedure": 8.0, "episode_summary": 5.0}
EPISODE_PRIORITY, RECENCY, RELEVANCE, SEMANTIC = 3.0, 5.0, 5.0, 8.0
VALID, EXPIRED, BREADCRUMB = 3.0, -4.0, 3.0
SESSION, RESOLVED, OPEN, ACTION, URGENT, CHATTER = 6.0, -5.0, 4.0, 2.0, 2.0, -2.0
REPEAT, REPEAT_WITH_SUMMARY, REPEAT_OVERLAP = 4.0, 6.0, 0.3
ACTORS, ACTIONS = ("assistant", "agent", "tool", "system"), ("action", "tool_call", "resolution_attempt")
POOLS = {"profile_fact": 50, "procedure": 20, "episode_summary": 30}
EPISODE_POOL, SEMANTIC_POOL, RESERVE = 30, 100, 10


def recency(at: Column, partition: str = "request_id") -> Column:
    """0 to RECENCY by a linear scale over the request's candidates; all alike: RECENCY; null: 0."""
    every = Window.partitionBy(partition)
    t = F.unix_micros(at)
    low, high = F.min(t).over(every), F.max(t).over(every)
    return F.when(at.isNull(), 0.0).when(high == low, RECENCY).otherwise((t - low) / (high - low) * RECENCY)


def relevance(content: Column, task_tokens: Column) -> Column:
    n = F.size(task_tokens)
    shared = F.size(F.array_intersect(task_tokens, word_tokens(F.coalesce(content, F.lit("")))))
    return F.when(n == 0, 0.0).otherwise(shared / n * RELEVANCE)


def temporal(valid_to: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp")
    return F.when(valid_to.isNull() | (valid_to > now), VALID).otherwise(EXPIRED)


def _meaningful(tokens: Column, stopwords: list[str]) -> Column:
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), r"""^[?.,:;()\[\]{}'"]+|[?.,:;()\[\]{}'"]+$""", ""))
    return F.array_except(F.array_distinct(F.filter(bare, lambda t: t != "")), words(stopwords))


def breadcrumb_bonus(breadcrumbs: Column, task_tokens: Column, stopwords: list[str] = BREADCRUMB_STOPWORDS) -> Column:
    """Best share of words that the task and one of the memory's headings have in common."""
    task = _meaningful(task_tokens, stopwords)

    def one(b: Column) -> Column:
        own = _meaningful(F.split(F.translate(b, "›>", "  "), r"(?U)\s+"), stopwords)
        least = F.least(F.size(own), F.size(task))
        return F.when(least > 0, F.size(F.array_intersect(own, task)) / least * BREADCRUMB).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(breadcrumbs, one)), F.lit(0.0))


def requests_with(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Every request with the scoped rows of its subject."""
    own = in_scope(requests).select("request_id", *SCOPE, "task", "task_tokens", F.col("session_id").alias("current"))
    return own.join(rows, list(SCOPE))


def with_tokens(requests: DataFrame) -> DataFrame:
    return requests.withColumn("task_tokens", word_tokens(F.col("task")))


def memory_pool(requests: DataFrame, memories: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """The newest active memories of each kind up to its pool, then those that semantic search found, each once.

    Pools are cut per subject before they meet the requests.
    """
    active = memories.where("status = 'active'")
    cap = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in POOLS.items()], F.lit(0))
    rows = requests_with(requests, scoped_top(active, cap, F.desc("created_at"), F.col("memory_id"), more=("kind",)))
    if semantic is None:
        return rows.withColumn("semantic", F.lit(None).cast("double"))
    found = semantic.where(F.col("rank") <= SEMANTIC_POOL).select("request_id", "memory_id", "distance", "rank")
    # greatest() passes over nulls: without a distance there is no score.
    score = F.when(F.col("distance").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("distance")) * SEMANTIC)
    rows = rows.join(found, ["request_id", "memory_id"], "left").withColumn("semantic", score)
    extra = found.join(rows.select("request_id", "memory_id"), ["request_id", "memory_id"], "left_anti")
    # What was found is looked up by its id, at most SEMANTIC_POOL rows a request; it counts only if the request may see it.
    asked = in_scope(requests).select("request_id", "scope", F.col("subject_id").alias("_subject"), "task", "task_tokens", F.col("session_id").alias("current"))
    extra = extra.join(active, "memory_id").join(asked, "request_id")
    seen = (F.col("subject_id") == F.col("_subject")) & ((F.col("scope") == ANY_TENANT) | F.col("tenant_id").eqNullSafe(F.col("scope")))
    extra = extra.where(seen).withColumns({"semantic": score, "pool_rank": 1_000 + F.col("rank")})
    names = [c for c in rows.columns if c not in ("distance", "rank")]
    return rows.select(names).union(extra.select(names))


def memory_breadcrumbs(pool: DataFrame, episodes: DataFrame) -> DataFrame:
    """(memory_id, breadcrumbs): the headings of the episodes that a memory came from."""
    payload = F.col("payload")
    heading = lambda key: F.nullif(F.get_json_object(payload, key), F.lit(""))
    cites = pool.select("memory_id", "source_episode_ids").dropDuplicates(["memory_id"]).select("memory_id", F.explode("source_episode_ids").alias("episode_id"))
    # Only cited episodes' payloads are parsed.
    cited = episodes.select("episode_id", "payload").join(cites.select("episode_id").distinct(), "episode_id", "left_semi")
    marked = cited.select("episode_id", F.coalesce(heading("$.breadcrumb"), heading("$.title")).alias("b")).where("b IS NOT NULL")
    return cites.join(marked, "episode_id").groupBy("memory_id").agg(F.sort_array(F.collect_list("b")).alias("breadcrumbs"))


def memory_scores(pool: DataFrame, as_of: str, breadcrumbs: DataFrame | None = None) -> DataFrame:
    """The pool with `score`, its `line` and `section`."""
    if breadcrumbs is None:
        rows = pool.withColumn("breadcrumbs", F.lit(None).cast("array<string>"))
    else:
        rows = pool.join(breadcrumbs, "memory_id", "left")
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KIND_PRIORITY.items()], F.lit(1.0))
    meaning = F.coalesce("semantic", relevance(F.col("content"), F.col("task_tokens")))
    score = kind + recency(F.col("created_at")) + meaning + temporal(F.col("valid_to"), as_of)
    section = F.when(F.col("kind") == "profile_fact", "facts").when(F.col("kind") == "procedure", "procedures").otherwise("history")
    return rows.withColumns({
        "score": score + breadcrumb_bonus(F.col("breadcrumbs"), F.col("task_tokens")),
        "line": memory_line(F.col("kind"), F.col("content")), "section": section,
    })


def episode_pool(requests: DataFrame, episodes: DataFrame, order: str = "oldest") -> DataFrame:
    """The subject's oldest (or newest) episodes up to the pool, with their text."""
    at = F.col("created_at") if order == "oldest" else F.desc("created_at")
    rows = scoped_top(episodes, EPISODE_POOL, at, F.col("episode_id"))
    return requests_with(requests, rows.withColumn("text", payload_text(F.col("payload"))))


def repeat_issues(pool: DataFrame, requests: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(request_id, session_id, repeat): the bonus of resolved sessions whose words the current issue shares."""
    resolved = scoped(resolutions.where("status = 'resolved'"))
    states = resolved.select(*SCOPE, "session_id").distinct()
    texts = pool.where("text <> ''")
    now = texts.where("current IS NOT NULL AND session_id = current").groupBy("request_id").agg(F.collect_list("text").alias("_t"))
    issue = requests.join(now, "request_id", "left")
    said = F.concat_ws(" ", F.coalesce("_t", F.array().cast("array<string>")), F.col("task"))
    issue = issue.select("request_id", F.explode(issue_keywords(said)).alias("word"))
    size = issue.groupBy("request_id").agg(F.count("*").alias("n"))
    prior = texts.where("session_id IS NOT NULL AND NOT session_id <=> current").join(states, [*SCOPE, "session_id"])
    sessions = prior.select("request_id", *SCOPE, "session_id").distinct()
    recent = F.row_number().over(Window.partitionBy(*SCOPE).orderBy(F.desc("updated_at"), "resolution_id"))
    notes = resolved.withColumn("_r", recent).where(F.col("_r") <= 20).where("coalesce(resolution_summary, '') <> ''")
    notes = notes.groupBy(*SCOPE, "session_id").agg(F.min("resolution_summary").alias("note"))
    noted = sessions.join(notes, [*SCOPE, "session_id"], "left")
    heard = prior.select("request_id", "session_id", F.explode(issue_keywords(F.col("text"))).alias("word")).union(
        noted.where("note IS NOT NULL").select("request_id", "session_id", F.explode(issue_keywords(F.col("note"))).alias("word"))
    )
    shared = heard.distinct().join(issue, ["request_id", "word"]).groupBy("request_id", "session_id").agg(F.count("*").alias("both"))
    out = shared.join(size, "request_id").where(F.col("both") / F.col("n") >= REPEAT_OVERLAP).join(noted, ["request_id", "session_id"])
    bonus = F.when(F.col("note").isNotNull(), REPEAT_WITH_SUMMARY).otherwise(REPEAT)
    return out.select("request_id", "session_id", bonus.alias("repeat"))


def episode_scores(pool: DataFrame, requests: DataFrame, resolutions: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """The pool with `score` and `line`; episodes that pooled summaries cite (request_id, episode_id) go."""
    states = scoped(resolutions).groupBy(*SCOPE, "session_id").agg(
        F.max(F.col("status") == "resolved").alias("_resolved"), F.max(F.col("status") == "open").alias("_open")
    )
    rows = pool.withColumn("_recency", recency(F.col("created_at")))
    if covered is not None:
        rows = rows.join(covered, ["request_id", "episode_id"], "left_anti")
    rows = rows.join(states, [*SCOPE, "session_id"], "left").join(repeat_issues(pool, requests, resolutions), ["request_id", "session_id"], "left")
    text = F.col("text")
    gain = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    trimmed = F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    score = (
        F.lit(EPISODE_PRIORITY) + F.col("_recency") + relevance(text, F.col("task_tokens"))
        + gain(F.col("session_id") == F.col("current"), SESSION) + gain(F.col("_resolved"), RESOLVED)
        + F.coalesce("repeat", F.lit(0.0)) + gain(F.col("_open"), OPEN)
        + gain(F.col("source").isin(*ACTORS) | F.col("type").isin(*ACTIONS), ACTION)
        + gain((text != "") & has_cue(text, CONTEXT_URGENCY), URGENT) + gain((text != "") & (trimmed < 20), CHATTER)
    )
    line = F.concat(F.lit("- "), short_episode(F.col("source"), F.col("type"), text))
    return rows.withColumns({"score": score, "line": line, "section": F.lit("episodes")})


def pack_budget(items: Column, budget: Column, used: Column) -> Column:
    """Items (struct with `tokens`) that fit, in order: one that doesn't fit is skipped and smaller ones are tried."""
    kind = "struct<used:bigint,kept:array<int>>"
    start = F.struct(used.cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept")).cast(kind)
    places = F.sequence(F.lit(1), F.size(items))

    def step(acc: Column, i: Column) -> Column:
        n = F.get(items, i - 1)["tokens"]
        fits = acc["used"] + n + RESERVE <= budget
        new = F.struct((acc["used"] + n).cast("bigint").alias("used"), F.array_append(acc["kept"], i).alias("kept"))
        return F.when(fits, new).otherwise(acc)

    return F.when(F.size(items) > 0, F.aggregate(places, start, step)).otherwise(start)


def assemble_context(
    requests: DataFrame, episodes: DataFrame, memories: DataFrame, resolutions: DataFrame, as_of: str,
    semantic: DataFrame | None = None, tokens: Callable[[Column], Column] = approx_tokens, episode_order: str = "oldest",
) -> DataFrame:
    """Context bundles of requests (request_id, tenant_id, subject_id, task, session_id, max_tokens).

    One row a request: the ids kept by section, their sessions, the rendered text and its number of tokens.
    """
    asked = with_tokens(requests)
    # Both pools are read several times; they are bounded by requests, not by subjects.
    pool = materialize(memory_pool(asked, memories, semantic), "context-memories")
    summaries = pool.where("kind = 'episode_summary'")
    covered = summaries.select("request_id", F.explode("source_episode_ids").alias("episode_id")).distinct()
    by_memory = memory_scores(pool, as_of, memory_breadcrumbs(pool, episodes))
    heard = materialize(episode_pool(asked, episodes, episode_order), "context-episodes")
    by_episode = episode_scores(heard, asked, resolutions, covered)
    order = {"facts": 0, "procedures": 1, "history": 2, "episodes": 3}
    place = F.coalesce(*[F.when(F.col("section") == k, v) for k, v in order.items()])
    none = F.lit(None).cast("string")
    both = by_memory.select("request_id", "score", place.alias("pool"), "pool_rank", F.col("memory_id").alias("id"), none.alias("session_id"), F.lit(None).cast("timestamp").alias("at"), "line").union(
        by_episode.select("request_id", "score", place.alias("pool"), "pool_rank", F.col("episode_id").alias("id"), "session_id", F.col("created_at").alias("at"), "line")
    )
    item = F.struct(
        (-F.round("score", 9)).alias("key"), "pool", "pool_rank", "id", "session_id", "at", "line", tokens(F.col("line")).cast("bigint").alias("tokens")
    )
    lists = both.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = requests.join(lists, "request_id", "left")
    empty = F.array().cast(lists.schema["items"].dataType)
    header = F.concat(F.lit("## Task\n"), F.col("task"), F.lit("\n"))
    rows = rows.withColumn("items", F.coalesce("items", empty)).withColumn("_header", header)
    rows = rows.withColumn("_p", pack_budget(F.col("items"), F.col("max_tokens"), tokens(F.col("_header"))))
    rows = rows.withColumn("_kept", F.transform("_p.kept", lambda i: F.get("items", i - 1)))

    def of(n: int) -> Column:
        return F.filter("_kept", lambda x: x["pool"] == n)

    def block(title: str, lines: Column) -> Column:
        text = F.concat(F.lit(f"\n{title}\n"), F.array_join(lines, "\n"), F.lit("\n"))
        return F.when(F.size(lines) > 0, text).otherwise("")

    lines = lambda part: F.transform(part, lambda x: x["line"])
    mine = F.filter(of(3), lambda x: F.coalesce(x["session_id"] == F.col("session_id"), F.lit(False)))
    others = F.filter(of(3), lambda x: ~F.coalesce(x["session_id"] == F.col("session_id"), F.lit(False)))
    part = lambda title, ls: F.when(F.size(ls) > 0, F.array_append(F.array(title), F.array_join(ls, "\n"))).otherwise(F.array().cast("array<string>"))
    grouped = F.concat(
        part(F.concat(F.lit("### Current session ("), F.col("session_id"), F.lit(")")), lines(mine)), part(F.lit("### Previous interactions"), lines(others))
    )
    recent = F.when(F.col("session_id").isNotNull(), grouped).otherwise(lines(of(3)))
    text = F.concat(
        "_header", block("## About this user", lines(of(0))), block("## Procedures", lines(of(1))), block("## Recent history", lines(of(2))),
        block("## Recent interactions", recent),
    )
    ids = lambda part: F.transform(part, lambda x: x["id"])
    return rows.select(
        "request_id", "tenant_id", "subject_id", "task", ids(of(0)).alias("fact_ids"), ids(of(1)).alias("procedure_ids"), ids(of(2)).alias("summary_ids"),
        ids(of(3)).alias("episode_ids"), F.array_distinct(F.filter(F.transform(of(3), lambda x: x["session_id"]), lambda s: s.isNotNull())).alias("sessions"),
        text.alias("assembled_context"), tokens(text).alias("token_estimate"), F.col("_p.used").alias("budget_used"),
    )


def bundle_sessions(bundles: DataFrame, episodes: DataFrame) -> DataFrame:
    """(request_id, session_id, episode_count, first_at, last_at) of the sessions in the bundles."""
    used = bundles.select("request_id", F.explode("episode_ids").alias("episode_id")).join(episodes, "episode_id")
    return used.where("session_id IS NOT NULL").groupBy("request_id", "session_id").agg(
        F.count("*").alias("episode_count"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )
