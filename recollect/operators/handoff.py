"""Handoff briefs: what the next agent has to know about a subject and a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import approx_cut, approx_tokens, payload_text
from recollect.operators.common import SUBJECT, join_on, scoped_top
from recollect.operators.context import requests_with, with_tokens
from recollect.sources.scratch import materialize

# How much of each part is read and shown.
FACTS, EPISODES, RESOLUTIONS = 20, 30, 20
ISSUE_LINES, STEPS, RECENT, TOP_FACTORS, SHOWN_FACTS, SHOWN_RESOLVED = 10, 5, 5, 3, 8, 3
ACTORS, ACTIONS = ("agent", "system", "tool"), ("action", "tool_call", "resolution_attempt")


def _top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each subject and scope, as `pos`."""
    return scoped_top(rows, n, *order, rank="pos")


def _lists(rows: DataFrame, **columns: Column) -> DataFrame:
    """Per request, lists of columns in order of `pos`; null values are left out."""
    items = F.sort_array(F.collect_list(F.struct("pos", *[c.alias(n) for n, c in columns.items()])))
    out = rows.groupBy("request_id").agg(items.alias("_items"))
    pick = lambda n: F.filter(F.transform("_items", lambda x: x[n]), lambda v: v.isNotNull())
    return out.select("request_id", *[pick(n).alias(n) for n in columns])


def _tag(session: bool, n: int) -> Column:
    label = F.when(F.col("session_id").isNotNull(), F.concat(F.lit(" ["), "session_id", F.lit("]"))).otherwise("") if session else F.lit("")
    return F.concat(F.lit("["), "source", F.lit("/"), "type", F.lit("]"), label, F.lit(" "), F.substring("text", 1, n))


def _section(title: str, lines: Column, bullet: str = "- ") -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit(bullet), x)), "\n"), F.lit("\n\n"))).otherwise("")


def _less_one(text: Column) -> Column:
    """Without the last character."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(0), F.length(text) - 1))


def handoff_brief(
    requests: DataFrame, episodes: DataFrame, memories: DataFrame, resolutions: DataFrame, health: DataFrame, subject_sla: DataFrame,
    session_sla: DataFrame, tokens: Callable[[Column], Column] = approx_tokens, cut: Callable[[Column, Column], Column] = approx_cut,
) -> DataFrame:
    """Briefs for requests (request_id, tenant_id, subject_id, session_id, reason, max_tokens).

    Parts in order: customer, health, response times, active issue, what was tried, open issues,
    previously resolved, key facts, recent context. Notes longer than the budget are cut to its first
    `max_tokens` tokens by `cut(text, most)`, which has to go by the same tokens as the counter `tokens`.
    """
    asked = with_tokens(requests.withColumn("task", F.lit("")))
    facts = requests_with(asked, _top(memories.where("status = 'active' AND kind = 'profile_fact'"), FACTS, F.desc("created_at"), F.col("memory_id")))
    facts = _lists(facts, facts=F.col("content"), fact_ids=F.col("memory_id"))

    eps = _top(episodes, EPISODES, F.col("created_at"), F.col("episode_id")).withColumn("text", payload_text(F.col("payload")))
    eps = requests_with(asked, eps)
    here = F.coalesce(F.col("session_id") == F.col("current"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("request_id", here).orderBy("pos"))
    eps = eps.withColumns({"_here": here, "_n": rank})
    said = F.col("text") != ""
    tried = F.col("source").isin(*ACTORS) | F.col("type").isin(*ACTIONS) | ((F.col("type") == "message") & (F.col("source") == "assistant"))
    first = F.col("_n") <= ISSUE_LINES
    eps = _lists(
        eps,
        issue=F.when(here & first & said, _tag(False, 200)),
        issue_ids=F.when(here & first, F.col("episode_id")),
        steps=F.when(here & said & tried, F.substring("text", 1, 150)),
        recent=F.when(~here & (F.col("_n") <= RECENT) & said, _tag(True, 120)),
        recent_ids=F.when(~here & (F.col("_n") <= RECENT), F.col("episode_id")),
    )
    res = requests_with(asked, _top(resolutions, RESOLUTIONS, F.desc("updated_at"), F.col("resolution_id")))
    line = lambda default: F.concat(F.lit("["), "session_id", F.lit("] "), F.coalesce(F.nullif("resolution_summary", F.lit("")), F.lit(default)))
    solved = F.col("status") == "resolved"
    res = _lists(res, open_issues=F.when(~solved, line("No summary")), resolved=F.when(solved, line("Resolved")), resolution_ids=F.col("resolution_id"))

    rows = requests
    for part in (facts, eps, res):
        rows = rows.join(part, "request_id", "left")
    names = ["facts", "fact_ids", "issue", "issue_ids", "steps", "recent", "recent_ids", "open_issues", "resolved", "resolution_ids"]
    rows = rows.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in names})
    rows = join_on(rows, health.select(*SUBJECT, "score", "state", "factors"), SUBJECT)
    waiting = session_sla.groupBy(*SUBJECT).agg(F.max("open_duration_seconds").alias("_age"))
    rows = join_on(join_on(rows, subject_sla, SUBJECT), waiting, SUBJECT)

    rows = rows.withColumns({"score": F.coalesce("score", F.lit(100)), "state": F.coalesce("state", F.lit("healthy"))})
    top = F.slice(F.coalesce(F.transform("factors", lambda x: x["detail"]), F.array().cast("array<string>")), 1, TOP_FACTORS)
    icon = F.when(F.col("state") == "at_risk", "🔴").when(F.col("state") == "watch", "🟡").otherwise("🟢")
    mood = F.concat(icon, F.lit(" Health: "), F.upper("state"), F.lit(" (score: "), F.col("score").cast("string"), F.lit(")"),
                    F.when(F.size(top) > 0, F.concat(F.lit(" — "), F.array_join(top, "; "))).otherwise(""))
    count = lambda name, text: F.when(F.col(name) > 0, F.format_string(text, F.col(name)))
    sla = F.filter(F.array(
        count("first_response_breach_count", "⚠️ First-response SLA breached in %d session(s)"),
        count("resolution_breach_count", "⚠️ Resolution SLA breached in %d session(s)"),
        F.when(F.col("open_sessions") > 0, F.format_string("Open issue age: %.1fh", F.coalesce("_age", F.lit(0.0)) / 3600)),
        F.when(F.col("avg_first_response_seconds").isNotNull(), F.format_string("Avg first response: %.1f min", F.col("avg_first_response_seconds") / 60)),
    ), lambda x: x.isNotNull())
    summary = F.when(F.size("facts") > 0, F.concat("subject_id", F.lit(" — "), F.array_join(F.slice("facts", 1, 3), "; "))).otherwise(F.concat(F.lit("Subject: "), "subject_id"))
    more = F.when(F.size("issue") > 1, F.concat(F.lit(" (+ "), (F.size("issue") - 1).cast("string"), F.lit(" more messages in session)"))).otherwise("")
    issue = F.when(F.size("issue") > 0, F.concat(F.get("issue", F.lit(0)), more)).otherwise("")
    shown = F.array_compact(F.array(F.nullif(issue, F.lit(""))))
    # Open and resolved issues stand together, without a blank line; the notes end with one line end.
    open_, solved_ = _section("Open Issues", F.col("open_issues")), _section("Previously Resolved", F.slice("resolved", 1, SHOWN_RESOLVED))
    history = F.concat(F.when(solved_ != "", _less_one(open_)).otherwise(open_), solved_)
    notes = F.concat(
        F.lit("# Handoff Brief — "), "subject_id", F.lit("\nReason: "), "reason", F.lit("\nSession: "), "session_id", F.lit("\n\n"),
        _section("Customer", F.array(summary), ""), _section("Customer Health", F.array(mood), ""), _section("SLA Status", sla),
        _section("Active Issue", shown, ""), _section("What Has Been Tried", F.slice("steps", 1, STEPS)), history, _section("Key Facts", F.slice("facts", 1, SHOWN_FACTS)),
        _section("Recent Context (other sessions)", F.col("recent")),
    )
    rows = rows.withColumn("_notes", _less_one(notes)).withColumn("_n", tokens(F.col("_notes")))
    return rows.select(
        "request_id", "tenant_id", "subject_id", "session_id", "reason", summary.alias("customer_summary"), issue.alias("active_issue"),
        F.slice("steps", 1, STEPS).alias("attempted_steps"), F.slice("facts", 1, SHOWN_FACTS).alias("key_facts"), "recent", "open_issues", "resolved",
        F.col("score").alias("health_score"), F.col("state").alias("health_state"),
        F.when(F.col("_n") > F.col("max_tokens"), cut(F.col("_notes"), F.col("max_tokens"))).otherwise(F.col("_notes")).alias("handoff_notes"),
        F.least(F.col("_n"), F.col("max_tokens")).alias("token_estimate"), "fact_ids", "issue_ids", "resolution_ids", "recent_ids",
    )
