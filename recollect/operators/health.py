"""Health scores that explain themselves, and alerts on their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import (
    HEALTH_URGENCY,
    has_cue,
    message_contents,
    overlap_keywords,
    seconds_between,
    whole_days,
)
from recollect.operators.common import SUBJECT, join_on, per_subject_cap
from recollect.operators.sla import SESSION, session_firsts

# Narrower source lists than those of response times.
USER_SOURCES = ("user", "chat", "support-chat")
AGENT_SOURCES = ("assistant", "agent", "system", "tool")
#: Fixed value: episodes, and resolutions, that one request reads of a subject.
REQUEST_CAP = 200
DAY = 86_400.0
STATES = ("healthy", "watch", "at_risk")


def _overlaps(episodes: DataFrame, states: DataFrame) -> DataFrame:
    """Subjects whose open and resolved sessions' words overlap: distinct words by side are counted,
    so no subject's text is ever joined into one string."""
    words = join_on(episodes, states, SESSION, "inner").select(
        *SUBJECT, "status", F.explode(message_contents(F.col("payload"))).alias("_text")
    )
    words = words.select(*SUBJECT, "status", F.explode(overlap_keywords(F.col("_text"))).alias("word"))
    sides = words.groupBy(*SUBJECT, "word").agg(
        F.max((F.col("status") == "open").cast("int")).alias("o"), F.max((F.col("status") == "resolved").cast("int")).alias("r")
    )
    n = sides.groupBy(*SUBJECT).agg(F.sum("o").alias("o"), F.sum("r").alias("r"), F.sum(F.col("o") * F.col("r")).alias("both"))
    least = F.least("o", "r")
    return n.select(*SUBJECT, (F.when(least > 0, F.col("both") / least >= 0.3).otherwise(False)).alias("repeated"))


def health_signals(
    episodes: DataFrame, resolutions: DataFrame, as_of: str, episode_cap: int | None = None, resolution_cap: int | None = None
) -> DataFrame:
    """What the score is made from, a row a subject that has episodes or resolutions: all of them, or the oldest
    episodes and latest resolutions up to caps (REQUEST_CAP is that of a single request)."""
    now = F.lit(as_of).cast("timestamp")
    eps = per_subject_cap(episodes, episode_cap, F.col("created_at"), F.col("episode_id"))
    res = per_subject_cap(resolutions, resolution_cap, F.desc("updated_at"), F.col("resolution_id"))
    firsts = session_firsts(eps, USER_SOURCES, AGENT_SOURCES, fallback=False)
    s = join_on(res, firsts, SESSION)
    idle = F.when((F.col("status") == "open") & F.col("last_at").isNotNull(), whole_days(now, F.col("last_at")))
    took = seconds_between(F.col("resolved_at"), F.col("first_user"))
    solved = F.col("status") == "resolved"
    by_res = s.groupBy(*SUBJECT).agg(
        F.count("*").alias("total_sessions"),
        F.count_if(F.col("status") == "open").alias("open_sessions"),
        F.count_if(solved).alias("resolved_sessions"),
        # the first open session by latest update that was idle for a week
        F.max_by(
            F.when(idle >= 7, F.struct("session_id", idle.alias("days"))),
            F.when(idle >= 7, F.struct(F.col("updated_at"), F.expr("-hash(resolution_id)"))),
        ).alias("idle"),
        F.count_if(solved & (whole_days(now, F.col("resolved_at")) <= 7)).alias("recent"),
        F.count_if(solved & (took > DAY)).alias("breaches"),
        F.avg(seconds_between(F.col("first_agent"), F.col("first_user"))).alias("response"),
    )
    urgent = F.exists(message_contents(F.col("payload")), lambda c: has_cue(c, HEALTH_URGENCY))
    by_eps = eps.groupBy(*SUBJECT).agg(F.count_if(urgent).alias("escalations"))
    both = by_eps.withColumn("_e", F.lit(1))
    states = res.where(F.col("status").isin("open", "resolved")).select(*SESSION, "status").distinct()
    keys = by_eps.select(*SUBJECT).union(by_res.select(*SUBJECT)).distinct()
    out = join_on(join_on(join_on(keys, both.drop("_e"), SUBJECT), by_res, SUBJECT), _overlaps(eps, states), SUBJECT)
    counts = ["escalations", "total_sessions", "open_sessions", "resolved_sessions", "recent", "breaches"]
    repeated = F.coalesce("repeated", F.lit(False)) & (F.coalesce("open_sessions", F.lit(0)) > 0)
    return out.fillna(0, counts).withColumn("repeated", repeated & (F.col("resolved_sessions") > 0))


def _factors() -> list[tuple[str, Column, Column, Column]]:
    """(signal, whether it counts, impact, detail) in order."""
    n = F.col
    rate = n("resolved_sessions") / n("total_sessions")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    capped = lambda c, each, most: -F.least(c * each, F.lit(most))
    minutes = n("response") / 60
    return [
        ("unresolved_issues", n("open_sessions") > 0, capped(n("open_sessions"), 15, 45), text(n("open_sessions"), " open session(s)")),
        ("repeated_issues", n("repeated"), F.lit(-20), F.lit("Open issues resemble previously resolved ones")),
        ("escalations", n("escalations") > 0, capped(n("escalations"), 10, 20), text(n("escalations"), " episode(s) with urgency markers")),
        ("idle_open_issue", n("idle").isNotNull(), F.lit(-15), text("Session ", n("idle.session_id"), " idle for ", n("idle.days"), " days")),
        ("recent_resolution", n("recent") > 0, F.lit(10), text(n("recent"), " session(s) resolved in last 7 days")),
        ("high_resolution_rate", (n("total_sessions") >= 2) & F.coalesce(rate >= 0.8, F.lit(False)), F.lit(10),
         text(F.round(rate * 100).cast("int"), "% sessions resolved (", n("resolved_sessions"), "/", n("total_sessions"), ")")),
        ("sla_resolution_breaches", n("breaches") > 0, capped(n("breaches"), 10, 20), text(n("breaches"), " session(s) exceeded 24h resolution SLA")),
        ("slow_first_response", F.coalesce(minutes > 10, F.lit(False)), F.lit(-5),
         text("Avg first response ", F.format_string("%.1f", minutes), " min (threshold: 10 min)")),
    ]


def health_state(score: Column) -> Column:
    return F.when(score >= 70, "healthy").when(score >= 40, "watch").otherwise("at_risk")


def subject_health(signals: DataFrame) -> DataFrame:
    """Score 0..100, state and the factors (signal, impact, detail) that count, in their order."""
    made = [
        F.when(on, F.struct(F.lit(name).alias("signal"), impact.cast("int").alias("impact"), detail.alias("detail")))
        for name, on, impact, detail in _factors()
    ]
    rows = signals.withColumn("factors", F.filter(F.array(*made), lambda x: x.isNotNull()))
    total = F.aggregate("factors", F.lit(100), lambda acc, x: acc + x["impact"])
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)))
    return rows.select(*SUBJECT, "score", health_state(F.col("score")).alias("state"), "factors")


def severity(state: Column) -> Column:
    return F.when(state == "at_risk", 2).when(state == "watch", 1).otherwise(0)


def transition(previous: Column, current: Column) -> Column:
    """Alert for a change of state; a subject seen for the first time (previous null) was healthy."""
    before, now = severity(F.coalesce(previous, F.lit("healthy"))), severity(current)
    better = (now < before) & previous.isNotNull()
    return F.when(now > before, "subject.health_degraded").when(better, "subject.health_improved")


def health_alerts(health: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, new cache): events of the subjects whose state changed, and everybody's last state."""
    rows = join_on(health, cache.select(*SUBJECT, F.col("last_state").alias("previous_state")), SUBJECT)
    rows = rows.withColumn("event", transition(F.col("previous_state"), F.col("state")))
    alerts = rows.where("event IS NOT NULL").select(
        *SUBJECT, "event", F.coalesce("previous_state", F.lit("healthy")).alias("previous_state"),
        F.col("state").alias("current_state"), "score", F.slice("factors", 1, 3).alias("factors"),
    )
    new = health.select("subject_id", "tenant_id", F.col("state").alias("last_state"), F.col("score").alias("last_score"))
    kept = join_on(cache, health.select(*SUBJECT), SUBJECT, "left_anti")
    return alerts, new.unionByName(kept.select("subject_id", "tenant_id", "last_state", "last_score"))


def health_transitions(history: DataFrame) -> DataFrame:
    """Alerts over a history of (subject, state, updated_at): each state against the one before it; those of one time go by name."""
    before = F.lag("state").over(Window.partitionBy(*SUBJECT).orderBy("updated_at", "state"))
    return history.withColumn("previous_state", before).withColumn(
        "event", transition(F.col("previous_state"), F.col("state"))
    ).where("event IS NOT NULL")


def health_distribution(subjects: DataFrame, cache: DataFrame) -> DataFrame:
    """(state, n): subjects by last state; `unknown` for those never scored, if there are any."""
    rows = join_on(subjects.select(*SUBJECT).distinct(), cache.select(*SUBJECT, "last_state"), SUBJECT)
    return rows.groupBy(F.coalesce("last_state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))
