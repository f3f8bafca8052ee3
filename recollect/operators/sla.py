"""Response and resolution times of sessions and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import seconds_between
from recollect.operators.common import SUBJECT, join_on, per_subject_cap

# Who speaks for the customer and who answers.
USER_SOURCES = ("user", "chat", "support-chat", "support_chat", "customer", "manual_input")
AGENT_SOURCES = ("assistant", "agent", "system", "tool", "support", "staff")
#: Fixed value: episodes that one request reads of a subject.
REQUEST_CAP = 500
SESSION = (*SUBJECT, "session_id")


def session_firsts(episodes: DataFrame, users: tuple[str, ...], agents: tuple[str, ...], fallback: bool) -> DataFrame:
    """Per session: first_user, first_agent at or after it, first and last episode.

    With `fallback`, a session without a user has its first agent's time.
    """
    rows = episodes.where(F.coalesce(F.col("session_id") != "", F.lit(False)))
    user_at = F.when(F.col("source").isin(*users), F.col("created_at"))
    rows = rows.withColumn("_first_user", F.min(user_at).over(Window.partitionBy(*SESSION)))
    answered = F.col("created_at") >= F.col("_first_user")
    if fallback:
        answered = answered | F.col("_first_user").isNull()
    agent_at = F.when(F.col("source").isin(*agents) & answered, F.col("created_at"))
    return rows.groupBy(*SESSION).agg(
        F.min(user_at).alias("first_user"),
        F.min(agent_at).alias("first_agent"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.count("*").alias("episodes"),
    )


def session_sla(
    episodes: DataFrame,
    resolutions: DataFrame,
    as_of: str,
    first_response: float = 300.0,
    resolution: float = 86_400.0,
    episode_cap: int | None = None,
) -> DataFrame:
    """Response and resolution figures of every session, from all episodes, or from a subject's oldest ones up to a cap
    (REQUEST_CAP is that of a single request)."""
    capped = per_subject_cap(episodes, episode_cap, F.col("created_at"), F.col("episode_id"))
    s = session_firsts(capped, USER_SOURCES, AGENT_SOURCES, fallback=True)
    # Of several states of a session the one updated first holds.
    oldest = resolutions.groupBy(*SESSION).agg(
        F.min_by(F.struct("status", "resolved_at"), F.struct("updated_at", "resolution_id")).alias("_r")
    )
    s = join_on(s, oldest.select(*SESSION, "_r.*"), SESSION)
    answer = F.when(F.col("first_user").isNotNull(), seconds_between(F.col("first_agent"), F.col("first_user")))
    solved = F.when(F.col("first_user").isNotNull() & F.col("resolved_at").isNotNull(), F.col("resolved_at"))
    took = seconds_between(solved, F.col("first_user"))
    waits = seconds_between(F.lit(as_of).cast("timestamp"), F.col("first_user"))
    return s.select(
        *SESSION,
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("first_user", "first_at").alias("first_message_at"),
        F.col("first_agent").alias("first_response_at"),
        solved.alias("resolved_at"),
        answer.alias("first_response_seconds"),
        F.coalesce(answer > first_response, F.lit(False)).alias("first_response_breached"),
        took.alias("resolution_seconds"),
        F.coalesce(took > resolution, F.lit(False)).alias("resolution_breached"),
        F.when((F.col("status") == "open") & F.col("first_user").isNotNull(), waits).alias("open_duration_seconds"),
    )


def subject_sla(sessions: DataFrame) -> DataFrame:
    """Totals and means of session_sla by subject; a mean over nothing is null."""
    n = lambda c: F.count_if(c)
    return sessions.groupBy(*SUBJECT).agg(
        F.count("*").alias("total_sessions"),
        n(F.col("status") == "resolved").alias("resolved_sessions"),
        n(F.col("status") == "open").alias("open_sessions"),
        F.avg("first_response_seconds").alias("avg_first_response_seconds"),
        F.avg("resolution_seconds").alias("avg_resolution_seconds"),
        n(F.col("first_response_breached")).alias("first_response_breach_count"),
        n(F.col("resolution_breached")).alias("resolution_breach_count"),
    )
