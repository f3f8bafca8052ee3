"""Overviews, usage, browsing, timelines and lineage over all subjects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.operators.asof import count_before, last_before
from recollect.operators.common import SUBJECT, join_on, page, per_subject_cap, tenant_scope, visible_subjects
from recollect.operators.health import health_signals, subject_health
from recollect.operators.sla import SESSION
from recollect.sources.scratch import materialize, settled


def subject_overview(episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """Every (tenant, subject) with its numbers of episodes and memories, counted in one pass over both."""
    e = episodes.select(*SUBJECT, F.lit(1).alias("e"), F.lit(0).alias("m"))
    rows = visible_subjects(e.unionAll(memories.select(*SUBJECT, F.lit(0), F.lit(1))))
    return rows.groupBy(*SUBJECT).agg(F.sum("e").alias("episode_count"), F.sum("m").alias("memory_count"))


def subject_explorer(
    episodes: DataFrame, memories: DataFrame, resolutions: DataFrame, health_cache: DataFrame, tenant_id: str | None = None
) -> DataFrame:
    """(tenant, subject) with counts, last activity, sessions, open sessions and last health; of one tenant where given."""
    out = visible_subjects(tenant_scope(episodes, tenant_id)).groupBy(*SUBJECT).agg(
        F.count("*").alias("episode_count"), F.max("created_at").alias("last_activity"), F.count_distinct("session_id").alias("session_count")
    )
    m = memories.groupBy(*SUBJECT).agg(F.count("*").alias("memory_count"))
    o = resolutions.where("status = 'open'").groupBy(*SUBJECT).agg(F.count("*").alias("open_sessions"))
    h = health_cache.select(*SUBJECT, F.col("last_state").alias("health_state"), F.col("last_score").alias("health_score"))
    for other in (m, o, h):
        out = join_on(out, other, SUBJECT)
    return out.fillna(0, ["memory_count", "open_sessions"])


def with_health(rows: DataFrame, episodes: DataFrame, resolutions: DataFrame, as_of: str) -> DataFrame:
    """A page of the explorer with the health computed of those subjects that the cache lacked."""
    lacking = rows.where("health_state IS NULL").select(*SUBJECT)
    signals = health_signals(join_on(episodes, lacking, SUBJECT, "left_semi"), join_on(resolutions, lacking, SUBJECT, "left_semi"), as_of)
    made = subject_health(signals).select(*SUBJECT, F.col("state").alias("_state"), F.col("score").alias("_score"))
    out = join_on(rows, made, SUBJECT)
    return out.withColumns({
        "health_state": F.coalesce("health_state", "_state"), "health_score": F.coalesce("health_score", "_score"),
    }).drop("_state", "_score")


def explore_page(
    rows: DataFrame, search: str | None = None, health_state: str | None = None, has_open: bool | None = None,
    sort: str = "last_activity", descending: bool = True, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of the explorer: filters, one of its sort fields (nulls last), total."""
    if search:
        rows = rows.where(F.col("subject_id").ilike(f"%{search}%"))
    if health_state:
        rows = rows.where(F.col("health_state") == health_state)
    if has_open is not None:
        rows = rows.where((F.col("open_sessions") > 0) == has_open)
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return page(rows, [key, F.col("subject_id"), F.col("tenant_id")], limit, offset)


def subject_detail(episodes: DataFrame, memories: DataFrame, resolutions: DataFrame) -> DataFrame:
    e = episodes.groupBy(*SUBJECT).agg(
        F.count("*").alias("episode_count"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.count_distinct("session_id").alias("_es"),
    )
    m = memories.groupBy(*SUBJECT).agg(
        F.count("*").alias("memory_count"), F.count_if(F.col("status") == "active").alias("active_memories")
    )
    r = resolutions.groupBy(*SUBJECT).agg(F.count_distinct("session_id").alias("_rs"))
    out = e.select(*SUBJECT).union(m.select(*SUBJECT)).distinct()
    for other in (e, m, r):
        out = join_on(out, other, SUBJECT)
    out = out.fillna(0, ["episode_count", "memory_count", "active_memories", "_es", "_rs"])
    return out.withColumn("session_count", F.greatest("_es", "_rs")).drop("_es", "_rs")


def usage_metering(tables: Mapping[str, DataFrame], as_of: str) -> DataFrame:
    """(metric, today, last_7d, last_30d, total): rows of each table by age, and subjects active then.

    A subject id that several tenants use is one active subject here, as in dashboard_counts.
    """
    now = F.lit(as_of).cast("timestamp")
    cuts = {"today": F.date_trunc("day", now), "last_7d": now - F.expr("INTERVAL '7' DAY"), "last_30d": now - F.expr("INTERVAL '30' DAY")}

    def counts(df: DataFrame, at: str, metric: str) -> DataFrame:
        parts = [F.count_if(F.col(at) >= cut).alias(name) for name, cut in cuts.items()]
        return df.agg(*parts, F.count("*").alias("total")).select(F.lit(metric).alias("metric"), "*")

    out = [counts(df, "created_at", name) for name, df in tables.items()]
    last = tables["episodes"].groupBy("subject_id").agg(F.max("created_at").alias("last_at"))
    out.append(counts(last, "last_at", "active_subjects"))
    result = out[0]
    for other in out[1:]:
        result = result.unionAll(other)
    return result


def dashboard_counts(episodes: DataFrame, memories: DataFrame) -> DataFrame:
    e = episodes.agg(F.count("*").alias("episodes"))
    m = memories.agg(F.count("*").alias("memories"))
    subjects = episodes.select("subject_id").union(memories.select("subject_id")).agg(F.count_distinct("subject_id").alias("subjects"))
    return e.crossJoin(m).crossJoin(subjects)  # one row each


def tenant_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, without_tenant) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows"), F.count_if(F.col("tenant_id").isNull()).alias("without_tenant"))
        one = one.select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionAll(one)
    return out


def distinct_tenants(*tables: DataFrame) -> DataFrame:
    rows = tables[0].select("tenant_id")
    for t in tables[1:]:
        rows = rows.union(t.select("tenant_id"))
    return rows.where("tenant_id IS NOT NULL").distinct()


def count_by(df: DataFrame, column: str, values: tuple[str, ...] = ()) -> DataFrame:
    """Rows by a column's value; the given values are there even if nothing has them."""
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    if not values:
        return found
    want = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(want).join(found, column, "full_outer").fillna(0, ["n"])


def _any_like(search: str, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(n).ilike(f"%{search}%"), F.lit(False))
    return out


def browse_memories(
    memories: DataFrame, status: str | None = None, kind: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    rows = memories
    for name, value in (("status", status), ("kind", kind)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    if search:
        rows = rows.where(_any_like(search, "content", "summary", "kind"))
    return page(rows, [F.desc("created_at"), F.col("memory_id")], limit, offset)


def browse_episodes(
    episodes: DataFrame, session: str | None = None, type_: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    rows = episodes
    for name, value in (("session_id", session), ("type", type_)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    if search:
        rows = rows.where(_any_like(search, "payload", "type", "source", "session_id"))
    return page(rows, [F.desc("created_at"), F.col("episode_id")], limit, offset)


def list_log(df: DataFrame, id_column: str, limit: int, offset: int = 0, **equal: str) -> DataFrame:
    """A page of a job or event log, newest first, with the total."""
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return page(df, [F.desc("created_at"), F.col(id_column)], limit, offset)


def subject_timeline(episodes: DataFrame, memories: DataFrame, cap: int | None = 100) -> DataFrame:
    """Episodes and memories of every subject in one time order, the oldest `cap` of each."""
    e = per_subject_cap(episodes, cap, F.col("created_at"), F.col("episode_id"))
    m = per_subject_cap(memories, cap, F.col("created_at"), F.col("memory_id"))
    e = e.select(*SUBJECT, F.lit("episode").alias("item"), F.col("episode_id").alias("item_id"), F.col("type").alias("label"), "created_at")
    m = m.select(*SUBJECT, F.lit("memory").alias("item"), F.col("memory_id").alias("item_id"), F.col("kind").alias("label"), "created_at")
    rows = e.unionByName(m)
    order = Window.partitionBy(*SUBJECT).orderBy("created_at", "item", "item_id")
    return rows.withColumn("position", F.row_number().over(order))


EPISODE = (*SUBJECT, "episode_id")


def cited(memories: DataFrame) -> DataFrame:
    """(tenant_id, subject_id, episode_id, memory_id, kind, status): each memory with each distinct episode it cites."""
    one = F.explode(F.array_distinct("source_episode_ids"))
    return memories.select(*SUBJECT, one.alias("episode_id"), "memory_id", "kind", "status", F.col("created_at").alias("cited_at"))


def citing_memories(episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories of the same tenant and subject that cite an episode."""
    return join_on(episodes.select(*EPISODE), cited(memories), EPISODE, "inner")


def citing_counts(episodes: DataFrame, memories: DataFrame) -> DataFrame:
    n = cited(memories).groupBy(*EPISODE).agg(F.count("*").alias("citing"))
    return join_on(episodes.select(*EPISODE, "session_id", "created_at"), n, EPISODE).fillna(0, ["citing"])


def session_timeline(episodes: DataFrame, memories: DataFrame, resolutions: DataFrame, sla: DataFrame | None = None) -> DataFrame:
    """Episodes of every session, with how often they are cited, and the session's resolution, in order.

    With sla (a row a session, as session_sla gives it) each row carries its session's status and response
    figures too; a session without them is resolved if it has a resolution, else open.
    """
    e = citing_counts(episodes.where("session_id IS NOT NULL"), memories)
    e = e.select(*SESSION, F.col("created_at").alias("at"), F.lit(0).alias("is_resolution"), F.col("episode_id").alias("item_id"), "citing")
    r = resolutions.where("resolved_at IS NOT NULL").select(
        *SESSION, F.col("resolved_at").alias("at"), F.lit(1).alias("is_resolution"), F.col("resolution_id").alias("item_id"), F.lit(0).cast("long").alias("citing"),
    )
    order = Window.partitionBy(*SESSION).orderBy("at", "is_resolution", "item_id")
    rows = e.unionByName(r).withColumn("position", F.row_number().over(order))
    if sla is None:
        return rows
    figures = ["first_response_seconds", "resolution_seconds", "first_response_breached", "resolution_breached"]
    known = resolutions.groupBy(*SESSION).agg(F.lit("resolved").alias("_known"))
    rows = join_on(join_on(rows, sla.select(*SESSION, "status", *figures), SESSION), known, SESSION)
    rows = rows.fillna(False, ["first_response_breached", "resolution_breached"])
    return rows.withColumn("status", F.coalesce("status", "_known", F.lit("open"))).drop("_known")


def provenance_lookup(episodes: DataFrame, ids: DataFrame) -> DataFrame:
    return episodes.join(ids.select("episode_id").distinct(), "episode_id", "left_semi")


LINE = (*SUBJECT, "kind")


def lineage_superseder(memories: DataFrame) -> DataFrame:
    """For each superseded memory with sources: the next active memory of its subject and kind.

    A subject's line is read backwards in range partitions, so a hot one is spread over tasks.
    """
    active = F.col("status") == "active"
    rows = memories.where(active | ((F.col("status") == "superseded") & (F.size("source_episode_ids") > 0)))
    rows = rows.select(*LINE, "created_at", "memory_id", active.alias("active"))
    # Of one time the superseded ones come first, since what is of their time isn't later; then the active ones, the least id last.
    order = [F.desc("created_at"), F.col("active"), F.desc("memory_id")]
    out = last_before(rows, list(LINE), order, F.when(F.col("active"), F.col("memory_id")), "lineage-line")
    return out.where("NOT active AND found IS NOT NULL").select("memory_id", F.col("found").alias("superseding_id"))


def lineage_superseded(memories: DataFrame, n: int = 5) -> DataFrame:
    """For each active memory: the n latest superseded ones before it, of its subject and kind.

    Superseded memories are numbered along their line, in range partitions; an active one with c of them before it looks up
    the numbers c, c - 1, ..., so no pair of rows meets otherwise and a hot subject is spread over tasks.
    """
    gone = F.col("status") == "superseded"
    rows = memories.where("status IN ('active', 'superseded')").select(*LINE, "created_at", "memory_id", gone.alias("gone"))
    # Of one time the active ones come first: what is of their time isn't earlier.
    order = [F.col("created_at"), F.col("gone"), F.col("memory_id")]
    placed = materialize(count_before(rows, list(LINE), order, F.col("gone"), "lineage-count"), "lineage-placed")
    numbered = placed.where("gone").select(*LINE, (F.col("found") + 1).alias("_k"), F.col("memory_id").alias("superseded_id"))
    asks = placed.where("NOT gone AND found > 0")
    asks = asks.withColumn("_k", F.explode(F.sequence(F.col("found"), F.greatest(F.col("found") - (n - 1), F.lit(1)), F.lit(-1).cast("long"))))
    out = join_on(asks, numbered, (*LINE, "_k"), "inner")
    return out.select("memory_id", (F.col("found") - F.col("_k") + 1).cast("int").alias("rank"), "superseded_id")


def lineage_siblings(memories: DataFrame, sources: int = 5, n: int = 10) -> DataFrame:
    """For each memory: the newest n others that share one of its first sources, without its lineage.

    Of each episode only the newest n + 1 citing memories can be among a memory's newest n, so
    an episode that many memories cite does not meet itself pairwise.
    """
    at = F.struct("created_at", "memory_id")
    all_ = memories.select(*SUBJECT, F.explode(F.array_distinct("source_episode_ids")).alias("e"), at.alias("m"))
    newest = all_.groupBy(*SUBJECT, "e").agg(F.slice(F.sort_array(F.collect_list("m"), asc=False), 1, n + 1).alias("ms"))
    mine = memories.select(*SUBJECT, "memory_id", F.explode(F.array_distinct(F.slice("source_episode_ids", 1, sources))).alias("e"))
    pairs = join_on(mine, newest, (*SUBJECT, "e"), "inner").select("memory_id", F.explode("ms").alias("m"))
    pairs = pairs.where("m.memory_id <> memory_id").distinct()
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("m")))
    top = pairs.withColumn("rank", rank).where(F.col("rank") <= n).select("memory_id", "rank", F.col("m.memory_id").alias("sibling_id"))
    spark = memories.sparkSession
    top = materialize(top, "siblings")
    up = settled(spark, lambda: lineage_superseder(memories).select("memory_id", F.col("superseding_id").alias("sibling_id")), "siblings-up")
    down = settled(spark, lambda: lineage_superseded(memories).select("memory_id", F.col("superseded_id").alias("sibling_id")), "siblings-down")
    return top.join(up.union(down), ["memory_id", "sibling_id"], "left_anti")


def stale_subjects(episodes: DataFrame, prefix: str, as_of: str, max_age_days: int) -> DataFrame:
    """Subjects of a prefix whose newest episode is older than the age; snapshots never."""
    rows = episodes.where(F.col("subject_id").startswith(prefix) & ~F.col("subject_id").startswith("_snapshot/"))
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{int(max_age_days)}' DAY")
    return rows.groupBy(*SUBJECT).agg(F.max("created_at").alias("last_at")).where(F.col("last_at") < cut)


def match_subjects(
    episodes: DataFrame, memories: DataFrame, as_of: str, prefix: str | None = None, older_than_days: int | None = None,
    tenant_id: str | None = None, match_all: bool = False,
) -> DataFrame:
    """Subjects (tenant and id) that a bulk deletion would take, with their counts. A filter is needed unless all are meant."""
    if prefix is None and older_than_days is None and tenant_id is None and not match_all:
        raise ValueError("a filter is required")
    rows = visible_subjects(episodes)
    rows = rows if tenant_id is None else rows.where(F.col("tenant_id") == tenant_id)
    rows = rows if prefix is None else rows.where(F.col("subject_id").startswith(prefix))
    found = rows.groupBy(*SUBJECT).agg(F.max("created_at").alias("last_at"), F.count("*").alias("episode_count"))
    if older_than_days is not None:
        cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{int(older_than_days)}' DAY")
        found = found.where(F.col("last_at") < cut)
    m = memories.groupBy(*SUBJECT).agg(F.count("*").alias("memory_count"))
    return join_on(found, m, SUBJECT).fillna(0, ["memory_count"])
