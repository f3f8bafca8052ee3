"""Queries over subjects, logs, timelines and lineage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import stamp
from recollect.operators import explore, health, sla
from recollect.operators.compile import compile_memories, uncompiled
from recollect.operators.conflicts import resolve_conflicts
from recollect.plans.support import _H, _LOST, _M, _SESSIONS, MEMORIES, _cache, _t
from recollect.sources.adapters import AS_OF, episodes, jobs, oracle_ctes, outbox, resolutions
from recollect.sources.scratch import materialize, settled


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled memories after conflicts, with a source episode more for every other one, in the columns that timelines and lineage read."""
    return settled(spark, lambda: _resolve(spark, sf_dir), "resolved")  # lineage reads it several times


def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve_conflicts(_memories(spark, sf_dir), AS_OF)
    event = F.substring(F.element_at("source_episode_ids", 1), 4, 20).cast("long")
    more = F.concat(F.lit("ev-"), (event - event % 8).cast("string"))
    rows = rows.withColumn("source_episode_ids", F.when(event % 2 == 0, F.array_append("source_episode_ids", more)).otherwise(F.col("source_episode_ids")))
    return rows.select("memory_id", "tenant_id", "subject_id", "kind", "status", "created_at", "source_episode_ids")


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_memories(uncompiled(episodes(spark, sf_dir), cap=None))


def _health_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = health.subject_health(health.health_signals(episodes(spark, sf_dir), resolutions(spark, sf_dir), AS_OF))
    return _cache(rows)


def subject_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.subject_overview(episodes(spark, sf_dir), _memories(spark, sf_dir))


def subject_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page by memories of the subjects with open sessions; subjects that the cache lacks get their health computed."""
    eps, res = episodes(spark, sf_dir), resolutions(spark, sf_dir)
    rows = explore.subject_explorer(eps, _memories(spark, sf_dir), res, _health_cache(spark, sf_dir))
    page = materialize(explore.explore_page(rows, has_open=True, sort="memory_count", limit=40, offset=5), "explorer-page")
    return explore.with_health(page, eps, res, AS_OF).withColumn("last_activity", stamp(F.col("last_activity")))


def subject_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.subject_detail(episodes(spark, sf_dir), _memories(spark, sf_dir), resolutions(spark, sf_dir))
    return rows.withColumns({"first_at": stamp(F.col("first_at")), "last_at": stamp(F.col("last_at"))})


def usage_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"episodes": episodes(spark, sf_dir), "memories": _memories(spark, sf_dir), "jobs": jobs(spark, sf_dir), "outbox": outbox(spark, sf_dir)}
    return explore.usage_metering(tables, "2024-01-15 12:00:00")


def tenant_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.tenant_audit({"episodes": episodes(spark, sf_dir), "memories": _memories(spark, sf_dir), "jobs": jobs(spark, sf_dir)})


def distinct_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.distinct_tenants(episodes(spark, sf_dir), jobs(spark, sf_dir))


def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.dashboard_counts(episodes(spark, sf_dir), _memories(spark, sf_dir))


def browse_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.browse_memories(_memories(spark, sf_dir), status="active", kind="profile_fact", search="COMPANY", limit=50, offset=10)
    return rows.select("memory_id", "content", stamp(F.col("created_at")).alias("created_at"), "total")


def browse_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.browse_episodes(episodes(spark, sf_dir), type_="message", search="outage", limit=50)
    return rows.select("episode_id", "session_id", stamp(F.col("created_at")).alias("created_at"), "total")


def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_by(jobs(spark, sf_dir), "status")


def outbox_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.count_by(outbox(spark, sf_dir), "status", ("pending", "delivered", "dead_letter", "expired"))


def list_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.list_log(jobs(spark, sf_dir), "job_id", 50, status="failed").select("job_id", "subject_id", stamp(F.col("created_at")).alias("created_at"), "total")


def list_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.list_log(outbox(spark, sf_dir), "event_id", 50, 20, status="dead_letter", event="memory.created")
    return rows.select("event_id", "attempts", stamp(F.col("created_at")).alias("created_at"), "total")


def subject_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.subject_timeline(episodes(spark, sf_dir), _memories(spark, sf_dir))
    return rows.withColumn("created_at", stamp(F.col("created_at")))


def session_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps, res = episodes(spark, sf_dir), resolutions(spark, sf_dir)
    rows = explore.session_timeline(eps, _resolved(spark, sf_dir), res, sla.session_sla(eps, res, AS_OF))
    return rows.withColumns({"at": stamp(F.col("at")), **{n: F.round(n, 3) for n in ("first_response_seconds", "resolution_seconds")}})


def citing_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.citing_memories(episodes(spark, sf_dir), _resolved(spark, sf_dir))
    return rows.select("tenant_id", "subject_id", "episode_id", "memory_id", "kind", "status")


def citing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.citing_counts(episodes(spark, sf_dir), _resolved(spark, sf_dir)).select("tenant_id", "subject_id", "episode_id", "citing")


def lineage_superseder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.lineage_superseder(_resolved(spark, sf_dir))


def lineage_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.lineage_superseded(_resolved(spark, sf_dir))


def lineage_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.lineage_siblings(_resolved(spark, sf_dir))


def stale_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.stale_subjects(episodes(spark, sf_dir), "user-1", "2024-02-02 22:00:00", 3)
    return rows.withColumn("last_at", stamp(F.col("last_at")))


def match_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explore.match_subjects(episodes(spark, sf_dir), _memories(spark, sf_dir), AS_OF, prefix="user-1", tenant_id="acme")
    return rows.withColumn("last_at", stamp(F.col("last_at")))


_E = oracle_ctes("episodes")
_LOGS = oracle_ctes("episodes", "jobs", "outbox") + ", " + MEMORIES
_CITED = f"""{oracle_ctes("episodes", "resolutions")}, {MEMORIES}, {_LOST}, rm AS (SELECT m.* EXCLUDE (episode_id), CASE WHEN nx IS NULL THEN 'active' ELSE 'superseded' END AS status, m.created_at,
    CASE WHEN ev % 2 = 0 THEN ['ev-' || ev, 'ev-' || (ev - ev % 8)] ELSE ['ev-' || ev] END AS sources
    FROM (SELECT *, CAST(substr(episode_id, 4) AS BIGINT) AS ev FROM m) m LEFT JOIN lost USING (memory_id)),
  cited AS (SELECT tenant_id, subject_id, sk, unnest(list_distinct(sources)) AS episode_id, memory_id, kind, status, created_at FROM rm)"""
_COUNTS = """cc AS (SELECT e.tenant_id, e.subject_id, e.sk, e.episode_id, e.session_id, e.created_at, count(c.memory_id) AS citing FROM episodes e LEFT JOIN cited c USING (sk, episode_id) GROUP BY ALL)"""
_LINE = """sup AS (SELECT o.memory_id, arg_min(a.memory_id, (a.created_at, a.memory_id)) AS superseding_id FROM rm o JOIN rm a ON o.sk = a.sk AND o.kind = a.kind
    AND o.status = 'superseded' AND a.status = 'active' AND a.created_at > o.created_at GROUP BY ALL),
  gone AS (SELECT * FROM (SELECT a.memory_id, row_number() OVER (PARTITION BY a.memory_id ORDER BY o.created_at DESC, o.memory_id DESC) AS rank, o.memory_id AS superseded_id
    FROM rm a JOIN rm o ON o.sk = a.sk AND o.kind = a.kind AND o.status = 'superseded' AND a.status = 'active' AND o.created_at < a.created_at) WHERE rank <= 5)"""

QUERIES = {
    f.__name__: f
    for f in (
        subject_overview, subject_explorer, subject_detail, usage_metering, tenant_audit, distinct_tenants, dashboard_counts, browse_memories,
        browse_episodes, jobs_by_status, outbox_by_status, list_jobs, list_outbox, subject_timeline, session_timeline, citing_memories,
        citing_counts, lineage_superseder, lineage_superseded, lineage_siblings, stale_subjects, match_subjects,
    )
}
ORACLES = {
    "subject_overview": f"""{_M}, e AS (SELECT tenant_id, subject_id, sk, count(*) AS n FROM episodes GROUP BY ALL), mm AS (SELECT sk, count(*) AS n FROM m GROUP BY ALL)
      SELECT tenant_id, subject_id, e.n AS episode_count, coalesce(mm.n, 0) AS memory_count FROM e LEFT JOIN mm USING (sk)""",
    "subject_explorer": f"""{_H}, {MEMORIES}, e AS (SELECT tenant_id, subject_id, sk, count(*) AS episode_count, max(created_at) AS last_activity, count(DISTINCT session_id) AS session_count FROM episodes GROUP BY ALL),
      mm AS (SELECT sk, count(*) AS n FROM m GROUP BY ALL), o AS (SELECT sk, count(*) AS n FROM resolutions WHERE status = 'open' GROUP BY ALL),
      x AS (SELECT e.subject_id, e.tenant_id, episode_count, {_t("last_activity")} AS last_activity, coalesce(mm.n, 0) AS memory_count, session_count, coalesce(o.n, 0) AS open_sessions,
        coalesce(cache.last_state, h.state) AS health_state, CASE WHEN cache.last_state IS NOT NULL THEN 50 ELSE h.score END AS health_score FROM e LEFT JOIN mm USING (sk) LEFT JOIN o USING (sk) LEFT JOIN cache USING (sk) LEFT JOIN h USING (sk))
      SELECT *, count(*) OVER () AS total FROM x WHERE open_sessions > 0 ORDER BY memory_count DESC, subject_id, tenant_id LIMIT 40 OFFSET 5""",
    "subject_detail": f"""{oracle_ctes("episodes", "resolutions")}, {MEMORIES}, e AS (SELECT tenant_id, subject_id, sk, count(*) AS episode_count, min(created_at) AS lo, max(created_at) AS hi, count(DISTINCT session_id) AS s FROM episodes GROUP BY ALL),
      mm AS (SELECT sk, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT sk, count(DISTINCT session_id) AS s FROM resolutions GROUP BY ALL)
      SELECT tenant_id, subject_id, episode_count, {_t("lo")} AS first_at, {_t("hi")} AS last_at, coalesce(n, 0) AS memory_count, coalesce(n, 0) AS active_memories, greatest(e.s, coalesce(r.s, 0)) AS session_count
      FROM e LEFT JOIN mm USING (sk) LEFT JOIN r USING (sk)""",
    "usage_metering": f"""{_LOGS}, a AS (SELECT 'episodes' AS metric, created_at FROM episodes UNION ALL SELECT 'memories', created_at FROM m UNION ALL SELECT 'jobs', created_at FROM jobs
      UNION ALL SELECT 'outbox', created_at FROM outbox UNION ALL SELECT 'active_subjects', max(created_at) FROM episodes GROUP BY subject_id)
      SELECT metric, count(*) FILTER (created_at >= TIMESTAMP '2024-01-15') AS today, count(*) FILTER (created_at >= TIMESTAMP '2024-01-08 12:00:00') AS last_7d,
      count(*) FILTER (created_at >= TIMESTAMP '2023-12-16 12:00:00') AS last_30d, count(*) AS total FROM a GROUP BY ALL""",
    "tenant_audit": f"""{_LOGS} SELECT t AS table_name, count(*) AS n_rows, count(*) FILTER (tenant_id IS NULL) AS without_tenant FROM (SELECT 'episodes' AS t, tenant_id FROM episodes
      UNION ALL SELECT 'memories', tenant_id FROM m UNION ALL SELECT 'jobs', tenant_id FROM jobs) GROUP BY ALL""",
    "distinct_tenants": f"{_LOGS} SELECT DISTINCT tenant_id FROM (SELECT tenant_id FROM episodes UNION SELECT tenant_id FROM jobs) WHERE tenant_id IS NOT NULL",
    "dashboard_counts": f"{_M} SELECT (SELECT count(*) FROM episodes) AS episodes, (SELECT count(*) FROM m) AS memories, (SELECT count(DISTINCT subject_id) FROM episodes) AS subjects",
    "browse_memories": f"""{_M} SELECT memory_id, content, {_t("created_at")} AS created_at, count(*) OVER () AS total FROM m WHERE kind = 'profile_fact' AND content ILIKE '%COMPANY%'
      ORDER BY m.created_at DESC, memory_id LIMIT 50 OFFSET 10""",
    "browse_episodes": f"""{_E} SELECT episode_id, session_id, {_t("created_at")} AS created_at, count(*) OVER () AS total FROM episodes WHERE type = 'message' AND payload ILIKE '%outage%'
      ORDER BY episodes.created_at DESC, episode_id LIMIT 50""",
    "jobs_by_status": f"{_LOGS} SELECT status, count(*) AS n FROM jobs GROUP BY ALL",
    "outbox_by_status": f"""{_LOGS} SELECT status, count(event_id) AS n FROM (SELECT unnest(['pending', 'delivered', 'dead_letter', 'expired']) AS status) LEFT JOIN outbox USING (status) GROUP BY ALL""",
    "list_jobs": f"""{_LOGS} SELECT job_id, subject_id, {_t("created_at")} AS created_at, count(*) OVER () AS total FROM jobs WHERE status = 'failed' ORDER BY jobs.created_at DESC, job_id LIMIT 50""",
    "list_outbox": f"""{_LOGS} SELECT event_id, attempts, {_t("created_at")} AS created_at, count(*) OVER () AS total FROM outbox WHERE status = 'dead_letter' AND event = 'memory.created'
      ORDER BY outbox.created_at DESC, event_id LIMIT 50 OFFSET 20""",
    "subject_timeline": f"""{_M}, u AS (SELECT tenant_id, subject_id, 'episode' AS item, episode_id AS item_id, type AS label, created_at FROM episodes
      UNION ALL SELECT tenant_id, subject_id, 'memory', memory_id, kind, created_at FROM m),
      c AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id, item ORDER BY created_at, item_id) AS rn FROM u)
      SELECT tenant_id, subject_id, item, item_id, label, {_t("created_at")} AS created_at, CAST(row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY c.created_at, item, item_id) AS INT) AS position FROM c WHERE rn <= 100""",
    "session_timeline": f"""{_CITED}, {_COUNTS}, {_SESSIONS}, u AS (SELECT tenant_id, subject_id, sk, session_id, created_at AS "at", 0 AS is_resolution, episode_id AS item_id, citing FROM cc WHERE session_id IS NOT NULL
      UNION ALL SELECT tenant_id, subject_id, sk, session_id, resolved_at, 1, resolution_id, 0 FROM resolutions WHERE resolved_at IS NOT NULL)
      SELECT u.tenant_id, u.subject_id, u.session_id, {_t('u."at"')} AS "at", is_resolution, item_id, citing, CAST(row_number() OVER (PARTITION BY u.sk, u.session_id ORDER BY u."at", is_resolution, item_id) AS INT) AS position,
        coalesce(s.status, 'open') AS status, round(frs, 3) AS first_response_seconds, round(rs, 3) AS resolution_seconds, coalesce(frs > 300, false) AS first_response_breached, coalesce(rs > 86400, false) AS resolution_breached
      FROM u LEFT JOIN s ON s.session_id = u.session_id AND concat(coalesce(s.tenant_id, ''), '/', s.subject_id) = u.sk""",
    "citing_memories": f"{_CITED} SELECT c.tenant_id, c.subject_id, c.episode_id, memory_id, kind, status FROM cited c JOIN episodes e USING (sk, episode_id)",
    "citing_counts": f"{_CITED}, {_COUNTS} SELECT tenant_id, subject_id, episode_id, citing FROM cc",
    "lineage_superseder": f"{_CITED}, {_LINE} SELECT * FROM sup",
    "lineage_superseded": f"{_CITED}, {_LINE} SELECT memory_id, CAST(rank AS INT) AS rank, superseded_id FROM gone",
    "lineage_siblings": f"""{_CITED}, {_LINE}, p AS (SELECT DISTINCT a.memory_id, b.memory_id AS sibling_id, b.created_at FROM cited a JOIN cited b ON a.sk = b.sk AND a.episode_id = b.episode_id AND a.memory_id <> b.memory_id),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, sibling_id DESC) AS INT) AS rank FROM p)
      SELECT memory_id, rank, sibling_id FROM r WHERE rank <= 10 AND (memory_id, sibling_id) NOT IN (SELECT (memory_id, superseding_id) FROM sup UNION ALL SELECT (memory_id, superseded_id) FROM gone)""",
    "stale_subjects": f"""{_E} SELECT tenant_id, subject_id, {_t("max(created_at)")} AS last_at FROM episodes WHERE starts_with(subject_id, 'user-1') GROUP BY tenant_id, subject_id HAVING max(created_at) < TIMESTAMP '2024-01-30 22:00:00'""",
    "match_subjects": f"""{_M}, f AS (SELECT tenant_id, subject_id, sk, max(created_at) AS hi FROM episodes WHERE tenant_id = 'acme' AND starts_with(subject_id, 'user-1') GROUP BY ALL)
      SELECT tenant_id, subject_id, {_t("hi")} AS last_at, (SELECT count(*) FROM episodes e WHERE e.sk = f.sk) AS episode_count, (SELECT count(*) FROM m WHERE m.sk = f.sk) AS memory_count FROM f""",
}
