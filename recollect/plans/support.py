"""Queries over response times, health, compiled memories and conflicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import payload_text, stamp
from recollect.operators import compile as comp
from recollect.operators import conflict_index, conflicts, health, sla
from recollect.sources.adapters import AS_OF, episodes, oracle_ctes, resolutions
from recollect.sources.scratch import materialize, scratch

#: What the capped queries read of a subject.
CAP = 12


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 3) for n in names})


def session_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sla.session_sla(episodes(spark, sf_dir), resolutions(spark, sf_dir), AS_OF)
    rows = rows.withColumns({n: stamp(F.col(n)) for n in ("first_message_at", "first_response_at", "resolved_at")})
    return _round(rows, "first_response_seconds", "resolution_seconds", "open_duration_seconds")


def session_sla_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a single request sees it: a subject's oldest episodes only. The cap is lowered so that the test tables meet it."""
    rows = sla.session_sla(episodes(spark, sf_dir), resolutions(spark, sf_dir), AS_OF, episode_cap=CAP)
    rows = rows.select("tenant_id", "subject_id", "session_id", "status", stamp(F.col("first_message_at")).alias("first_message_at"), "first_response_seconds")
    return _round(rows, "first_response_seconds")


def _subject_sla(spark: SparkSession, sf_dir: str, **limits: float) -> DataFrame:
    rows = sla.subject_sla(sla.session_sla(episodes(spark, sf_dir), resolutions(spark, sf_dir), AS_OF, **limits))
    return _round(rows, "avg_first_response_seconds", "avg_resolution_seconds")


def subject_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject_sla(spark, sf_dir)


def subject_sla_custom_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subject_sla(spark, sf_dir, first_response=3600.0, resolution=7200.0)


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes(spark, sf_dir).select("episode_id", payload_text(F.col("payload")).alias("text"))


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.compile_memories(comp.uncompiled(episodes(spark, sf_dir), cap=None))


def compile_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir)
    return rows.select(
        "memory_id", "tenant_id", "subject_id", "kind", "content", "summary", "confidence", stamp(F.col("valid_from")).alias("valid_from"),
        F.element_at("source_episode_ids", 1).alias("source"), "status",
    )


def compile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memories(spark, sf_dir).where("kind = 'episode_summary'").select("memory_id", "content", "summary")


def compile_profile_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir).where("kind = 'profile_fact'")
    return rows.groupBy("subject_id", "content").agg(F.count("*").alias("n"))


def uncompiled_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comp.uncompiled(episodes(spark, sf_dir), cap=20)
    return rows.groupBy("subject_id").agg(F.count("*").alias("n"), F.max(stamp(F.col("created_at"))).alias("last_at"))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conflicts.superseders(_memories(spark, sf_dir))
    return rows.select("memory_id", "superseded_by", stamp(F.col("valid_to")).alias("valid_to"))


def conflict_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same marks from three batches that come in turn, each against what the ones before left in the index."""
    rows = _memories(spark, sf_dir).select("memory_id", "tenant_id", "subject_id", "kind", "content", "status", "created_at", "valid_from")
    path, rows = scratch(spark, "conflict-index"), materialize(rows, "conflict-memories")
    for batch in range(3):
        conflict_index.add_batch(path, rows.where(F.pmod(F.xxhash64("memory_id"), F.lit(3)) == batch), batch, buckets=8)
    return conflict_index.marks(spark, path, 3).withColumn("valid_to", stamp(F.col("valid_to")))


def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conflicts.resolve_conflicts(materialize(_memories(spark, sf_dir), "conflict-memories"), AS_OF)  # read twice
    return rows.groupBy("subject_id", "kind", "status").agg(F.count("*").alias("n"), F.max(stamp(F.col("valid_to"))).alias("last_valid_to"))


def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comp.pack_prompt_batches(episodes(spark, sf_dir), most=600)
    return rows.groupBy("tenant_id", "subject_id").agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("n"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health_signals(episodes(spark, sf_dir), resolutions(spark, sf_dir), AS_OF)


def health_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir)
    return rows.select(
        "tenant_id", "subject_id", "escalations", "total_sessions", "open_sessions", "resolved_sessions", "recent", "breaches",
        "repeated", F.col("idle.session_id").alias("idle_session"), F.round("response", 3).alias("response"),
    )


def health_signals_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a single request sees it: oldest episodes and latest resolutions only."""
    rows = health.health_signals(episodes(spark, sf_dir), resolutions(spark, sf_dir), AS_OF, episode_cap=CAP, resolution_cap=CAP // 4)
    return rows.select("tenant_id", "subject_id", "escalations", "total_sessions", "open_sessions", "resolved_sessions", "recent", "breaches", "repeated")


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.subject_health(_signals(spark, sf_dir))


def subject_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.transform("factors", lambda x: F.concat(x["signal"], F.lit(":"), x["impact"].cast("string"))), ",")
    return _health(spark, sf_dir).select("tenant_id", "subject_id", "score", "state", names.alias("factors"))


def _cache(health_rows: DataFrame) -> DataFrame:
    """A health cache as an earlier run may have left it: every third subject is missing."""
    n = F.substring("subject_id", 6, 20).cast("long")
    old = F.when(n % 3 == 1, "healthy").otherwise("at_risk")
    return health_rows.where(n % 3 > 0).select("subject_id", "tenant_id", old.alias("last_state"), F.lit(50).alias("last_score"))


def health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _health(spark, sf_dir)
    alerts, _ = health.health_alerts(rows, _cache(rows))
    return alerts.drop("factors")


def health_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _health(spark, sf_dir)
    return health.health_distribution(rows, _cache(rows))


def _t(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"


_SESSIONS = """capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY created_at, episode_id) AS rn
    FROM episodes) WHERE session_id IS NOT NULL),
  fu AS (SELECT *, min(CASE WHEN source IN ('user', 'chat', 'support-chat', 'support_chat', 'customer', 'manual_input') THEN created_at END)
    OVER (PARTITION BY sk, session_id) AS fu FROM capped),
  f AS (SELECT tenant_id, subject_id, sk, session_id, min(fu) AS fu, min(created_at) AS first_at,
    min(CASE WHEN source IN ('assistant', 'agent', 'system', 'tool', 'support', 'staff') AND (fu IS NULL OR created_at >= fu) THEN created_at END) AS fa
    FROM fu GROUP BY ALL),
  s AS (SELECT f.tenant_id, f.subject_id, f.session_id, coalesce(r.status, 'unknown') AS status, coalesce(fu, first_at) AS first_message_at,
    fa AS first_response_at, CASE WHEN fu IS NOT NULL THEN r.resolved_at END AS resolved_at,
    (epoch_us(fa) - epoch_us(fu)) / 1e6 AS frs, (epoch_us(r.resolved_at) - epoch_us(fu)) / 1e6 AS rs,
    CASE WHEN r.status = 'open' THEN (epoch_us(TIMESTAMP '{as_of}') - epoch_us(fu)) / 1e6 END AS od
    FROM f LEFT JOIN resolutions r ON r.session_id = f.session_id AND r.sk = f.sk)""".format(as_of=AS_OF)
_ER = oracle_ctes("episodes", "resolutions")
_SUBJECT_SLA = (
    _ER + ", " + _SESSIONS + """ SELECT tenant_id, subject_id, count(*) AS total_sessions,
  count(*) FILTER (status = 'resolved') AS resolved_sessions, count(*) FILTER (status = 'open') AS open_sessions,
  round(avg(frs), 3) AS avg_first_response_seconds, round(avg(rs), 3) AS avg_resolution_seconds,
  count(*) FILTER (frs > {fr}) AS first_response_breach_count, count(*) FILTER (rs > {res}) AS resolution_breach_count
  FROM s GROUP BY ALL"""
)

TEXTS = """texts AS (SELECT *, CASE WHEN json_exists(payload, '$.messages')
    THEN array_to_string(list_transform(CAST(json_extract(payload, '$.messages') AS JSON[]),
      lambda m: concat(json_extract_string(m, '$.role'), ': ', json_extract_string(m, '$.content'))), chr(10))
    ELSE coalesce(json_extract_string(payload, '$.text'), json_extract_string(payload, '$.content'), '') END AS text FROM episodes)"""

_FACTS = ", ".join(
    f"regexp_extract_all(text, '{p}', 0)"
    for p in (
        r"(?i:my name is|i''m|i am)\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)",
        r"(?i)(?:i work at|i''m at|i am at)\s+(.+?)(?:\.|,|\n|$)",
        r"(?i)(?:i am on|i''m on)\s+(.+?)(?:\.|,|\n|$)",
        r"(?i)(?:i live in|i''m from|i am from)\s+(.+?)(?:\.|,|\n|$)",
        r"(?i)(?:i use|i prefer|my favorite)\s+(.+?)(?:\.|,|\n|$)",
    )
)
MEMORIES = f"""{TEXTS}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY created_at, episode_id) AS rn
    FROM texts) WHERE text <> ''),
  facts AS (SELECT *, unnest(fs) AS fact, generate_subscripts(fs, 1) AS ordinal FROM (SELECT *, flatten([{_FACTS}]) AS fs FROM recent)),
  memories AS (SELECT tenant_id, subject_id, 'episode_summary' AS kind, substr(text, 1, 500) AS content, 0.8::DOUBLE AS confidence,
      created_at, episode_id, 0 AS ordinal FROM recent
    UNION ALL SELECT tenant_id, subject_id, 'profile_fact', regexp_replace(regexp_replace(trim(fact), '\\.+$', ''), ',+$', ''), 0.6::DOUBLE,
      created_at, episode_id, ordinal FROM facts),
  m AS (SELECT *, concat(coalesce(tenant_id, ''), '/', subject_id) AS sk, sha256(concat_ws('|', 'compile', episode_id, kind, ordinal)) AS memory_id FROM memories)"""

_LOST = """tk AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS ws FROM m),
  lost AS (SELECT a.memory_id, arg_min((b.memory_id, b.created_at), (b.created_at, b.memory_id)) AS nx FROM tk a JOIN tk b
    ON a.sk = b.sk AND a.kind = b.kind AND (a.created_at, a.memory_id) < (b.created_at, b.memory_id)
    AND 5 * len(list_intersect(a.ws, b.ws)) >= (CASE a.kind WHEN 'profile_fact' THEN 3 ELSE 4 END) * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))
    GROUP BY a.memory_id)"""

_SIGNALS = """ep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY created_at, episode_id) AS rn FROM episodes)),
  re AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY updated_at DESC, resolution_id) AS rn FROM resolutions)),
  hu AS (SELECT *, min(CASE WHEN source IN ('user', 'chat', 'support-chat') THEN created_at END) OVER (PARTITION BY sk, session_id) AS fu FROM ep WHERE session_id IS NOT NULL),
  hs AS (SELECT sk, session_id, min(fu) AS fu, max(created_at) AS last_at,
    min(CASE WHEN source IN ('assistant', 'agent', 'system', 'tool') AND created_at >= fu THEN created_at END) AS fa FROM hu GROUP BY ALL),
  rs AS (SELECT r.*, fu, fa, last_at, CASE WHEN status = 'open' THEN floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us(last_at)) / 86400e6) END AS idle
    FROM re r LEFT JOIN hs USING (sk, session_id)),
  wd AS (SELECT e.sk, r.status, json_extract_string(m, '$.content') AS c FROM ep e JOIN re r USING (sk, session_id),
    unnest(CAST(json_extract(e.payload, '$.messages') AS JSON[])) AS u(m) WHERE json_exists(e.payload, '$.messages') AND r.status IN ('open', 'resolved')),
  ww AS (SELECT sk, status, unnest(regexp_split_to_array(lower(c), '\\s+')) AS w FROM wd),
  wk AS (SELECT DISTINCT * FROM ww WHERE length(w) > 2 AND w NOT IN ('the','are','was','were','and','for','you','this','that','with')),
  wn AS (SELECT sk, count(DISTINCT w) FILTER (status = 'open') AS o, count(DISTINCT w) FILTER (status = 'resolved') AS r,
    count(*) - count(DISTINCT w) AS b FROM wk GROUP BY sk),
  sg AS (SELECT e.tenant_id, e.subject_id, e.sk, e.escalations, coalesce(total_sessions, 0) AS total_sessions, coalesce(open_sessions, 0) AS open_sessions,
      coalesce(resolved_sessions, 0) AS resolved_sessions, coalesce(recent, 0) AS recent, coalesce(breaches, 0) AS breaches,
      coalesce(b / least(o, r) >= 0.3 AND least(o, r) > 0, false) AS repeated, idle_session, idle_days, response
    FROM (SELECT tenant_id, subject_id, sk, count(*) FILTER (json_exists(payload, '$.messages') AND regexp_matches(lower(json_extract_string(payload, '$.messages[0].content') || ' ' || json_extract_string(payload, '$.messages[1].content')),
        'urgent|critical|asap|emergency|escalat|broken|down|outage|blocker|p0|p1|sev1|sev2')) AS escalations FROM ep GROUP BY ALL) e
    LEFT JOIN (SELECT sk, count(*) AS total_sessions, count(*) FILTER (status = 'open') AS open_sessions, count(*) FILTER (status = 'resolved') AS resolved_sessions,
        count(*) FILTER (status = 'resolved' AND floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us(resolved_at)) / 86400e6) <= 7) AS recent,
        count(*) FILTER (status = 'resolved' AND epoch_us(resolved_at) - epoch_us(fu) > 86400e6) AS breaches,
        arg_max(session_id, updated_at) FILTER (idle >= 7) AS idle_session, CAST(arg_max(idle, updated_at) FILTER (idle >= 7) AS INT) AS idle_days, avg((epoch_us(fa) - epoch_us(fu)) / 1e6) AS response FROM rs GROUP BY ALL) USING (sk)
    LEFT JOIN wn USING (sk))""".format(as_of=AS_OF)

_HEALTH = """fx AS (SELECT *, CASE WHEN open_sessions > 0 THEN -least(open_sessions * 15, 45) END AS f1, CASE WHEN repeated THEN -20 END AS f2,
    CASE WHEN escalations > 0 THEN -least(escalations * 10, 20) END AS f3, CASE WHEN idle_session IS NOT NULL THEN -15 END AS f4,
    CASE WHEN recent > 0 THEN 10 END AS f5, CASE WHEN total_sessions >= 2 AND resolved_sessions / total_sessions >= 0.8 THEN 10 END AS f6,
    CASE WHEN breaches > 0 THEN -least(breaches * 10, 20) END AS f7, CASE WHEN response / 60 > 10 THEN -5 END AS f8 FROM sg),
  hc AS (SELECT tenant_id, subject_id, sk, CAST(greatest(0, least(100, 100 + coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0) + coalesce(f4, 0)
      + coalesce(f5, 0) + coalesce(f6, 0) + coalesce(f7, 0) + coalesce(f8, 0))) AS INT) AS score,
    concat_ws(',', 'unresolved_issues:' || f1, 'repeated_issues:' || f2, 'escalations:' || f3, 'idle_open_issue:' || f4, 'recent_resolution:' || f5,
      'high_resolution_rate:' || f6, 'sla_resolution_breaches:' || f7, 'slow_first_response:' || f8) AS factors FROM fx),
  h AS (SELECT *, CASE WHEN score >= 70 THEN 'healthy' WHEN score >= 40 THEN 'watch' ELSE 'at_risk' END AS state FROM hc),
  cache AS (SELECT sk, CASE WHEN n % 3 = 1 THEN 'healthy' ELSE 'at_risk' END AS last_state
    FROM (SELECT sk, CAST(substr(subject_id, 6) AS BIGINT) AS n FROM h) WHERE n % 3 > 0)"""
_H = f"{_ER}, {_SIGNALS}, {_HEALTH}"
_M = f"{oracle_ctes('episodes')}, {MEMORIES}"

QUERIES = {
    f.__name__: f
    for f in (
        session_sla, subject_sla, subject_sla_custom_thresholds, payload_texts, compile_memories, compile_summaries, compile_profile_facts,
        session_sla_capped, health_signals_capped, uncompiled_capped, conflict_pairs, conflict_batches, resolve_conflicts, prompt_batches, health_signals, subject_health, health_alerts, health_distribution,
    )
}
ORACLES = {
    "session_sla": f"""{_ER}, {_SESSIONS} SELECT tenant_id, subject_id, session_id, status, {_t("first_message_at")} AS first_message_at,
      {_t("first_response_at")} AS first_response_at, {_t("resolved_at")} AS resolved_at, round(frs, 3) AS first_response_seconds,
      coalesce(frs > 300, false) AS first_response_breached, round(rs, 3) AS resolution_seconds, coalesce(rs > 86400, false) AS resolution_breached,
      round(od, 3) AS open_duration_seconds FROM s""",
    "session_sla_capped": f"""{_ER}, {_SESSIONS.replace("WHERE session_id", f"WHERE rn <= {CAP} AND session_id")} SELECT tenant_id, subject_id, session_id, status,
      {_t("first_message_at")} AS first_message_at, round(frs, 3) AS first_response_seconds FROM s""",
    "subject_sla": _SUBJECT_SLA.replace("{fr}", "300").replace("{res}", "86400"),
    "subject_sla_custom_thresholds": _SUBJECT_SLA.replace("{fr}", "3600").replace("{res}", "7200"),
    "payload_texts": f"{oracle_ctes('episodes')}, {TEXTS} SELECT episode_id, text FROM texts",
    "compile_memories": f"""{_M} SELECT memory_id, tenant_id, subject_id, kind, content, substr(content, 1, 200) AS summary, confidence,
      {_t("created_at")} AS valid_from, episode_id AS source, 'active' AS status FROM m""",
    "compile_summaries": f"{_M} SELECT memory_id, content, substr(content, 1, 200) AS summary FROM m WHERE kind = 'episode_summary'",
    "compile_profile_facts": f"{_M} SELECT subject_id, content, count(*) AS n FROM m WHERE kind = 'profile_fact' GROUP BY ALL",
    "uncompiled_capped": f"""{oracle_ctes("episodes")} SELECT subject_id, count(*) AS n, max({_t("created_at")}) AS last_at FROM (
      SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY created_at, episode_id) AS rn FROM episodes) WHERE rn <= 20 GROUP BY ALL""",
    "conflict_pairs": f"{_M}, {_LOST} SELECT memory_id, nx[1] AS superseded_by, {_t('nx[2]')} AS valid_to FROM lost",
    "conflict_batches": f"{_M}, {_LOST} SELECT memory_id, nx[1] AS superseded_by, {_t('nx[2]')} AS valid_to FROM lost",
    "resolve_conflicts": f"""{_M}, {_LOST} SELECT subject_id, kind, CASE WHEN nx IS NULL THEN 'active' ELSE 'superseded' END AS status, count(*) AS n,
      max({_t("nx[2]")}) AS last_valid_to FROM m LEFT JOIN lost USING (memory_id) GROUP BY ALL""",
    "prompt_batches": f"""{oracle_ctes("episodes")}, {TEXTS}, l AS (SELECT tenant_id, subject_id, list(CAST(least(length(text), 4000) AS BIGINT) ORDER BY created_at, episode_id) AS ns
      FROM texts WHERE text <> '' GROUP BY ALL) SELECT tenant_id, subject_id,
      CAST(list_reduce(ns, lambda a, x: CASE WHEN a % 10000 + x <= 600 THEN a + x ELSE (a // 10000 + 1) * 10000 + x END) // 10000 + 1 AS INT) AS batches, len(ns) AS n FROM l""",
    "health_signals_capped": f"""{_ER}, {_SIGNALS.replace("AS rn FROM episodes)", f"AS rn FROM episodes) WHERE rn <= {CAP}").replace("AS rn FROM resolutions)", f"AS rn FROM resolutions) WHERE rn <= {CAP // 4}")}
      SELECT tenant_id, subject_id, escalations, total_sessions, open_sessions, resolved_sessions, recent, breaches, repeated FROM sg""",
    "health_signals": f"{_H} SELECT * EXCLUDE (sk, idle_days) REPLACE (round(response, 3) AS response) FROM sg",
    "subject_health": f"{_H} SELECT tenant_id, subject_id, score, state, factors FROM h",
    "health_alerts": f"""{_H} SELECT tenant_id, subject_id, CASE WHEN sv > pv THEN 'subject.health_degraded' ELSE 'subject.health_improved' END AS event,
      coalesce(last_state, 'healthy') AS previous_state, state AS current_state, score FROM (SELECT h.*, last_state,
        CASE state WHEN 'at_risk' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS sv, CASE last_state WHEN 'at_risk' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS pv
        FROM h LEFT JOIN cache USING (sk)) WHERE sv > pv OR (sv < pv AND last_state IS NOT NULL)""",
    "health_distribution": f"{_H} SELECT coalesce(last_state, 'unknown') AS state, count(*) AS n FROM h LEFT JOIN cache USING (sk) GROUP BY ALL",
}
