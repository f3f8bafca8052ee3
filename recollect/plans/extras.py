"""Queries over single functions and smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text, vectors
from recollect.operators import compile as comp
from recollect.operators import context, explore, health, lifecycle, sla
from recollect.operators.common import SUBJECT, join_on, tenant_scope, visible_subjects
from recollect.plans.support import _M, MEMORIES, TEXTS, _t
from recollect.sources.adapters import AS_OF, _stamps, _table, episodes, jobs, oracle_ctes, outbox, resolutions
from recollect.sources.schemas import check_episodes, ingest_episodes, read_episodes, read_memories, read_resolutions
from recollect.sources.scratch import scratch
from recollect.streaming import jobs as streams


def normalize_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers as events may hold them: odd kinds, lists, blanks, figures out of range."""
    e, n = _table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        "event_id",
        F.when(n % 3 == 0, "procedure").when(n % 3 == 1, "profile_fact").otherwise("rumour").alias("kind"),
        F.when(n % 5 == 0, F.concat(F.lit('["a'), n.cast("string"), F.lit('","b"]'))).when(n % 5 == 1, "  ").otherwise(F.concat(F.lit(" said "), n.cast("string"))).alias("content"),
        F.when(n % 4 > 0, (n % 4) / 2.0).alias("confidence"), (n % 6 - 1).cast("int").alias("episode_index"), F.lit(3).alias("n_episodes"),
    )
    return comp.normalize_extractions(rows).drop("n_episodes")


def health_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stamps(_table(spark, sf_dir, "events"))
    state = F.when(F.col("event_type") == "error", "at_risk").when(F.col("event_type") == "view", "watch").otherwise("healthy")
    rows = e.select(F.lit(None).cast("string").alias("tenant_id"), F.col("user_id").cast("string").alias("subject_id"), state.alias("state"), F.col("ts").alias("updated_at"))
    return health.health_transitions(rows).groupBy("event", "previous_state", "state").agg(F.count("*").alias("n"))


def provenance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = episodes(spark, sf_dir)
    facts = comp.compile_memories(comp.uncompiled(eps, cap=None)).where("kind = 'profile_fact'")
    return explore.provenance_lookup(eps, facts.select(F.explode("source_episode_ids").alias("episode_id"))).select("episode_id", "type")


def bundle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of bundles that hold each subject's first twenty episodes."""
    eps = episodes(spark, sf_dir)
    name = F.concat(F.coalesce("tenant_id", F.lit("")), F.lit("/"), "subject_id")
    first = comp.uncompiled(eps, cap=20).groupBy(name.alias("request_id")).agg(F.collect_list("episode_id").alias("episode_ids"))
    rows = context.bundle_sessions(first, eps)
    return rows.withColumns({n: text.stamp(F.col(n)) for n in ("first_at", "last_at")})


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = episodes(spark, sf_dir)
    n = F.substring("episode_id", 4, 20).cast("long")
    broken = eps.withColumns({
        "subject_id": F.when(n % 7 == 0, " ").otherwise(F.col("subject_id")), "source": F.when(n % 11 == 0, F.repeat(F.lit("x"), 200)).otherwise(F.col("source")),
        "payload": F.when(n % 13 == 0, '["list"]').when(n % 17 == 0, "{broken").otherwise(F.col("payload")),
    })
    return check_episodes(broken).groupBy("rejected").agg(F.count("*").alias("n"))


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of which some are broken, taken in, and memories and resolutions, written and read by the readers."""
    eps = episodes(spark, sf_dir).withColumns({n: F.lit(None).cast("string") for n in ("metadata", "provenance")})
    n = F.substring("episode_id", 4, 20).cast("long")
    folder = scratch(spark, "tables")
    ingest_episodes(eps.withColumn("payload", F.when(n % 13 == 0, '["list"]').otherwise(F.col("payload"))), f"{folder}/episodes")
    comp.compile_memories(comp.uncompiled(eps, cap=None)).write.parquet(f"{folder}/memories")
    resolutions(spark, sf_dir).write.orc(f"{folder}/resolutions")
    e = read_episodes(spark, f"{folder}/episodes").where("last_compiled_at IS NULL AND metadata = '{}'")
    tables = {"episodes": e, "memories": read_memories(spark, f"{folder}/memories"), "resolutions": read_resolutions(spark, f"{folder}/resolutions", "orc")}
    parts = [t.groupBy("tenant_id").agg(F.count("*").alias("n"), F.max(text.stamp(F.col("created_at"))).alias("last_at")).select(F.lit(name).alias("name"), "*") for name, t in tables.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def tenant_visible_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tenant_scope(episodes(spark, sf_dir), "globex")
    n = F.substring("subject_id", 6, 20).cast("long")
    hidden = F.when(n % 5 == 0, F.concat(F.lit("_snapshot/"), "subject_id")).when(n % 5 == 1, F.concat(F.lit("_bootstrap_tmp/"), "subject_id"))
    return visible_subjects(rows.withColumn("subject_id", F.coalesce(hidden, "subject_id"))).select("subject_id").distinct()


def subject_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names as subject ids: whether they are valid, and what an import would call them."""
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "demo_web_").otherwise(""), F.col("c_name"), F.when(F.col("c_custkey") % 4 == 0, " x").otherwise(""))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", name.alias("subject_id"))
    return rows.select("c_custkey", lifecycle.valid_subject_id(F.col("subject_id")).alias("valid"), lifecycle.suggest_target(F.col("subject_id"), "in").alias("target"))


def id_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = episodes(spark, sf_dir)
    return lifecycle.id_conflicts(eps.select("episode_id", "type"), eps.where("type = 'tool_call'"), "episode_id")


def clone_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = episodes(spark, sf_dir)
    none = eps.limit(0)
    subjects = eps.select("subject_id").distinct()
    targets = subjects.withColumn("target_id", F.when(F.col("subject_id").endswith("1"), F.col("subject_id")).otherwise(F.concat(F.lit("t-"), "subject_id")))
    out = [lifecycle.apply_strategy(targets, eps, none, s, "seed").withColumn("strategy", F.lit(s)) for s in ("merge", "cancel", "create_copy")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's distance from the next one's."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


def compiler_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another compiler in place of the library's: a procedure of every action's text."""

    def procedures(eps: DataFrame) -> DataFrame:
        rows = eps.where("type = 'action'").withColumn("content", text.payload_text(F.col("payload"))).where("content <> ''")
        return rows.select(text.stable_id("procedure", F.col("episode_id")).alias("memory_id"), "tenant_id", "subject_id", F.lit("procedure").alias("kind"), "content")

    made, marked = comp.compile_new(episodes(spark, sf_dir), AS_OF, cap=None, compiler=procedures)
    n = marked.where(F.col("last_compiled_at") == F.lit(AS_OF).cast("timestamp")).groupBy("tenant_id").agg(F.count("*").alias("marked"))
    return join_on(n, made.groupBy("tenant_id").agg(F.count("*").alias("made"), F.max("memory_id").alias("last_id")), ("tenant_id",))


def retire_old_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.retire_old_jobs(jobs(spark, sf_dir), "1997-06-01 00:00:00").groupBy("status").agg(F.count("*").alias("n"))


def expire_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = streams.minute_hits(_stamps(_table(spark, sf_dir, "events")).select(F.col("user_id").alias("key"), "ts"), rpm=1)
    rows = streams.expire_windows(hits, "2024-01-15 00:00:00", minutes=60)
    return rows.groupBy("key").agg(F.count("*").alias("windows"), F.sum("hits").alias("hits"), F.count_if("limited").alias("limited"))


def due_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.due_events(outbox(spark, sf_dir), "1997-01-01 00:00:00").select("event_id", text.stamp(F.col("next_attempt_at")).alias("next_attempt_at"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions over every episode's text."""
    rows = episodes(spark, sf_dir).withColumn("text", text.payload_text(F.col("payload")))
    t, other = F.col("text"), F.lit("the export job keeps failing with code")
    now = F.lit(AS_OF).cast("timestamp")
    return rows.select(
        "episode_id", F.size(text.word_tokens(t)).alias("tokens"), F.array_join(F.sort_array(text.issue_keywords(t)), " ").alias("keywords"),
        F.round(text.keyword_overlap(text.issue_keywords(t), text.issue_keywords(other)), 6).alias("overlap"),
        F.round(text.jaccard(text.word_tokens(t), text.word_tokens(other)), 6).alias("jaccard"),
        F.round(text.min_overlap(text.overlap_keywords(t), text.overlap_keywords(other)), 6).alias("least"),
        text.has_cue(t, text.CONTEXT_URGENCY).alias("urgent"), text.short_episode(F.col("source"), F.col("type"), t, 40).alias("line"),
        text.clean_summary(t).alias("note"), text.slugify(F.substring(t, 1, 30)).alias("slug"), text.whole_days(now, F.col("created_at")).alias("days"),
        text.approx_tokens(t).alias("approx"),
    )


def session_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sla.session_firsts(episodes(spark, sf_dir), sla.USER_SOURCES, sla.AGENT_SOURCES, fallback=False)
    rows = rows.groupBy(*SUBJECT).agg(F.count("*").alias("sessions"), F.count("first_user").alias("asked"), F.count("first_agent").alias("answered"))
    open_ = resolutions(spark, sf_dir).groupBy(*SUBJECT).agg(F.count_if(F.col("status") == "open").alias("open"))
    return join_on(rows, open_, SUBJECT)


_E = oracle_ctes("episodes")
_W = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
_STOP = "[" + ",".join(f"'{w}'" for w in text.ISSUE_STOPWORDS) + "]"
_OVER = "[" + ",".join(f"'{w}'" for w in text.OVERLAP_STOPWORDS) + "]"

QUERIES = {
    f.__name__: f
    for f in (
        normalize_extractions, health_transitions, provenance_lookup, bundle_sessions, ingest_rejects, stored_tables, tenant_visible_subjects, subject_ids, id_conflicts,
        clone_strategies, retire_old_jobs, expire_windows, due_events, text_functions, session_firsts,
        cosine_distance, compiler_hook,
    )
}
ORACLES = {
    "normalize_extractions": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'procedure' WHEN 1 THEN 'profile_fact' ELSE 'episode_summary' END AS kind,
      CASE WHEN event_id % 5 = 0 THEN concat('a', event_id, chr(10), 'b') ELSE concat('said ', event_id) END AS content, least(1.0, CASE WHEN event_id % 4 > 0 THEN (event_id % 4) / 2.0 ELSE 0.7 END)::DOUBLE AS confidence,
      CAST(CASE WHEN event_id % 6 BETWEEN 1 AND 3 THEN event_id % 6 - 1 ELSE 0 END AS INT) AS episode_index FROM events WHERE event_id % 5 <> 1""",
    "health_transitions": """WITH l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM (SELECT *, CASE event_type WHEN 'error' THEN 'at_risk' WHEN 'view' THEN 'watch' ELSE 'healthy' END AS state FROM events)),
      v AS (SELECT *, CASE state WHEN 'at_risk' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END - CASE before WHEN 'at_risk' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS worse FROM l)
      SELECT CASE WHEN worse > 0 THEN 'subject.health_degraded' ELSE 'subject.health_improved' END AS event, before AS previous_state, state, count(*) AS n FROM v WHERE worse > 0 OR (worse < 0 AND before IS NOT NULL) GROUP BY ALL""",
    "provenance_lookup": f"{_M} SELECT episode_id, type FROM episodes WHERE episode_id IN (SELECT episode_id FROM m WHERE kind = 'profile_fact')",
    "bundle_sessions": f"""{_E}, f AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY created_at, episode_id) AS rn FROM episodes)
      SELECT sk AS request_id, session_id, count(*) AS episode_count, {_t("min(created_at)")} AS first_at, {_t("max(created_at)")} AS last_at FROM f WHERE rn <= 20 AND session_id IS NOT NULL GROUP BY ALL""",
    "ingest_rejects": f"""{_E} SELECT CASE WHEN n % 7 = 0 THEN 'subject_id' WHEN n % 11 = 0 THEN 'source' WHEN n % 13 = 0 OR n % 17 = 0 THEN 'payload' END AS rejected, count(*) AS n
      FROM (SELECT CAST(substr(episode_id, 4) AS BIGINT) AS n FROM episodes) GROUP BY ALL""",
    "stored_tables": f"""{oracle_ctes("episodes", "resolutions")}, {MEMORIES}, a AS (SELECT 'episodes' AS name, tenant_id, created_at FROM episodes WHERE CAST(substr(episode_id, 4) AS BIGINT) % 13 <> 0
      UNION ALL SELECT 'memories', tenant_id, created_at FROM m UNION ALL SELECT 'resolutions', tenant_id, created_at FROM resolutions)
      SELECT name, tenant_id, count(*) AS n, max({_t("created_at")}) AS last_at FROM a GROUP BY ALL""",
    "tenant_visible_subjects": f"{_E} SELECT DISTINCT subject_id FROM episodes WHERE tenant_id = 'globex' AND CAST(substr(subject_id, 6) AS BIGINT) % 5 > 1",
    "subject_ids": """WITH n AS (SELECT c_custkey, concat(CASE WHEN c_custkey % 3 = 0 THEN 'demo_web_' ELSE '' END, c_name, CASE WHEN c_custkey % 4 = 0 THEN ' x' ELSE '' END) AS s FROM customer)
      SELECT c_custkey, regexp_full_match(s, '[A-Za-z0-9_.:-]{1,128}') AS valid, concat(substr(regexp_replace(CASE WHEN starts_with(s, 'demo_web_') THEN 'imported-' || substr(s, 10) ELSE s END, '[^A-Za-z0-9_.:-]', '-', 'g'), 1, 119),
        '-', substr(sha256('in|' || s), 1, 8)) AS target FROM n""",
    "id_conflicts": f"{_E} SELECT episode_id, type FROM episodes WHERE type = 'tool_call'",
    "clone_strategies": f"""{_E}, t AS (SELECT DISTINCT subject_id, subject_id LIKE '%1' AS p, CASE WHEN subject_id LIKE '%1' THEN subject_id ELSE 't-' || subject_id END AS target_id FROM episodes)
      SELECT subject_id, target_id, 'merge' AS strategy FROM t UNION ALL SELECT subject_id, target_id, 'cancel' FROM t WHERE NOT p
      UNION ALL SELECT subject_id, CASE WHEN p THEN concat(target_id, '-', substr(sha256('seed|' || target_id), 1, 8)) ELSE target_id END, 'create_copy' FROM t""",
    "retire_old_jobs": f"{oracle_ctes('jobs')} SELECT status, count(*) AS n FROM jobs WHERE NOT (status IN ('completed', 'failed') AND created_at < TIMESTAMP '1997-05-25') GROUP BY ALL",
    "expire_windows": """WITH h AS (SELECT user_id AS key, date_trunc('minute', ts) AS w, count(*) AS hits FROM events GROUP BY ALL)
      SELECT key, count(*) AS windows, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (hits > 1) AS limited FROM h WHERE w >= TIMESTAMP '2024-01-14 23:00:00' GROUP BY ALL""",
    "due_events": f"""{oracle_ctes("outbox")} SELECT event_id, {_t("next_attempt_at")} AS next_attempt_at FROM outbox WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '1997-01-01'
      ORDER BY outbox.next_attempt_at, event_id LIMIT 20""",
    "text_functions": f"""{_E}, {TEXTS}, k AS (SELECT *, {_W.format("text")} AS ws, ['the','export','job','keeps','failing','with','code'] AS os FROM texts),
      i AS (SELECT *, list_filter(ws, lambda w: NOT list_contains({_STOP}, w)) AS iw, list_filter(os, lambda w: NOT list_contains({_STOP}, w)) AS io,
        list_filter(ws, lambda w: length(w) > 2 AND NOT list_contains({_OVER}, w)) AS vw, list_filter(os, lambda w: length(w) > 2 AND NOT list_contains({_OVER}, w)) AS vo FROM k),
      l AS (SELECT *, list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: regexp_replace(trim(x), '^(user|assistant|system):\\s*', '')), lambda x: x <> '') AS ls FROM i)
      SELECT episode_id, CAST(len(ws) AS INT) AS tokens, array_to_string(list_sort(iw), ' ') AS keywords, round(CASE WHEN len(iw) = 0 THEN 0 ELSE len(list_intersect(iw, io)) / len(iw) END, 6)::DOUBLE AS overlap,
        round(CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_intersect(ws, os)) / (len(ws) + len(os) - len(list_intersect(ws, os))) END, 6)::DOUBLE AS jaccard,
        round(CASE WHEN len(vw) = 0 THEN 0 ELSE len(list_intersect(vw, vo)) / least(len(vw), len(vo)) END, 6)::DOUBLE AS least,
        regexp_matches(lower(text), 'urgent|critical|blocked|deadline|asap|emergency|breaking|outage|downtime|compliance|sla|escalat|immediately|production down|p0|p1|severity') AS urgent,
        concat('[', source, '/', type, '] ', CASE WHEN text = '' THEN '(no text content)' ELSE substr(text, 1, 40) END) AS line,
        CASE WHEN len(ls) <= 2 THEN coalesce(array_to_string(ls, ' → '), '') ELSE ls[1] || ' → ' || ls[-1] END AS note,
        regexp_replace(trim(regexp_replace(lower(trim(substr(text, 1, 30))), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g') AS slug,
        CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400e6) AS INT) AS days, CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS INT) AS approx FROM l""",
    "session_firsts": f"""{oracle_ctes("episodes", "resolutions")}, u AS (SELECT *, min(CASE WHEN source IN ('user', 'chat') THEN created_at END) OVER (PARTITION BY sk, session_id) AS fu FROM episodes WHERE session_id IS NOT NULL),
      f AS (SELECT tenant_id, subject_id, sk, session_id, min(fu) AS fu, min(CASE WHEN source IN ('agent', 'system') AND created_at >= fu THEN created_at END) AS fa FROM u GROUP BY ALL),
      o AS (SELECT sk, count(*) FILTER (status = 'open') AS n FROM resolutions GROUP BY ALL)
      SELECT f.tenant_id, f.subject_id, count(*) AS sessions, count(fu) AS asked, count(fa) AS answered, any_value(o.n) AS "open" FROM f LEFT JOIN o USING (sk) GROUP BY f.tenant_id, f.subject_id""",
}
ORACLES["cosine_distance"] = """SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
ORACLES["compiler_hook"] = f"""{_E}, {TEXTS}, p AS (SELECT tenant_id, sha256('procedure|' || episode_id) AS memory_id FROM texts WHERE type = 'action' AND text <> ''),
  n AS (SELECT tenant_id, count(*) AS marked FROM episodes GROUP BY ALL), d AS (SELECT tenant_id, count(*) AS made, max(memory_id) AS last_id FROM p GROUP BY ALL)
  SELECT n.tenant_id, marked, made, last_id FROM n LEFT JOIN d ON n.tenant_id IS NOT DISTINCT FROM d.tenant_id"""
