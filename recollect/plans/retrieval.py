"""Queries over search, vectors, context bundles and handoff briefs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import vectors
from recollect.functions.text import payload_text, stamp
from recollect.operators import context, gram_index, handoff, health, search, sla, vector_index
from recollect.operators.common import scoped
from recollect.operators.compile import compile_memories, uncompiled
from recollect.plans.support import _H, _M, _SESSIONS, MEMORIES, _t
from recollect.sources.adapters import AS_OF, episodes, oracle_ctes, resolutions, vector_memories
from recollect.sources.scratch import materialize, scratch

TASK = "the export job keeps failing after the password change"


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_memories(uncompiled(episodes(spark, sf_dir), cap=None))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for every tenant's subject, in the session of its latest episode; those without a tenant ask over all tenants."""
    rows = episodes(spark, sf_dir).where("session_id IS NOT NULL").groupBy("tenant_id", "subject_id").agg(
        F.max_by("session_id", F.struct("created_at", "episode_id")).alias("session_id")
    )
    return rows.select(
        F.concat(F.lit("req-"), F.coalesce("tenant_id", F.lit("")), F.lit("-"), "subject_id").alias("request_id"), "tenant_id", "subject_id",
        F.lit(TASK).alias("task"), "session_id", F.lit(300).alias("max_tokens"), F.lit("escalation").alias("reason"),
    )


def search_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.search_memories(_memories(spark, sf_dir), kind="episode_summary", query="EXPORT job")
    return rows.select("subject_id", "memory_id", "content", stamp(F.col("created_at")).alias("created_at"))


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = vector_memories(spark, sf_dir)
    number = F.substring("memory_id", 5, 20).cast("long")
    queries = memories.where(number % 50 == 0).select("tenant_id", "subject_id", F.concat(F.lit("q-"), "memory_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.semantic_topk(queries, memories, k=10).withColumn("distance", F.round("distance", 6))


def semantic_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries an index of coarse cells was asked, and whether it found nine in ten of the exact neighbours.

    All memories are of one subject here, so that cells and not subjects divide the work. The test vectors are
    nearly random, for which two thirds of the cells have to be asked; clustered ones need far fewer.
    """
    memories = vector_memories(spark, sf_dir).withColumns({"subject_id": F.lit("all"), "tenant_id": F.lit(None).cast("string")})
    number = F.substring("memory_id", 5, 20).cast("long")
    queries = memories.where(number % 50 == 0).select("tenant_id", "subject_id", F.concat(F.lit("q-"), "memory_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = search.semantic_topk(queries, memories, k=10)
    found = search.semantic_topk(queries, memories, k=10, cells=search.fit_cells(memories, cells=64), probes=42)
    hits = exact.join(found.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_semi").agg(F.count("*").alias("hits"))
    total = exact.agg(F.count("*").alias("total"), F.count_distinct("query_id").alias("queries"))
    return total.crossJoin(hits).select("queries", (F.col("hits") >= 0.9 * F.col("total")).alias("recall_of_nine_tenths"))  # one row each


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by postings, over memories that came in two batches."""
    path, rows = scratch(spark, "gram-index"), materialize(_memories(spark, sf_dir), "gram-memories")
    for batch in range(2):
        gram_index.add_memories(path, rows.where(F.pmod(F.xxhash64("memory_id"), F.lit(2)) == batch), batch)
    rows = gram_index.search_indexed(spark, path, "EXPORT job", kind="episode_summary")
    return rows.select("subject_id", "memory_id", "content", stamp(F.col("created_at")).alias("created_at"))


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of product codes over clustered vectors: whether it finds nine in ten of the exact neighbours for less than half of the work.

    Each vector is drawn to one of forty others, for lists and codes are of use only where vectors have a structure. All memories are
    of one subject, so that lists and not subjects divide the work; they come in two batches, and the index is fitted to the first.
    """
    base = vector_memories(spark, sf_dir).withColumn("n", F.substring("memory_id", 5, 20).cast("long"))
    anchors = base.where("n < 40").select((F.col("n")).alias("_a"), F.col("embedding").alias("_e"))
    drawn = F.zip_with("embedding", "_e", lambda x, y: (0.5 * x + y).cast("float"))
    rows = base.join(F.broadcast(anchors), F.col("n") % 40 == F.col("_a")).withColumn("embedding", drawn)  # forty rows
    rows = rows.withColumns({"subject_id": F.lit("all"), "tenant_id": F.lit(None).cast("string")}).drop("_a", "_e")
    rows = materialize(rows, "clustered")
    queries = rows.where("n % 50 = 0").select("tenant_id", "subject_id", F.concat(F.lit("q-"), "memory_id").alias("query_id"), F.col("embedding").alias("vector"))
    path, first = scratch(spark, "vector-index"), rows.where("n % 4 < 3")
    vector_index.save_index(spark, vector_index.fit_index(first, cells=40), path)
    vector_index.add_vectors(path, first, 0)
    vector_index.add_vectors(path, rows.where("n % 4 = 3"), 1)
    exact = search.semantic_topk(queries, rows, k=5)
    found = vector_index.search_index(path, queries, k=5, probes=4, short=4)
    hits = exact.join(found.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_semi").agg(F.count("*").alias("hits"))
    total, work = exact.agg(F.count("*").alias("total")), vector_index.index_work(path, queries, 5, 4, 4)
    out = work.crossJoin(total).crossJoin(hits)  # one row each
    return out.select("queries", (F.col("hits") >= 0.9 * F.col("total")).alias("recall_of_nine_tenths"), (F.col("work") < 0.5 * F.col("exact")).alias("less_than_half_the_work"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = payload_text(F.col("payload"))
    return episodes(spark, sf_dir).select("episode_id", vectors.hash_embedding(text, 32).alias("embedding"))


def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir)
    old = F.when(F.col("kind") == "profile_fact", F.array(F.lit(1.0)).cast("array<float>"))
    done = vectors.backfill_embeddings(rows.withColumn("embedding", old), lambda text: vectors.hash_embedding(text, 16))
    return done.groupBy("kind", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))


def query_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of episodes as look-ups against a cache that the first half of the month left."""
    rows = episodes(spark, sf_dir).withColumn("text_key", F.sha2(payload_text(F.col("payload")), 256)).where("payload <> '{\"note\":1}'")
    rows = rows.select("text_key", F.lit("m1").alias("model"), F.array(F.lit(0.0)).alias("embedding"), "created_at")
    half = F.lit("2024-01-20 00:00:00").cast("timestamp")
    old = rows.where(F.col("created_at") < half).groupBy("text_key", "model").agg(F.first("embedding").alias("embedding"), F.max("created_at").alias("created_at"))
    old = old.withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL '48' HOUR"))
    hits, new = search.query_vector_cache(old, rows.where(F.col("created_at") >= half), "2024-01-20 12:00:00")
    fresh = F.col("created_at") == F.lit("2024-01-20 12:00:00").cast("timestamp")
    return hits.agg(F.count("*").alias("hits")).crossJoin(new.agg(F.count("*").alias("entries"), F.count_if(fresh).alias("refreshed")))


def _pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = context.with_tokens(_requests(spark, sf_dir))
    return asked, context.memory_pool(asked, _memories(spark, sf_dir))


def memory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.memory_scores(_pool(spark, sf_dir)[1], AS_OF)
    return rows.select("request_id", "memory_id", F.round("score", 6).alias("score"), "section", "line")


def memory_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = episodes(spark, sf_dir)
    number = F.substring("episode_id", 4, 20).cast("long")
    title = F.concat(F.lit('{"breadcrumb":"Guide > Part '), (number % 7).cast("string"), F.lit('"}'))
    eps = eps.withColumn("payload", F.when(number % 3 == 0, title).otherwise(F.col("payload")))
    found = context.memory_breadcrumbs(_memories(spark, sf_dir), eps)
    return found.select("memory_id", F.array_join("breadcrumbs", "|").alias("breadcrumbs"))


def _episode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = context.with_tokens(_requests(spark, sf_dir))
    pool = context.episode_pool(asked, episodes(spark, sf_dir))
    return context.episode_scores(pool, asked, resolutions(spark, sf_dir))


def episode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _episode_scores(spark, sf_dir).select("request_id", "episode_id", F.round("score", 6).alias("score"), "line")


def repeat_issue_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = context.with_tokens(_requests(spark, sf_dir))
    return context.repeat_issues(context.episode_pool(asked, episodes(spark, sf_dir)), asked, resolutions(spark, sf_dir))


def memory_scores_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with everything that can count: headings, memories that have expired, and finds of a semantic search."""
    asked = context.with_tokens(_requests(spark, sf_dir))
    number = F.substring(F.element_at("source_episode_ids", 1), 4, 20).cast("long")
    mem = _memories(spark, sf_dir).withColumn("valid_to", F.when(number % 4 < 2, F.timestamp_micros(F.unix_micros("created_at") + (number % 40) * 86_400_000_000)))
    eps = episodes(spark, sf_dir)
    heading = F.substring("episode_id", 4, 20).cast("long") % 3 == 0
    eps = eps.withColumn("payload", F.when(heading, '{"breadcrumb":"Export job > Part 7"}').otherwise(F.col("payload")))
    finds = context.requests_with(asked, scoped(mem)).where(number % 5 == 1).select("request_id", "memory_id", (number % 10 / 8.0).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("distance", "memory_id"))
    pool = materialize(context.memory_pool(asked, mem, finds.withColumn("rank", rank)), "full-pool")
    rows = context.memory_scores(pool, AS_OF, context.memory_breadcrumbs(pool, eps))
    return rows.select("request_id", "memory_id", F.round("score", 6).alias("score"), "section")


def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.assemble_context(_requests(spark, sf_dir), episodes(spark, sf_dir), _memories(spark, sf_dir), resolutions(spark, sf_dir), AS_OF)
    lists = ["fact_ids", "procedure_ids", "summary_ids", "episode_ids", "sessions"]
    return rows.withColumns({n: F.array_join(n, ",") for n in lists})


def handoff_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps, res = episodes(spark, sf_dir), resolutions(spark, sf_dir)
    sessions = materialize(sla.session_sla(eps, res, AS_OF), "sessions")  # read twice
    scores = health.subject_health(health.health_signals(eps, res, AS_OF))
    rows = handoff.handoff_brief(_requests(spark, sf_dir), eps, _memories(spark, sf_dir), res, scores, sla.subject_sla(sessions), sessions)
    lists = ["attempted_steps", "key_facts", "recent", "open_issues", "resolved", "fact_ids", "issue_ids", "resolution_ids", "recent_ids"]
    return rows.withColumns({n: F.array_join(n, "|") for n in lists})


_TASK_WORDS = "['the', 'export', 'job', 'keeps', 'failing', 'after', 'password', 'change']"
_ISSUE = "['export', 'job', 'keeps', 'failing', 'after', 'password', 'change']"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
_REQ = "rq AS (SELECT tenant_id AS tn, subject_id, concat('req-', coalesce(tenant_id, ''), '-', subject_id) AS request_id, arg_max(session_id, (created_at, episode_id)) AS cur FROM episodes WHERE session_id IS NOT NULL GROUP BY ALL)"
_STOP = "['i','me','my','we','our','you','your','he','she','it','they','them','their','this','that','is','am','are','was','were','be','been','being','have','has','had','do','does','did','will','would','shall','should','can','could','may','might','must','a','an','the','and','but','or','nor','for','so','yet','at','by','from','in','into','of','on','to','up','with','as','if','then','else','when','where','how','what','which','who','whom','why','all','any','each','every','no','not','only','very','just','also','too','hi','hello','thanks','thank','okay','ok','yes','please','hey','sure','got','get','let','know','think','want','need','help']"
_SEES = "rq.subject_id = {0}.subject_id AND (rq.tn IS NULL OR rq.tn = {0}.tenant_id)"
_POOL = f"""{oracle_ctes("episodes", "resolutions")}, {MEMORIES}, {_REQ},
  ep AS (SELECT * FROM (SELECT rq.request_id, rq.cur, t.*, row_number() OVER (PARTITION BY rq.request_id ORDER BY created_at, episode_id) AS rn FROM texts t JOIN rq ON {_SEES.format("t")}) WHERE rn <= 30),
  kw AS (SELECT request_id, list_distinct(flatten(list(list_filter({_WORDS.format("text")}, lambda w: NOT list_contains({_STOP}, w))))) AS ws FROM ep WHERE session_id = cur AND text <> '' GROUP BY ALL),
  iss AS (SELECT rq.request_id, list_distinct(list_concat(coalesce(ws, []), {_ISSUE})) AS ws FROM rq LEFT JOIN kw USING (request_id)),
  rr AS (SELECT rq.request_id, r.* FROM resolutions r JOIN rq ON {_SEES.format("r")}),
  nt AS (SELECT request_id, session_id, min(resolution_summary) AS note FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY updated_at DESC, resolution_id) AS rn FROM rr WHERE status = 'resolved')
    WHERE rn <= 20 AND coalesce(resolution_summary, '') <> '' GROUP BY ALL),
  pr AS (SELECT request_id, session_id, string_agg(text, ' ') AS txt FROM ep JOIN rr USING (request_id, session_id) WHERE rr.status = 'resolved' AND text <> '' AND session_id IS DISTINCT FROM cur GROUP BY ALL),
  rep AS (SELECT request_id, session_id, CASE WHEN note IS NULL THEN 4.0 ELSE 6.0 END::DOUBLE AS repeat FROM (SELECT pr.*, note, ws,
      {_WORDS.format("concat(txt, ' ', coalesce(note, ''))")} AS pw FROM pr JOIN iss USING (request_id) LEFT JOIN nt USING (request_id, session_id))
    WHERE len(list_intersect(ws, list_filter(pw, lambda w: NOT list_contains({_STOP}, w)))) / len(ws) >= 0.3)"""
_RECENCY = """CASE WHEN max(epoch_us(created_at)) OVER w = min(epoch_us(created_at)) OVER w THEN 5.0
  ELSE (epoch_us(created_at) - min(epoch_us(created_at)) OVER w) / (max(epoch_us(created_at)) OVER w - min(epoch_us(created_at)) OVER w) * 5.0 END"""
_MEMORY_POOL = f"""p AS (SELECT * FROM (SELECT rq.request_id, m.*, row_number() OVER (PARTITION BY rq.request_id, kind ORDER BY created_at DESC, memory_id) AS rn FROM m JOIN rq ON {_SEES.format("m")})
        WHERE rn <= CASE kind WHEN 'profile_fact' THEN 50 ELSE 30 END),
      l AS (SELECT *, list_filter(list_transform(string_split(trim(content), chr(10)), lambda x: regexp_replace(trim(x), '^(user|assistant|system):\\s*', '')), lambda x: x <> '') AS ls FROM p)"""
_MEMORY_SCORE = f"(CASE kind WHEN 'profile_fact' THEN 10.0 ELSE 5.0 END + {_RECENCY} + len(list_intersect({_TASK_WORDS}, {_WORDS.format('content')})) / 8 * 5.0 + 3.0)"
_MEMORY_LINE = "'- ' || CASE WHEN kind = 'profile_fact' THEN content WHEN len(ls) <= 2 THEN array_to_string(ls, ' → ') ELSE ls[1] || ' → ' || ls[-1] END"
_EPISODE_STATES = "st AS (SELECT request_id, session_id, max(status = 'resolved') AS rs, max(status = 'open') AS op FROM rr GROUP BY ALL)"
_EPISODE_SCORE = f"""(3.0 + {_RECENCY} + len(list_intersect({_TASK_WORDS}, {_WORDS.format("text")})) / 8 * 5.0 + CASE WHEN session_id = cur THEN 6.0 ELSE 0 END
        + CASE WHEN rs THEN -5.0 ELSE 0 END + coalesce(repeat, 0) + CASE WHEN op THEN 4.0 ELSE 0 END
        + CASE WHEN source IN ('assistant', 'agent', 'tool', 'system') OR type IN ('action', 'tool_call', 'resolution_attempt') THEN 2.0 ELSE 0 END
        + CASE WHEN regexp_matches(lower(text), 'urgent|critical|blocked|deadline|asap|emergency|breaking|outage|downtime|compliance|sla|escalat|immediately|production down|p0|p1|severity') THEN 2.0 ELSE 0 END
        + CASE WHEN text <> '' AND length(trim(text)) < 20 THEN -2.0 ELSE 0 END)"""
_EPISODE_LINE = "concat('- [', source, '/', type, '] ', CASE WHEN text = '' THEN '(no text content)' ELSE substr(text, 1, 150) END)"
_TOKENS = "len(regexp_extract_all({0}, '\\w+|[^\\w\\s]'))"


def _part(title: str, lines: str, bullet: str = "- ") -> str:
    """A section of the brief, in SQL."""
    body = f"array_to_string(list_transform({lines}, lambda x: '{bullet}' || x), chr(10))"
    return f"CASE WHEN len({lines}) > 0 THEN '## {title}' || chr(10) || {body} || chr(10) || chr(10) ELSE '' END"


_DETAILS = ", ".join(
    f"CASE WHEN {on} IS NOT NULL THEN {text} END"
    for on, text in (
        ("f1", "open_sessions || ' open session(s)'"), ("f2", "'Open issues resemble previously resolved ones'"), ("f3", "escalations || ' episode(s) with urgency markers'"),
        ("f4", "'Session ' || idle_session || ' idle for ' || idle_days || ' days'"), ("f5", "recent || ' session(s) resolved in last 7 days'"),
        ("f6", "CAST(round(resolved_sessions / total_sessions * 100) AS INT) || '% sessions resolved (' || resolved_sessions || '/' || total_sessions || ')'"),
        ("f7", "breaches || ' session(s) exceeded 24h resolution SLA'"), ("f8", "printf('Avg first response %.1f min (threshold: 10 min)', response / 60)"),
    )
)
_KEY = "concat(coalesce({0}, ''), '/', {1})"
_BRIEF = f"""{_H}, {MEMORIES}, {_SESSIONS}, {_REQ},
  ft AS (SELECT request_id, list(content ORDER BY rn) AS facts, list(memory_id ORDER BY rn) AS fact_ids FROM (SELECT rq.request_id, m.*, row_number() OVER (PARTITION BY rq.request_id ORDER BY created_at DESC, memory_id) AS rn
    FROM m JOIN rq ON {_SEES.format("m")} WHERE kind = 'profile_fact') WHERE rn <= 20 GROUP BY ALL),
  he AS (SELECT *, coalesce(session_id = cur, false) AS here, '[' || source || '/' || type || ']' AS tag FROM (SELECT rq.request_id, rq.cur, t.*, row_number() OVER (PARTITION BY rq.request_id ORDER BY t.created_at, episode_id) AS pos
    FROM texts t JOIN rq ON {_SEES.format("t")}) WHERE pos <= 30),
  hn AS (SELECT *, row_number() OVER (PARTITION BY request_id, here ORDER BY pos) AS n FROM he),
  el AS (SELECT request_id, list(concat(tag, ' ', substr(text, 1, 200)) ORDER BY pos) FILTER (here AND n <= 10 AND text <> '') AS issue, list(episode_id ORDER BY pos) FILTER (here AND n <= 10) AS issue_ids,
    list(substr(text, 1, 150) ORDER BY pos) FILTER (here AND text <> '' AND (source IN ('agent', 'system', 'tool') OR type IN ('action', 'tool_call', 'resolution_attempt') OR (type = 'message' AND source = 'assistant'))) AS steps,
    list(concat(tag, coalesce(' [' || session_id || ']', ''), ' ', substr(text, 1, 120)) ORDER BY pos) FILTER (NOT here AND n <= 5 AND text <> '') AS others, list(episode_id ORDER BY pos) FILTER (NOT here AND n <= 5) AS recent_ids FROM hn GROUP BY ALL),
  rl AS (SELECT request_id, list(concat('[', session_id, '] ', coalesce(nullif(resolution_summary, ''), 'No summary')) ORDER BY pos) FILTER (status <> 'resolved') AS open_issues,
    list(concat('[', session_id, '] ', coalesce(nullif(resolution_summary, ''), 'Resolved')) ORDER BY pos) FILTER (status = 'resolved') AS solved, list(resolution_id ORDER BY pos) AS resolution_ids
    FROM (SELECT rq.request_id, r.*, row_number() OVER (PARTITION BY rq.request_id ORDER BY updated_at DESC, resolution_id) AS pos FROM resolutions r JOIN rq ON {_SEES.format("r")}) WHERE pos <= 20 GROUP BY ALL),
  sl AS (SELECT {_KEY.format("tenant_id", "subject_id")} AS sk, count(*) FILTER (status = 'open') AS open_n, avg(frs) AS first, count(*) FILTER (frs > 300) AS frb, count(*) FILTER (rs > 86400) AS rsb, max(od) AS age FROM s GROUP BY ALL),
  dt AS (SELECT sk, list_filter([{_DETAILS}], lambda x: x IS NOT NULL)[1:3] AS tops FROM fx),
  b AS (SELECT rq.*, coalesce(facts, []) AS facts, coalesce(fact_ids, []) AS fact_ids, coalesce(issue, []) AS issue, coalesce(issue_ids, []) AS issue_ids, coalesce(steps, []) AS steps, coalesce(others, []) AS others, coalesce(recent_ids, []) AS recent_ids,
      coalesce(open_issues, []) AS open_issues, coalesce(solved, []) AS solved, coalesce(resolution_ids, []) AS resolution_ids, coalesce(h.score, 100) AS score, coalesce(h.state, 'healthy') AS state, coalesce(tops, []) AS tops,
      list_filter([CASE WHEN frb > 0 THEN '⚠️ First-response SLA breached in ' || frb || ' session(s)' END, CASE WHEN rsb > 0 THEN '⚠️ Resolution SLA breached in ' || rsb || ' session(s)' END,
        CASE WHEN open_n > 0 THEN printf('Open issue age: %.1fh', coalesce(age, 0) / 3600) END, CASE WHEN first IS NOT NULL THEN printf('Avg first response: %.1f min', first / 60) END], lambda x: x IS NOT NULL) AS late
    FROM rq LEFT JOIN ft USING (request_id) LEFT JOIN el USING (request_id) LEFT JOIN rl USING (request_id) LEFT JOIN h ON h.sk = {_KEY.format("rq.tn", "rq.subject_id")} LEFT JOIN dt ON dt.sk = {_KEY.format("rq.tn", "rq.subject_id")}
      LEFT JOIN sl ON sl.sk = {_KEY.format("rq.tn", "rq.subject_id")}),
  c AS (SELECT *, CASE WHEN len(facts) > 0 THEN subject_id || ' — ' || array_to_string(facts[1:3], '; ') ELSE 'Subject: ' || subject_id END AS summary,
    CASE WHEN len(issue) > 1 THEN issue[1] || ' (+ ' || (len(issue) - 1) || ' more messages in session)' WHEN len(issue) = 1 THEN issue[1] ELSE '' END AS active,
    CASE state WHEN 'at_risk' THEN '🔴' WHEN 'watch' THEN '🟡' ELSE '🟢' END || ' Health: ' || upper(state) || ' (score: ' || score || ')' || CASE WHEN len(tops) > 0 THEN ' — ' || array_to_string(tops, '; ') ELSE '' END AS mood FROM b),
  d AS (SELECT *, left(concat('# Handoff Brief — ', subject_id, chr(10), 'Reason: escalation', chr(10), 'Session: ', cur, chr(10), chr(10), {_part("Customer", "[summary]", "")}, {_part("Customer Health", "[mood]", "")}, {_part("SLA Status", "late")},
    {_part("Active Issue", "list_filter([active], lambda x: x <> '')", "")}, {_part("What Has Been Tried", "steps[1:5]")}, CASE WHEN len(solved) > 0 THEN left({_part("Open Issues", "open_issues")}, -1) ELSE {_part("Open Issues", "open_issues")} END, {_part("Previously Resolved", "solved[1:3]")}, {_part("Key Facts", "facts[1:8]")},
    {_part("Recent Context (other sessions)", "others")}), -1) AS notes FROM c)
  SELECT request_id, tn AS tenant_id, subject_id, cur AS session_id, 'escalation' AS reason, summary AS customer_summary, active AS active_issue, {", ".join(f"array_to_string({e}, '|') AS {n}" for e, n in (
      ("steps[1:5]", "attempted_steps"), ("facts[1:8]", "key_facts"), ("others", "recent"), ("open_issues", "open_issues"), ("solved", "resolved"), ("fact_ids", "fact_ids"), ("issue_ids", "issue_ids"), ("resolution_ids", "resolution_ids"), ("recent_ids", "recent_ids")))},
    score AS health_score, state AS health_state, CASE WHEN {_TOKENS.format("notes")} > 300 THEN regexp_extract(notes, '^(?:\\s*(?:\\w+|[^\\w\\s])){{300}}', 0) ELSE notes END AS handoff_notes, CAST(least({_TOKENS.format("notes")}, 300) AS INT) AS token_estimate FROM d"""

QUERIES = {
    f.__name__: f
    for f in (
        search_memories, indexed_search, semantic_topk, semantic_topk_recall, indexed_topk, hash_embedding, embedding_backfill, query_vector_cache, memory_scores, memory_breadcrumbs, episode_scores,
        repeat_issue_sessions, memory_scores_in_full, assemble_context, handoff_brief,
    )
}
ORACLES = {
    "search_memories": f"""{_M}, s AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, subject_id ORDER BY created_at DESC, memory_id) AS rn FROM m WHERE kind = 'episode_summary' AND content ILIKE '%EXPORT job%')
      SELECT subject_id, memory_id, content, {_t("created_at")} AS created_at FROM s WHERE rn <= 20""",
    "semantic_topk": f"""{oracle_ctes("vectors")}, v AS (SELECT *, CAST(substr(memory_id, 5) AS BIGINT) AS n, embedding::DOUBLE[] AS e FROM vectors),
      p AS (SELECT 'q-' || q.memory_id AS query_id, v.memory_id, 1 - list_cosine_similarity(q.e, v.e) AS d FROM v q JOIN v ON q.subject_id = v.subject_id AND (q.tenant_id IS NULL OR q.tenant_id = v.tenant_id) AND q.n % 50 = 0 AND v.status = 'active'),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), memory_id) AS INT) AS rank FROM p) SELECT query_id, rank, memory_id, round(d, 6) AS distance FROM r WHERE rank <= 10""",
    "semantic_topk_recall": "SELECT count(*) AS queries, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 50 = 0",
    "indexed_topk": "SELECT count(*) AS queries, true AS recall_of_nine_tenths, true AS less_than_half_the_work FROM embeddings WHERE vec_id % 50 = 0",
    "embedding_backfill": f"{_M} SELECT kind, CASE kind WHEN 'profile_fact' THEN 1 ELSE 16 END AS dim, count(*) AS n FROM m GROUP BY ALL",
    "query_vector_cache": f"""{_M}, l AS (SELECT sha256(text) AS k, created_at FROM texts WHERE payload <> '{{"note":1}}'), o AS (SELECT k, max(created_at) + INTERVAL 48 HOUR AS x FROM l WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY ALL),
      n AS (SELECT DISTINCT k FROM l WHERE created_at >= TIMESTAMP '2024-01-20')
      SELECT (SELECT count(*) FROM o JOIN n USING (k) WHERE x > TIMESTAMP '2024-01-20 12:00:00') AS hits,
      (SELECT count(*) FROM n) + (SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM n) AND x >= TIMESTAMP '2024-01-13 12:00:00') AS entries, (SELECT count(*) FROM n) AS refreshed""",
    "memory_scores": f"""{_M}, {_REQ}, {_MEMORY_POOL}
      SELECT request_id, memory_id, round({_MEMORY_SCORE}, 6)::DOUBLE AS score, CASE kind WHEN 'profile_fact' THEN 'facts' ELSE 'history' END AS section, {_MEMORY_LINE} AS line FROM l WINDOW w AS (PARTITION BY request_id)""",
    "memory_scores_in_full": f"""{_M}, {_REQ}, v AS (SELECT rq.request_id, m.*, CAST(substr(m.episode_id, 4) AS BIGINT) AS ev FROM m JOIN rq ON {_SEES.format("m")}),
      f AS (SELECT request_id, memory_id, d, row_number() OVER (PARTITION BY request_id ORDER BY d, memory_id) AS rk FROM (SELECT *, ev % 10 / 8.0::DOUBLE AS d FROM v WHERE ev % 5 = 1)),
      x AS (SELECT v.*, CASE WHEN rk <= 100 THEN d END AS d, row_number() OVER (PARTITION BY v.request_id, kind ORDER BY created_at DESC, memory_id) AS rn FROM v LEFT JOIN f USING (request_id, memory_id)),
      l AS (SELECT * FROM x WHERE d IS NOT NULL OR rn <= CASE kind WHEN 'profile_fact' THEN 50 ELSE 30 END)
      SELECT request_id, memory_id, round(CASE kind WHEN 'profile_fact' THEN 10.0 ELSE 5.0 END + {_RECENCY} + coalesce(CASE WHEN d IS NOT NULL THEN greatest(0, 1 - d) * 8.0 END, len(list_intersect({_TASK_WORDS}, {_WORDS.format("content")})) / 8 * 5.0)
          + CASE WHEN ev % 4 < 2 AND epoch_us(created_at) + (ev % 40) * 86400000000 <= epoch_us(TIMESTAMP '{AS_OF}') THEN -4.0 ELSE 3.0 END + CASE WHEN ev % 3 = 0 THEN 1.5 ELSE 0 END, 6)::DOUBLE AS score,
        CASE kind WHEN 'profile_fact' THEN 'facts' ELSE 'history' END AS section FROM l WINDOW w AS (PARTITION BY request_id)""",
    "assemble_context": f"""{_POOL.replace("WITH ", "WITH RECURSIVE ", 1)}, {_MEMORY_POOL},
      ms AS (SELECT request_id, memory_id AS id, {_MEMORY_SCORE} AS score, CASE kind WHEN 'profile_fact' THEN 0 ELSE 2 END AS pool, rn, NULL::VARCHAR AS session_id, {_MEMORY_LINE} AS line FROM l WINDOW w AS (PARTITION BY request_id)),
      {_EPISODE_STATES}, es AS (SELECT request_id, episode_id AS id, {_EPISODE_SCORE} AS score, 3 AS pool, rn, session_id, {_EPISODE_LINE} AS line FROM ep LEFT JOIN st USING (request_id, session_id) LEFT JOIN rep USING (request_id, session_id)
        WINDOW w AS (PARTITION BY request_id)),
      it AS (SELECT * FROM ms UNION ALL SELECT * FROM es WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.request_id = es.request_id AND l.episode_id = es.id AND l.kind = 'episode_summary')),
      n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, pool, rn, id) AS k, {_TOKENS.format("line")} AS tk FROM it),
      hd AS (SELECT *, '## Task' || chr(10) || '{TASK}' || chr(10) AS head FROM rq),
      g AS (SELECT request_id, 0::BIGINT AS k, {_TOKENS.format("head")} AS used, false AS kept FROM hd
        UNION ALL SELECT g.request_id, n.k, CASE WHEN used + tk + 10 <= 300 THEN used + tk ELSE used END, used + tk + 10 <= 300 FROM g JOIN n ON n.request_id = g.request_id AND n.k = g.k + 1),
      o AS (SELECT n.*, n.session_id = cur AS mine FROM g JOIN n USING (request_id, k) JOIN rq USING (request_id) WHERE kept),
      ss AS (SELECT request_id, string_agg(session_id, ',' ORDER BY k) AS sessions FROM (SELECT request_id, session_id, min(k) AS k FROM o WHERE session_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
      a AS (SELECT request_id, {", ".join(f"coalesce(string_agg(id, ',' ORDER BY k) FILTER (pool = {i}), '') AS {c}" for i, c in enumerate(("f", "p", "s", "e")))},
          {", ".join(f"string_agg(line, chr(10) ORDER BY k) FILTER ({w}) AS {c}" for c, w in (("l0", "pool = 0"), ("l2", "pool = 2"), ("l3", "pool = 3 AND coalesce(mine, false)"), ("l4", "pool = 3 AND NOT coalesce(mine, false)")))} FROM o GROUP BY ALL),
      t AS (SELECT hd.*, a.* EXCLUDE (request_id), concat(head, chr(10) || '## About this user' || chr(10) || l0 || chr(10), chr(10) || '## Recent history' || chr(10) || l2 || chr(10),
          CASE WHEN l3 IS NOT NULL OR l4 IS NOT NULL THEN chr(10) || '## Recent interactions' || chr(10) || concat_ws(chr(10), '### Current session (' || cur || ')' || chr(10) || l3, '### Previous interactions' || chr(10) || l4) || chr(10) END) AS txt
        FROM hd LEFT JOIN a USING (request_id))
      SELECT request_id, tn AS tenant_id, subject_id, '{TASK}' AS task, coalesce(f, '') AS fact_ids, coalesce(p, '') AS procedure_ids, coalesce(s, '') AS summary_ids, coalesce(e, '') AS episode_ids, coalesce(sessions, '') AS sessions,
        txt AS assembled_context, CAST({_TOKENS.format("txt")} AS INT) AS token_estimate, (SELECT max(used) FROM g WHERE g.request_id = t.request_id) AS budget_used FROM t LEFT JOIN ss USING (request_id)""",
    "handoff_brief": _BRIEF,
    "memory_breadcrumbs": f"{_M} SELECT memory_id, concat('Guide > Part ', CAST(substr(episode_id, 4) AS BIGINT) % 7) AS breadcrumbs FROM m WHERE CAST(substr(episode_id, 4) AS BIGINT) % 3 = 0",
    "repeat_issue_sessions": f"{_POOL} SELECT request_id, session_id, repeat FROM rep",
    "episode_scores": f"""{_POOL}, {_EPISODE_STATES} SELECT request_id, episode_id, round({_EPISODE_SCORE}, 6)::DOUBLE AS score, {_EPISODE_LINE} AS line
      FROM ep LEFT JOIN st USING (request_id, session_id) LEFT JOIN rep USING (request_id, session_id) WINDOW w AS (PARTITION BY request_id)""",
}
ORACLES["indexed_search"] = ORACLES["search_memories"]
