"""Queries over lifecycles, documents, packs and streams, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import stamp
from recollect.functions.vectors import Provider
from recollect.operators import compile as comp
from recollect.operators import documents, lifecycle, store, usage
from recollect.operators.common import SUBJECT, join_on
from recollect.plans.support import _M, _t
from recollect.sources.adapters import AS_OF, EPISODES_SQL, _stamps, episodes, jobs, markdown, oracle_ctes, outbox, resolutions, whole_markdown
from recollect.sources.scratch import scratch, settled
from recollect.streaming import backfill, ingest
from recollect.streaming import jobs as streams


def _full(df: DataFrame) -> DataFrame:
    return df.withColumns({"metadata": F.lit("{}"), "provenance": F.lit("{}")})


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    eps = _full(episodes(spark, sf_dir))
    return eps, comp.compile_memories(comp.uncompiled(eps, cap=None))


def _one_in_three(eps: DataFrame) -> DataFrame:
    """Subjects to delete or seed anew: the operation's own argument."""
    n = F.substring("subject_id", 6, 20).cast("long")
    return eps.select(*SUBJECT).distinct().where(n % 3 == 0)


def _every(eps: DataFrame) -> DataFrame:
    return eps.select(*SUBJECT).distinct()


def _named(prefix: str) -> Column:
    """A new name for a tenant's subject."""
    return F.concat(F.lit(prefix), F.coalesce("tenant_id", F.lit("")), F.lit("-"), "subject_id")


def upsert_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = resolutions(spark, sf_dir)
    later = res.where("status = 'open'").withColumns({
        "resolution_id": F.concat(F.lit("new-"), "resolution_id"), "status": F.lit("resolved"), "resolved_at": F.lit(AS_OF).cast("timestamp"), "updated_at": F.lit(AS_OF).cast("timestamp"),
    })
    rows = lifecycle.upsert_resolutions(res, later)
    return rows.select("resolution_id", "session_id", "status", stamp(F.col("resolved_at")).alias("resolved_at"), stamp(F.col("created_at")).alias("created_at"))


def _snapshots(spark: SparkSession, sf_dir: str):
    eps, mem = _both(spark, sf_dir)
    catalog = spark.createDataFrame([], "snapshot_id string, name string, version int, source_subject_id string, episode_count long, memory_count long, created_at timestamp")
    requests = _every(eps).withColumn("name", F.concat(F.lit("base-"), F.substring("subject_id", -1, 1)))
    return lifecycle.create_snapshot(eps, mem, resolutions(spark, sf_dir), requests, catalog, AS_OF)


def create_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir)[3].drop("created_at")


def create_snapshot_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return create_snapshot(spark, sf_dir)


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_snapshot(create_snapshot(spark, sf_dir)).select("name", "version", "source_subject_id")


def latest_snapshot_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_snapshot(spark, sf_dir)


def restore_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _restored(*_snapshots(spark, sf_dir))


def restore_snapshot_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore_snapshot(spark, sf_dir)


def _restored(eps: DataFrame, mem: DataFrame, _: DataFrame, catalog: DataFrame) -> DataFrame:
    requests = catalog.select("snapshot_id", F.concat(F.lit("live-"), F.substring("snapshot_id", 1, 12)).alias("target_id"))
    e, m = lifecycle.restore_snapshot(eps, mem, requests, AS_OF)
    ids = e.select(F.col("episode_id").alias("source")).distinct()
    cites = m.select("subject_id", F.explode("source_episode_ids").alias("source")).join(ids, "source").groupBy("subject_id").agg(F.count("*").alias("cites"))
    times = e.groupBy("subject_id").agg(F.count("*").alias("episodes"), F.min(stamp(F.col("created_at"))).alias("first_at"), F.max(stamp(F.col("created_at"))).alias("last_at"))
    return times.join(cites, "subject_id", "left")


def clone_all_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clone_subjects(spark, sf_dir)


def clone_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps, mem = _both(spark, sf_dir)
    targets = _every(eps).withColumn("target_id", _named("copy-of-"))
    e, m = lifecycle.clone_subjects(eps, mem, targets, AS_OF)
    origin = F.get_json_object("provenance", "$.cloned_from_subject_id").alias("origin")
    one = e.select("subject_id", origin, F.lit(1).alias("e"), F.lit(0).alias("m"))
    two = m.select("subject_id", F.get_json_object("metadata", "$.cloned_from_subject_id").alias("origin"), F.lit(0).alias("e"), F.lit(1).alias("m"))
    return one.union(two).groupBy("subject_id", "origin").agg(F.sum("e").alias("episodes"), F.sum("m").alias("memories"))


def export_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.export_subjects(*_both(spark, sf_dir), AS_OF)
    return rows.where("part = 1").select(*SUBJECT, "format_version", "episode_count", "memory_count", "too_large", "document", "checksum")


def verify_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of which some were changed on the way: text added, or an unknown format."""
    rows = settled(spark, lambda: lifecycle.export_subjects(*_both(spark, sf_dir), AS_OF), "exports")
    n = F.substring("subject_id", 6, 20).cast("long")
    rows = rows.withColumns({
        "document": F.when(n % 7 == 0, F.concat("document", F.lit(" "))).otherwise(F.col("document")),
        "format_version": F.when(n % 11 == 0, "other").otherwise(F.col("format_version")),
    })
    return lifecycle.verify_export(rows).groupBy(*SUBJECT).agg(F.min("problem").alias("problem"))


def import_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settled(spark, lambda: lifecycle.export_subjects(*_both(spark, sf_dir), AS_OF), "exports")
    targets = docs.where("part = 1").select(*SUBJECT, _named("in-").alias("target_id"))
    e, m = lifecycle.import_payload(docs, targets, AS_OF, tenant_id="acme")
    a = e.groupBy("subject_id").agg(F.count("*").alias("episodes"), F.max(stamp(F.col("created_at"))).alias("last_at"))
    b = m.groupBy("subject_id").agg(F.count("*").alias("memories"), F.sum(F.size("source_episode_ids")).alias("cites"), F.max("tenant_id").alias("tenant_id"))
    return a.join(b, "subject_id", "left")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("episode_id", 4, 20).cast("long")
    own = F.concat(F.lit('{"starter_pack_id":"demo","starter_pack_version":"'), (n % 4).cast("string"), F.lit('"}'))
    old = F.when(n % 6 == 3, '{"pack":"demo"}').otherwise("{}")
    return episodes(spark, sf_dir).withColumn("metadata", F.when(n % 3 == 0, F.when(n % 2 == 0, own).otherwise(old)).otherwise("{}"))


def pack_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.pack_state(_packed(spark, sf_dir), "demo")


def reseed_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packed(spark, sf_dir)
    fresh = _one_in_three(rows).select(*SUBJECT, F.lit("fresh").alias("episode_id"), F.lit('{"starter_pack_id":"demo"}').alias("metadata"))
    out = lifecycle.reseed_pack(rows, fresh, "demo")
    return out.groupBy(*SUBJECT).agg(F.count("*").alias("n"), F.count_if(F.col("episode_id") == "fresh").alias("fresh"))


def delete_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = episodes(spark, sf_dir)
    return lifecycle.delete_subjects(eps, _one_in_three(eps)).groupBy("subject_id").agg(F.count("*").alias("n"))


def purge_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps, mem = _both(spark, sf_dir)
    found = eps.where("tenant_id = 'acme'").select(*SUBJECT).distinct()
    e, m = lifecycle.purge_subjects(found, found.count(), eps, mem)
    return e.agg(F.count("*").alias("episodes")).crossJoin(m.agg(F.count("*").alias("memories")))


def purge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.purge_jobs(jobs(spark, sf_dir), "1996-01-01 00:00:00", tenant_id="acme", older_than_hours=lifecycle.RETENTION_HOURS)
    return rows.groupBy("status", "tenant_id").agg(F.count("*").alias("n"))


def purge_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.purge_outbox(outbox(spark, sf_dir), AS_OF, status="dead_letter").groupBy("status").agg(F.count("*").alias("n"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.chunk_documents(markdown(spark, sf_dir)).select("doc_path", "section", "heading", "breadcrumb", "url", "content_hash")


def chunk_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all of every text, with a long last one; chunk_documents cuts it at every line."""
    rows = documents.chunk_documents(whole_markdown(spark, sf_dir))
    return rows.select("doc_path", "section", "heading", "breadcrumb", "url", "content_hash")


def write_pack_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps, mem = _both(spark, sf_dir)
    eps = eps.withColumn("provenance", F.to_json(F.struct(F.sha2("episode_id", 256).alias("content_hash"))))
    folder = scratch(spark, "pack")
    documents.write_pack_jsonl(eps, mem, folder)
    e = documents.read_pack_jsonl(spark, f"{folder}/episodes.jsonl", documents.PACK_EPISODE)
    m = documents.read_pack_jsonl(spark, f"{folder}/memories.jsonl", documents.PACK_MEMORY)
    cites = m.select("kind", F.explode("source_episode_ids").alias("id")).join(e.select("id"), "id")
    return cites.groupBy("kind").agg(F.count("*").alias("cites"), F.count_distinct("id").alias("episodes"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return streams.read_stream(spark, sf_dir, "events", schema)


def stream_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream-compile")
    eps = _stamps(spark.sql(EPISODES_SQL, events=_events(spark, sf_dir)))
    memories = streams.stream_compile(eps)
    streams.run_to_end(memories, f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema(memories.schema).parquet(f"{out}/rows")
    return rows.select("memory_id", "subject_id", "kind", "content")


def minute_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "minute-hits")
    events = _stamps(_events(spark, sf_dir)).select((F.col("user_id") % 7).alias("key"), "ts")
    hits = streams.minute_hits(events, rpm=2)
    streams.upsert_to_end(hits, f"{out}/rows", f"{out}/checkpoint")
    rows = streams.latest(spark.read.parquet(f"{out}/rows"), "key", "window_start")
    return rows.select("key", stamp(F.col("window_start")).alias("window_start"), "hits", "limited", "retry_after")


def sliding_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stamps(spark.read.parquet(f"{sf_dir}/events.parquet")).select((F.col("user_id") % 7).alias("key"), "event_id", "ts")
    return streams.sliding_admission(events, rpm=5, seconds=3600.0).select("key", "event_id", "admitted")


def _in_batches(spark: SparkSession, rows: DataFrame, at: str, folder: str, files: int = 4) -> DataFrame:
    """Rows as a stream of so many batches that each hold some of all times, and a last one that only moves the watermark on."""
    rows.repartition(files, F.xxhash64(*rows.columns)).write.parquet(folder)
    end = rows.agg((F.max(at) + F.expr("INTERVAL 1000 DAYS")).alias(at))
    end.select(*[F.col(at) if n == at else F.lit(None).cast(t).alias(n) for n, t in rows.dtypes]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def sliding_admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "admission")
    events = _stamps(spark.read.parquet(f"{sf_dir}/events.parquet")).select((F.col("user_id") % 7).alias("key"), "event_id", "ts")
    stream = _in_batches(spark, events, "ts", f"{out}/source")
    judged = streams.sliding_admission_stream(stream, rpm=5, seconds=3600.0, delay="400 days")
    streams.run_to_end(judged, f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema(judged.schema).parquet(f"{out}/rows")
    return rows.where("key IS NOT NULL").select("key", "event_id", "admitted", "late")


def health_alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tenants share a fifth of the subjects, as in the model tables."""
    out = scratch(spark, "health-alerts")
    e = episodes(spark, sf_dir)
    state = F.when(F.col("source") == "user", "at_risk").when(F.col("source") == "chat", "watch").otherwise("healthy")
    states = e.select("tenant_id", "subject_id", state.alias("state"), F.col("created_at").alias("updated_at"))
    alerts = streams.health_alert_stream(_in_batches(spark, states, "updated_at", f"{out}/source"), "400 days")
    streams.run_to_end(alerts, f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema(alerts.schema).parquet(f"{out}/rows")
    return rows.withColumn("updated_at", stamp(F.col("updated_at")))


def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions in a store: one subject in a hundred is purged, then every tenth session's state comes anew."""
    path = scratch(spark, "resolution-store")
    rows = resolutions(spark, sf_dir).select("resolution_id", "tenant_id", "subject_id", "session_id", "status", "updated_at")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    n = F.substring("subject_id", 6, 20).cast("long")
    store.create_store(rows, path, buckets=16)
    store.purge_stored(spark, path, schema, rows.where(n % 100 == 7))
    new = rows.where((n % 10 == 3) & F.col("session_id").endswith("1"))
    new = new.withColumns({"status": F.lit("reopened"), "updated_at": F.lit(AS_OF).cast("timestamp")})
    store.upsert_stored(spark, path, schema, new, ("tenant_id", "subject_id", "session_id"), "updated_at")
    return store.read_store(spark, path, schema).groupBy("tenant_id", "status").agg(F.count("*").alias("n"), F.max(stamp(F.col("updated_at"))).alias("last_at"))


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes in three batches, in which some are broken, some come twice in a batch and some again in a later one."""
    out, eps = scratch(spark, "ingest"), episodes(spark, sf_dir)
    eps = eps.withColumns({"metadata": F.lit(None).cast("string"), "provenance": F.lit(None).cast("string"), "n": F.substring("episode_id", 4, 20).cast("long")})
    eps = eps.withColumn("payload", F.when(F.col("n") % 13 == 0, '["list"]').otherwise(F.col("payload")))
    twice = eps.where("n % 3 = 2 AND n % 7 = 0")
    batches = [eps.where("n % 3 = 0"), eps.where("n % 3 = 1").unionByName(eps.where("n % 3 = 0 AND n % 5 = 0")), eps.where("n % 3 = 2").unionByName(twice)]
    for rows in batches:
        rows.drop("n").coalesce(1).write.mode("append").parquet(f"{out}/source")
    schema = eps.drop("n").schema
    ingest.ingest_to_end(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/source"), f"{out}/store", f"{out}/checkpoint", buckets=8)
    ddl = ", ".join(f"{n} {t}" for n, t in eps.drop("n").dtypes)
    fine = ingest.stored_episodes(spark, f"{out}/store", ddl).select(F.lit(None).cast("string").alias("rejected"))
    return fine.union(ingest.rejected_episodes(spark, f"{out}/store", ddl).select("rejected")).groupBy("rejected").agg(F.count("*").alias("n"))


def _lengths(texts: list[str]) -> np.ndarray:
    """Stands for a provider: a vector that SQL can tell, too."""
    return np.array([[len(t), 1.0] for t in texts], np.float32).reshape(len(texts), 2)


def backfill_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that lack a vector, in two batches, through a provider with its cache."""
    out = scratch(spark, "backfill")
    rows = comp.compile_memories(comp.uncompiled(episodes(spark, sf_dir), cap=None))
    old = F.when(F.substring("memory_id", 1, 1) == "0", F.array(F.lit(-1.0)).cast("array<float>"))
    rows = rows.select("memory_id", "kind", "content", old.alias("embedding"))
    rows.repartition(2, "memory_id").write.parquet(f"{out}/memories")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/memories")
    backfill.backfill_to_end(stream, f"{out}/store", f"{out}/checkpoint", Provider(_lengths), "lengths")
    filled = backfill.with_vectors(spark, spark.read.schema(rows.schema).parquet(f"{out}/memories"), f"{out}/store")
    cached = spark.read.parquet(f"{out}/store/cache").agg(F.count("*").alias("cached"))
    first = F.get("embedding", F.lit(0)).cast("long")
    return filled.groupBy("kind").agg(F.count("embedding").alias("n"), F.sum(first).alias("total")).crossJoin(cached)  # one row


def rolling_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of the last 1, 7 and 30 days from day sketches, and whether the estimated subjects are within three errors of the exact ones."""
    path, eps = scratch(spark, "usage"), episodes(spark, sf_dir)
    tables = {"episodes": eps, "resolutions": resolutions(spark, sf_dir)}
    usage.store_days(tables, path, "2023-12-01", "2024-01-15")
    usage.store_days(tables, path, "2024-01-16", "2024-01-20")
    got = usage.rolling_usage(spark, path, "2024-01-20")
    exact, end = None, F.lit("2024-01-20").cast("date")
    for name, df in tables.items():
        day = F.to_date("created_at")
        of = df.withColumn("days", F.explode(F.array(*[F.when((day <= end) & (day > F.date_sub(end, n)), n) for n in (1, 7, 30)]))).where("days IS NOT NULL")
        one = of.groupBy("tenant_id", F.lit(name).alias("metric"), "days").agg(F.count_distinct("subject_id").alias("exact"))
        exact = one if exact is None else exact.union(one)
    rows = join_on(got, exact, ("tenant_id", "metric", "days"))
    near = F.abs(F.col("subjects") - F.col("exact")) <= F.greatest(F.lit(1), F.ceil(3 * usage.ERROR * F.col("exact")))
    return rows.select("tenant_id", "metric", "days", "n", "exact", near.alias("near"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"episodes": episodes(spark, sf_dir), "resolutions": resolutions(spark, sf_dir), "jobs": jobs(spark, sf_dir)}
    return usage.usage_rollup(tables)


def outbox_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox(spark, sf_dir)
    due = streams.due_events(rows, "1997-01-01 00:00:00", most=None)
    n = F.substring("event_id", 6, 20).cast("long")
    ok = n % 3 > 0
    results = due.select("event_id", ok.alias("ok"), F.when(ok, 200).when(n % 3 == 0, F.when(n % 2 == 0, 503)).alias("http_status"), F.when(~ok, F.concat(F.lit("HTTP "), "event_id")).alias("error"))
    after = streams.outbox_advance(rows, results, "1997-01-01 00:00:00")
    return after.select(
        "event_id", "status", "attempts", stamp(F.col("next_attempt_at")).alias("next_attempt_at"), stamp(F.col("last_attempt_at")).alias("last_attempt_at"),
        stamp(F.col("delivered_at")).alias("delivered_at"), "last_error", "http_status",
    )


_E = oracle_ctes("episodes")
_S = "s3 AS (SELECT DISTINCT tenant_id, subject_id, sk FROM episodes WHERE CAST(substr(subject_id, 6) AS BIGINT) % 3 = 0)"
_ALL = "s3 AS (SELECT DISTINCT tenant_id, subject_id, sk FROM episodes)"
_SNAP = f"""{_M}, {_ALL}, sn AS (SELECT *, 'base-' || substr(subject_id, -1) AS name FROM s3), sv AS (SELECT *, sha256(concat_ws('|', 'snapshot', name, CAST(version AS STRING), subject_id)) AS snapshot_id
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY subject_id, tenant_id NULLS FIRST) AS INT) AS version FROM sn))"""
_PACKED = f"""{_E}, pk AS (SELECT *, n % 3 = 0 AND (n % 2 = 0 OR n % 6 = 3) AS owned, CASE WHEN n % 6 = 0 THEN CAST(n % 4 AS STRING) END AS version FROM (SELECT *, CAST(substr(episode_id, 4) AS BIGINT) AS n FROM episodes))"""
_MD = f"""{oracle_ctes("markdown")}, ln AS (SELECT doc_path, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_path, string_split(text, chr(10)) AS ls FROM markdown)),
  fx AS (SELECT *, starts_with(trim(line), '```') AS fence FROM ln), fi AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_path ORDER BY pos) % 2 AS inside FROM fx),
  hd AS (SELECT *, CASE WHEN NOT fence AND inside = 0 THEN length(regexp_extract(line, '^(#{{1,3}})\\s+(.+?)\\s*$', 1)) ELSE 0 END AS lv FROM fi),
  sc AS (SELECT *, sum((lv > 0)::INT) OVER (PARTITION BY doc_path ORDER BY pos) AS section, CASE WHEN lv > 0 THEN regexp_extract(line, '^(#{{1,3}})\\s+(.+?)\\s*$', 2) END AS title FROM hd),
  g AS (SELECT doc_path, section, max(title) AS heading, max(lv) AS lv, trim(string_agg(line, chr(10) ORDER BY pos) FILTER (lv = 0), chr(10) || chr(13) || chr(9) || ' ') AS text FROM sc
    WHERE section > 0 OR doc_path NOT IN (SELECT doc_path FROM sc WHERE section > 0) GROUP BY ALL),
  h1 AS (SELECT *, last_value(CASE WHEN lv = 1 THEN heading END IGNORE NULLS) OVER w AS parent, last_value(CASE WHEN lv = 2 THEN heading END IGNORE NULLS) OVER w AS parent2 FROM g
    WINDOW w AS (PARTITION BY doc_path ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

QUERIES = {
    f.__name__: f
    for f in (
        upsert_resolutions, create_snapshot, latest_snapshot, restore_snapshot, clone_subjects, create_snapshot_of_all, latest_snapshot_of_all,
        restore_snapshot_of_all, clone_all_subjects, export_subjects, verify_export, import_payload, pack_state,
        reseed_pack, delete_subject, purge_subjects, purge_jobs, purge_outbox, chunk_documents, chunk_whole_documents, write_pack_jsonl, stream_compile, minute_hits,
        sliding_admission, sliding_admission_stream, health_alert_stream, outbox_advance, ingest_stream,
        backfill_stream, stored_changes, rolling_usage, usage_rollup,
    )
}
ORACLES = {
    "upsert_resolutions": f"""{oracle_ctes("episodes", "resolutions")} SELECT resolution_id, session_id, CASE status WHEN 'open' THEN 'resolved' ELSE status END AS status,
      CASE status WHEN 'open' THEN {_t(f"TIMESTAMP '{AS_OF}'")} ELSE {_t("resolved_at")} END AS resolved_at, {_t("created_at")} AS created_at FROM resolutions""",
    "create_snapshot": f"""{_SNAP} SELECT snapshot_id, name, version, subject_id AS source_subject_id,
      (SELECT count(*) FROM episodes e WHERE e.sk = sv.sk) AS episode_count, (SELECT count(*) FROM m WHERE m.sk = sv.sk) AS memory_count FROM sv""",
    "latest_snapshot": f"{_SNAP} SELECT name, max(version) AS version, arg_max(subject_id, version) AS source_subject_id FROM sv GROUP BY ALL",
    "restore_snapshot": f"""{_SNAP}, t AS (SELECT snapshot_id, sk, count(*) AS n, min(created_at) AS lo, max(created_at) AS hi FROM episodes JOIN sv USING (sk) GROUP BY ALL),
      c AS (SELECT sk, count(*) AS n FROM m GROUP BY ALL) SELECT 'live-' || substr(snapshot_id, 1, 12) AS subject_id, t.n AS episodes, {_t(f"lo + (TIMESTAMP '{AS_OF}' - hi)")} AS first_at, {_t(f"TIMESTAMP '{AS_OF}'")} AS last_at, c.n AS cites
      FROM t LEFT JOIN c USING (sk)""",
    "clone_subjects": f"""{_M}, {_ALL} SELECT concat('copy-of-', coalesce(tenant_id, ''), '-', subject_id) AS subject_id, subject_id AS origin, (SELECT count(*) FROM episodes e WHERE e.sk = s3.sk) AS episodes,
      (SELECT count(*) FROM m WHERE m.sk = s3.sk) AS memories FROM s3""",
    "export_subjects": f"""{_M}, x AS (SELECT tenant_id, subject_id, 0 AS kind, created_at, episode_id AS id, concat('{{"episode_id":"', episode_id, '","source":"', source, '","type":"', type, '","payload":', to_json(payload),
        ',"metadata":"{{}}","provenance":"{{}}","created_at":"', {_t("created_at")}, '"}}') AS row FROM episodes
      UNION ALL SELECT tenant_id, subject_id, 1, created_at, memory_id, concat('{{"memory_id":"', memory_id, '","kind":"', kind, '","content":', to_json(content), ',"summary":', to_json(substr(content, 1, 200)), ',"confidence":', confidence,
        ',"valid_from":"', {_t("created_at")}, '","source_episode_ids":["', episode_id, '"],"metadata":"{{}}","status":"active","created_at":"', {_t("created_at")}, '"}}') FROM m),
      d AS (SELECT tenant_id, subject_id, count(*) FILTER (kind = 0) AS e, count(*) FILTER (kind = 1) AS m, concat('{{"episodes":[', coalesce(string_agg(row, ',' ORDER BY x.created_at, id) FILTER (kind = 0), ''),
        '],"memories":[', coalesce(string_agg(row, ',' ORDER BY x.created_at, id) FILTER (kind = 1), ''), ']}}') AS document FROM x GROUP BY ALL)
      SELECT tenant_id, subject_id, 'recollect-export-1' AS format_version, e AS episode_count, m AS memory_count, false AS too_large, document, sha256(document) AS checksum FROM d""",
    "verify_export": f"""{_E} SELECT DISTINCT tenant_id, subject_id, CASE WHEN CAST(substr(subject_id, 6) AS BIGINT) % 11 = 0 THEN 'format' WHEN CAST(substr(subject_id, 6) AS BIGINT) % 7 = 0 THEN 'checksum' END AS problem FROM episodes""",
    "import_payload": f"""{_M}, e AS (SELECT tenant_id, subject_id, sk, count(*) AS n, {_t("max(created_at)")} AS hi FROM episodes GROUP BY ALL), c AS (SELECT sk, count(*) AS n FROM m GROUP BY ALL)
      SELECT concat('in-', coalesce(e.tenant_id, ''), '-', e.subject_id) AS subject_id, e.n AS episodes, hi AS last_at, c.n AS memories, c.n AS cites, CASE WHEN c.n IS NOT NULL THEN 'acme' END AS tenant_id FROM e LEFT JOIN c USING (sk)""",
    "pack_state": f"""{_PACKED} SELECT tenant_id, subject_id, count(*) AS total, count(*) FILTER (owned) AS owned, count(*) FILTER (NOT owned) AS operator_rows,
      arg_max_null(version, created_at) FILTER (owned) AS version FROM pk GROUP BY ALL""",
    "reseed_pack": f"""{_PACKED}, x AS (SELECT tenant_id, subject_id, CAST(substr(subject_id, 6) AS BIGINT) % 3 = 0 AS seeded, owned FROM pk)
      SELECT tenant_id, subject_id, count(*) FILTER (NOT (seeded AND owned)) + max(seeded::INT) AS n, CAST(max(seeded::INT) AS BIGINT) AS fresh FROM x GROUP BY ALL""",
    "delete_subject": f"{_E}, {_S} SELECT subject_id, count(*) AS n FROM episodes WHERE subject_id NOT IN (SELECT subject_id FROM s3) GROUP BY ALL",
    "purge_subjects": f"{_M} SELECT (SELECT count(*) FROM episodes WHERE tenant_id IS DISTINCT FROM 'acme') AS episodes, (SELECT count(*) FROM m WHERE tenant_id IS DISTINCT FROM 'acme') AS memories",
    "purge_jobs": f"""{oracle_ctes("jobs")} SELECT status, tenant_id, count(*) AS n FROM jobs WHERE NOT (status IN ('completed', 'failed') AND coalesce(tenant_id, '') = 'acme'
      AND created_at < TIMESTAMP '1995-12-25') GROUP BY ALL""",
    "purge_outbox": f"{oracle_ctes('outbox')} SELECT status, count(*) AS n FROM outbox WHERE status <> 'dead_letter' GROUP BY ALL",
    "chunk_documents": f"""{_MD}, o AS (SELECT *, array_to_string(list_filter([CASE WHEN lv > 1 THEN parent END, CASE WHEN lv > 2 THEN parent2 END, heading], lambda x: x IS NOT NULL), ' › ') AS breadcrumb FROM h1 WHERE text <> '')
      SELECT doc_path, CAST(section AS BIGINT) AS section, heading, breadcrumb, doc_path || coalesce('#' || regexp_replace(trim(regexp_replace(lower(trim(heading)), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '') AS url,
      sha256(text) AS content_hash FROM o""",
    "write_pack_jsonl": f"{_M} SELECT kind, count(*) AS cites, count(DISTINCT episode_id) AS episodes FROM m GROUP BY ALL",
    "stream_compile": f"{_M} SELECT memory_id, subject_id, kind, content FROM m",
    "minute_hits": """SELECT user_id % 7 AS key, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS hits, count(*) > 2 AS limited,
      CASE WHEN count(*) > 2 THEN CAST(greatest(1, 60 - second(max(ts))) AS INT) END AS retry_after FROM events GROUP BY user_id % 7, date_trunc('minute', ts)""",
    "sliding_admission": """WITH RECURSIVE e AS (SELECT CAST(user_id % 7 AS BIGINT) AS key, CAST(event_id AS BIGINT) AS event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 7 ORDER BY epoch_us(ts), event_id) AS k FROM events),
      r AS (SELECT key, 0::BIGINT AS k, NULL::BIGINT AS event_id, false AS admitted, []::BIGINT[] AS w FROM (SELECT DISTINCT key FROM e)
        UNION ALL SELECT key, k, event_id, len(w) < 5, CASE WHEN len(w) < 5 THEN list_append(w, t) ELSE w END FROM
          (SELECT e.key, e.k, e.event_id, e.t, list_filter(r.w, lambda v: v > e.t - 3600000000) AS w FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1))
      SELECT key, event_id, admitted FROM r WHERE k > 0""",
    "health_alert_stream": f"""{_E}, s AS (SELECT *, CASE source WHEN 'user' THEN 'at_risk' WHEN 'chat' THEN 'watch' ELSE 'healthy' END AS state FROM episodes),
      l AS (SELECT *, lag(state) OVER (PARTITION BY tenant_id, subject_id ORDER BY created_at, state) AS before FROM s),
      v AS (SELECT *, CASE state WHEN 'at_risk' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END - CASE before WHEN 'at_risk' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS worse FROM l)
      SELECT tenant_id, subject_id, CASE WHEN worse > 0 THEN 'subject.health_degraded' ELSE 'subject.health_improved' END AS event, coalesce(before, 'healthy') AS previous_state, state AS current_state,
      {_t("created_at")} AS updated_at FROM v WHERE worse > 0 OR (worse < 0 AND before IS NOT NULL)""",
    "outbox_advance": f"""{oracle_ctes("outbox")}, d AS (SELECT *, status = 'pending' AND next_attempt_at <= TIMESTAMP '1997-01-01' AS due, CAST(substr(event_id, 6) AS BIGINT) % 3 > 0 AS ok FROM outbox),
      a AS (SELECT *, CASE WHEN NOT due THEN status WHEN ok THEN 'delivered' WHEN attempts + 1 >= max_attempts THEN 'dead_letter' ELSE 'pending' END AS st FROM d)
      SELECT event_id, st AS status, attempts + due::INT AS attempts, {_t("CASE WHEN due AND st = 'pending' THEN TIMESTAMP '1997-01-01' + INTERVAL 30 SECOND * CAST(4 ** attempts AS INT) ELSE next_attempt_at END")} AS next_attempt_at,
        CASE WHEN due THEN {_t("TIMESTAMP '1997-01-01'")} END AS last_attempt_at, CASE WHEN due AND ok THEN {_t("TIMESTAMP '1997-01-01'")} END AS delivered_at, CASE WHEN due AND NOT ok THEN 'HTTP ' || event_id END AS last_error,
        CASE WHEN NOT due THEN NULL WHEN ok THEN 200 WHEN CAST(substr(event_id, 6) AS BIGINT) % 2 = 0 THEN 503 END AS http_status FROM a""",
}
_N = "SELECT CAST(event_id AS BIGINT) AS n FROM events"
ORACLES["ingest_stream"] = f"""WITH e AS ({_N}), c AS (SELECT n FROM e UNION ALL SELECT n FROM e WHERE n % 3 = 0 AND n % 5 = 0 UNION ALL SELECT n FROM e WHERE n % 3 = 2 AND n % 7 = 0),
  r AS (SELECT CASE WHEN n % 13 = 0 THEN 'payload' WHEN row_number() OVER (PARTITION BY n) > 1 THEN 'duplicate' END AS rejected FROM c) SELECT rejected, count(*) AS n FROM r GROUP BY ALL"""
ORACLES["backfill_stream"] = f"""{_M} SELECT kind, count(*) AS n, CAST(sum(CASE WHEN memory_id[1] = '0' THEN -1 ELSE length(content) END) AS BIGINT) AS total,
  (SELECT count(DISTINCT content) FROM m WHERE memory_id[1] <> '0') AS cached FROM m GROUP BY kind"""
ORACLES["stored_changes"] = f"""{oracle_ctes("episodes", "resolutions")}, k AS (SELECT *, CAST(substr(subject_id, 6) AS BIGINT) AS n FROM resolutions),
  c AS (SELECT tenant_id, CASE WHEN n % 10 = 3 AND ends_with(session_id, '1') THEN 'reopened' ELSE status END AS status,
    CASE WHEN n % 10 = 3 AND ends_with(session_id, '1') THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at FROM k WHERE n % 100 <> 7)
  SELECT tenant_id, status, count(*) AS n, max({_t("updated_at")}) AS last_at FROM c GROUP BY ALL"""
ORACLES["rolling_usage"] = f"""{oracle_ctes("episodes", "resolutions")}, u AS (SELECT 'episodes' AS metric, tenant_id, subject_id, created_at FROM episodes UNION ALL SELECT 'resolutions', tenant_id, subject_id, created_at FROM resolutions)
  SELECT tenant_id, metric, days, count(*) AS n, count(DISTINCT subject_id) AS exact, true AS near FROM u, (SELECT unnest([1, 7, 30])::INT AS days)
  WHERE CAST(created_at AS DATE) <= DATE '2024-01-20' AND CAST(created_at AS DATE) > DATE '2024-01-20' - days GROUP BY ALL"""
ORACLES["usage_rollup"] = f"""{oracle_ctes("episodes", "resolutions", "jobs")}, u AS (SELECT tenant_id, subject_id, 1 AS e, 0 AS r, 0 AS j FROM episodes UNION ALL SELECT tenant_id, subject_id, 0, 1, 0 FROM resolutions
  UNION ALL SELECT tenant_id, subject_id, 0, 0, 1 FROM jobs) SELECT CAST(GROUPING(tenant_id, subject_id) AS INT) AS level, tenant_id, subject_id, CAST(sum(e) AS BIGINT) AS episodes,
  CAST(sum(r) AS BIGINT) AS resolutions, CAST(sum(j) AS BIGINT) AS jobs FROM u GROUP BY ROLLUP (tenant_id, subject_id)"""
ORACLES["sliding_admission_stream"] = ORACLES["sliding_admission"].replace("SELECT key, event_id, admitted FROM r", "SELECT key, event_id, admitted, false AS late FROM r")
ORACLES["chunk_whole_documents"] = ORACLES["chunk_documents"].replace(
    oracle_ctes("markdown"), f"{oracle_ctes('whole_markdown')}, markdown AS (SELECT * FROM whole_markdown)"
)
for _whole, _part in (
    ("create_snapshot_of_all", "create_snapshot"), ("latest_snapshot_of_all", "latest_snapshot"), ("restore_snapshot_of_all", "restore_snapshot"),
    ("clone_all_subjects", "clone_subjects"),
):
    ORACLES[_whole] = ORACLES[_part]
