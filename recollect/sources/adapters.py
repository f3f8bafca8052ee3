"""Model tables out of the driver's tables, as SQL that Spark and DuckDB both read.

Braces name input tables: Spark fills them with DataFrames, the oracle with view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"

_BODY = """CASE event_type
    WHEN 'signup' THEN concat('My name is ', CASE user_id % 4 WHEN 0 THEN 'Ada Byron' WHEN 1 THEN 'Grace'
      WHEN 2 THEN 'Alan Mathison' ELSE 'Edsger' END, '. I work at Company', CAST(user_id % 7 AS STRING),
      ', I live in City', CAST(event_id % 5 AS STRING), '. I prefer ', CASE event_id % 3 WHEN 0 THEN 'dark mode'
      WHEN 1 THEN 'email updates' ELSE 'weekly email updates' END, '.')
    WHEN 'error' THEN CASE event_id % 3
      WHEN 0 THEN concat('urgent: the checkout page is broken, outage on shop ', CAST(event_id % 11 AS STRING))
      WHEN 1 THEN concat('the export job keeps failing with code ', CAST(event_id % 13 AS STRING))
      ELSE concat('cannot sign in to account ', CAST(user_id AS STRING), ' after the password change') END
    WHEN 'view' THEN 'ok thanks'
    WHEN 'click' THEN concat('Restarted the export job and cleared the cache for ticket ', CAST(event_id % 50 AS STRING))
    ELSE concat('Order ', CAST(event_id % 100 AS STRING), ' placed on plan ', CASE event_id % 2 WHEN 0 THEN 'basic' ELSE 'pro' END)
  END"""

EPISODES_SQL = f"""SELECT concat('ev-', CAST(event_id AS STRING)) AS episode_id,
  CASE WHEN user_id % 5 = 0 AND event_id % 3 = 0 THEN 'initech' WHEN user_id % 3 = 1 THEN 'acme' WHEN user_id % 3 = 2 THEN 'globex' END AS tenant_id,
  concat('user-', CAST(user_id AS STRING)) AS subject_id,
  CASE WHEN event_id % 10 <> 0 THEN concat('s-', CAST(user_id AS STRING), '-',
    CAST(CAST(floor((dayofyear(ts) - 1) / 3) AS BIGINT) AS STRING)) END AS session_id,
  CASE event_type WHEN 'error' THEN 'user' WHEN 'view' THEN 'chat' WHEN 'click' THEN 'agent'
    WHEN 'purchase' THEN 'system' ELSE 'crm' END AS source,
  CASE event_type WHEN 'click' THEN 'action' WHEN 'purchase' THEN 'tool_call'
    WHEN 'signup' THEN 'profile_update' ELSE 'message' END AS type,
  CASE event_id % 4
    WHEN 0 THEN concat('{{{{"messages":[{{{{"role":"user","content":"', {_BODY},
      '"}}}},{{{{"role":"assistant","content":"Noted, we look into it"}}}}]}}}}')
    WHEN 1 THEN concat('{{{{"text":"', {_BODY}, '"}}}}')
    WHEN 2 THEN concat('{{{{"content":"', {_BODY}, '"}}}}')
    ELSE '{{{{"note":1}}}}' END AS payload,
  ts AS created_at
FROM {{events}}"""

RESOLUTIONS_SQL = """SELECT concat('res-', coalesce(tenant_id, ''), '-', session_id) AS resolution_id, tenant_id, subject_id, session_id,
  CASE k % 5 WHEN 0 THEN 'open' WHEN 4 THEN 'unresolved' ELSE 'resolved' END AS status,
  CASE WHEN k % 5 IN (1, 2) THEN 'Restarted the export job and cleared the cache' END AS resolution_summary,
  CASE WHEN k % 5 IN (1, 2, 3) THEN hi + INTERVAL '1' HOUR * (k % 30) END AS resolved_at,
  lo AS created_at, hi AS updated_at
FROM (SELECT tenant_id, subject_id, session_id, min(created_at) AS lo, max(created_at) AS hi,
    CAST(sum(CAST(substr(episode_id, 4) AS BIGINT)) % 60 AS INT) AS k
  FROM {episodes} WHERE session_id IS NOT NULL GROUP BY tenant_id, subject_id, session_id) AS s"""

JOBS_SQL = """SELECT concat('job-', CAST(o_orderkey AS STRING)) AS job_id, concat('user-', CAST(o_custkey AS STRING)) AS subject_id,
  CASE o_custkey % 3 WHEN 1 THEN 'acme' WHEN 2 THEN 'globex' END AS tenant_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  CAST(o_orderkey % 9 AS INT) AS memories_created, o_orderdate AS created_at
FROM {orders}"""

OUTBOX_SQL = """SELECT concat('hook-', CAST(o_orderkey AS STRING)) AS event_id,
  CASE o_custkey % 3 WHEN 1 THEN 'acme' WHEN 2 THEN 'globex' END AS tenant_id,
  CASE o_orderkey % 2 WHEN 0 THEN 'subject.health_degraded' ELSE 'memory.created' END AS event,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'dead_letter' END AS status,
  CAST(o_orderkey % 5 AS INT) AS attempts, 5 AS max_attempts, o_orderdate AS created_at,
  o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 48 AS INT) AS next_attempt_at
FROM {orders}"""

SECTIONS_SQL = """SELECT concat('doc-', CAST(doc_id AS STRING)) AS doc_path,
  CASE doc_id % 5 WHEN 4 THEN text ELSE concat('lead in', chr(10), '# Guide ', CAST(doc_id % 17 AS STRING), chr(10),
    '## Setup', chr(10), '```', chr(10), '# not a heading', chr(10), '```', chr(10), '### Empty', chr(10), '## Use & Care', chr(10),
    replace(text, chr(10), concat(chr(10), '### More', chr(10))), chr(10)) END AS text
FROM {documents}"""

#: Other headings in the same texts: the last section takes what the first ones leave.
WHOLE_SECTIONS_SQL = """SELECT concat('doc-', CAST(doc_id AS STRING)) AS doc_path,
  CASE doc_id % 5 WHEN 4 THEN text ELSE concat('lead in', chr(10), '# Guide ', CAST(doc_id % 17 AS STRING), chr(10),
    substr(text, 1, 200), chr(10), '## Setup', chr(10), '```', chr(10), '# not a heading', chr(10), '```', chr(10),
    substr(text, 201, 150), chr(10), '### Empty', chr(10), '## Use & Care', chr(10), substr(text, 351), chr(10)) END AS text
FROM {documents}"""

MEMORIES_SQL = """SELECT concat('mem-', CAST(e.vec_id AS STRING)) AS memory_id, concat('label-', CAST(e.label AS STRING)) AS subject_id,
  CASE e.vec_id % 5 WHEN 1 THEN 'acme' WHEN 2 THEN 'acme' WHEN 3 THEN 'globex' END AS tenant_id,
  CASE e.vec_id % 4 WHEN 0 THEN 'profile_fact' WHEN 1 THEN 'procedure' ELSE 'episode_summary' END AS kind,
  CASE e.vec_id % 7 WHEN 3 THEN 'superseded' ELSE 'active' END AS status, e.embedding
FROM {embeddings} AS e"""


def _stamps(df: DataFrame) -> DataFrame:
    """Times as TIMESTAMP, whatever kind the files hold."""
    return df.withColumns({n: F.col(n).cast("timestamp") for n, t in df.dtypes if t.startswith("timestamp")})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as there are cores, where a small file would give fewer; large inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() * 2 < cores else rows


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamps(spark.sql(EPISODES_SQL, events=spread(_table(spark, sf_dir, "events"), "event_id")))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamps(spark.sql(RESOLUTIONS_SQL, episodes=episodes(spark, sf_dir)))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamps(spark.sql(JOBS_SQL, orders=_table(spark, sf_dir, "orders")))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamps(spark.sql(OUTBOX_SQL, orders=_table(spark, sf_dir, "orders")))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SECTIONS_SQL, documents=_table(spark, sf_dir, "documents"))


def whole_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WHOLE_SECTIONS_SQL, documents=_table(spark, sf_dir, "documents"))


def vector_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MEMORIES_SQL, embeddings=_table(spark, sf_dir, "embeddings"))


def oracle_ctes(*names: str) -> str:
    """WITH clause that defines the model tables for DuckDB."""
    made = {
        "episodes": EPISODES_SQL.format(events="events"),
        "resolutions": RESOLUTIONS_SQL.format(episodes="episodes"),
        "jobs": JOBS_SQL.format(orders="orders"),
        "outbox": OUTBOX_SQL.format(orders="orders"),
        "markdown": SECTIONS_SQL.format(documents="documents"),
        "whole_markdown": WHOLE_SECTIONS_SQL.format(documents="documents"),
        "vectors": MEMORIES_SQL.format(embeddings="embeddings"),
    }
    keyed = ("episodes", "resolutions")  # sk names tenant and subject, so that null tenants join too
    return "WITH " + ",\n".join(
        f"{n} AS (SELECT *, concat(coalesce(tenant_id, ''), '/', subject_id) AS sk FROM ({made[n]}))" if n in keyed else f"{n} AS ({made[n]})" for n in names
    )
