"""Small fixtures that a job doing less than the whole would fail."""

import hashlib
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from recollect.operators import compile as comp
from recollect.operators import lifecycle
from recollect.plans import registry
from recollect.sources.adapters import episodes

T0 = datetime(2024, 1, 1)


def test_all_of_a_text_is_chunked(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(12_000))
    spark.createDataFrame([(5, text), (9, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["chunk_whole_documents"](spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.strip().encode()).hexdigest()
    assert [r["content_hash"] for r in got if r["doc_path"] == "doc-9"] == [sha(text)]
    rest = [r["content_hash"] for r in got if r["doc_path"] == "doc-5" and r["heading"] == "Use & Care"]
    assert rest == [sha(text[350:])]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Tables in which one subject has 700 episodes with text."""
    folder = str(tmp_path_factory.mktemp("hot"))
    rows = [(4 * i + 1, T0 + timedelta(minutes=i), 3 if i < 700 else 4, "click") for i in range(710)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["compile_memories", "compile_summaries"])
def test_hot_subjects_are_compiled_whole(spark, hot, name):
    assert registry.QUERIES[name](spark, hot).count() == 710


def test_hot_subjects_are_resolved_and_exported_whole(spark, hot):
    resolved = registry.QUERIES["resolve_conflicts"](spark, hot).collect()
    assert sum(r["n"] for r in resolved if r["subject_id"] == "user-3") == 700
    exported = {r["subject_id"]: r["memory_count"] for r in registry.QUERIES["export_subjects"](spark, hot).collect()}
    assert exported == {"user-3": 700, "user-4": 10}


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Events of all kinds, 700 of them of one subject, and no other tables."""
    folder = str(tmp_path_factory.mktemp("busy"))
    kinds = ["error", "click", "view", "purchase", "signup"]
    rows = [(i, T0 + timedelta(minutes=37 * i), 5 if i % 8 else 4, kinds[(i * 7 + i // 5) % 5]) for i in range(800)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["session_sla", "subject_sla", "health_signals", "subject_health", "session_sla_capped", "health_signals_capped"])
def test_busy_subjects_are_judged_by_all_their_episodes(spark, busy, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{busy}/events.parquet/*.parquet')")
    found = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, busy)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    order = [list(found.columns).index(c) for c in columns]
    text = lambda rows: sorted(repr([round(float(v), 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert text(tuple(r) for r in df.select(columns).collect()) == text([r[i] for i in order] for r in found.fetchall())


@pytest.mark.parametrize("most", [{"most_rows": 150}, {"most_bytes": 20_000}])
def test_large_subjects_make_the_round_trip(spark, hot, most):
    as_of = "2024-02-01 00:00:00"
    eps = episodes(spark, hot).withColumns({"metadata": F.lit("{}"), "provenance": F.lit("{}")})
    mem = comp.compile_memories(eps)
    docs = lifecycle.export_subjects(eps, mem, as_of, **most).cache()
    parts = {(r["part"], r["parts"]) for r in docs.where("subject_id = 'user-3'").collect()}
    assert len(parts) > 3 and parts == {(i + 1, len(parts)) for i in range(len(parts))}
    assert docs.where("document IS NULL OR too_large").count() == 0
    targets = docs.select("subject_id", F.concat(F.lit("in-"), "subject_id").alias("target_id")).distinct()
    e, m = lifecycle.import_payload(docs, targets, as_of)
    assert {r["subject_id"]: r["count"] for r in e.groupBy("subject_id").count().collect()} == {"in-user-3": 700, "in-user-4": 10}
    cites = m.where(F.size("source_episode_ids") == 1).groupBy("subject_id").count().collect()
    assert {r["subject_id"]: r["count"] for r in cites} == {"in-user-3": 700, "in-user-4": 10}
    lost = lifecycle.verify_export(docs.where("subject_id = 'user-3' AND part <> 2"))
    assert {r["problem"] for r in lost.collect()} == {"parts"}
    renamed = docs.withColumn("part", F.when(F.col("part") == 2, 3).otherwise(F.col("part")))
    assert "checksum" in {r["problem"] for r in lifecycle.verify_export(renamed).collect()}


def test_all_subjects_are_snapshot_and_cloned(spark, hot):
    made = registry.QUERIES["create_snapshot_of_all"](spark, hot).collect()
    assert {r["source_subject_id"]: r["episode_count"] for r in made} == {"user-3": 700, "user-4": 10}
    copies = registry.QUERIES["clone_all_subjects"](spark, hot).collect()
    assert {r["origin"]: (r["episodes"], r["memories"]) for r in copies} == {"user-3": (700, 700), "user-4": (10, 10)}
