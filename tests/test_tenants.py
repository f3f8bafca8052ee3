"""One subject id in two tenants: what one stores, the other never sees."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import conflicts, context, explore, health, lifecycle, search
from recollect.operators.compile import compile_memories

T0, AS_OF = datetime(2024, 1, 1), "2024-02-01 00:00:00"
EPISODE = "episode_id string, tenant_id string, subject_id string, session_id string, source string, type string, payload string, created_at timestamp"
RESOLUTION = "resolution_id string, tenant_id string, subject_id string, session_id string, status string, resolution_summary string, resolved_at timestamp, created_at timestamp, updated_at timestamp"


@pytest.fixture(scope="module")
def world(spark):
    """Tenants a and b and no tenant, each with subject s, session x; only a's is resolved."""
    rows = [
        (f"{t or 'n'}{i}", t, "s", "x", "user", "message", f'{{"text":"tenant {t} export job fails again {i // 2}"}}', T0 + timedelta(hours=i))
        for t in ("a", "b", None)
        for i in range(4)
    ]
    eps = spark.createDataFrame(rows, EPISODE)
    mem = compile_memories(eps)
    res = spark.createDataFrame([("r", "a", "s", "x", "resolved", "restarted export job", T0, T0, T0), ("q", "b", "s", "x", "open", None, None, T0, T0)], RESOLUTION)
    return eps.cache(), mem.cache(), res.cache()


def ask(spark, *tenants, session="y"):
    rows = [(f"req-{t}", t, "s", "export job fails", session, 1000) for t in tenants]
    return spark.createDataFrame(rows, "request_id string, tenant_id string, subject_id string, task string, session_id string, max_tokens int")


def owners(rows, column):
    return {r["request_id"]: {x[0] if isinstance(x, str) else x for x in r["own"]} for r in rows.groupBy("request_id").agg(F.collect_set(column).alias("own")).collect()}


def test_search_finds_the_tenants_own(spark, world):
    _, mem, _ = world
    vectors = mem.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)))
    asked = ask(spark, "a", "b", None).select(F.col("request_id").alias("query_id"), "tenant_id", "subject_id", F.array(F.lit(1.0), F.lit(0.4)).alias("vector"))
    found = search.semantic_topk(asked, vectors, k=50).join(mem.select("memory_id", "tenant_id"), "memory_id").withColumnRenamed("query_id", "request_id")
    tenants = owners(found.fillna("none", ["tenant_id"]).withColumn("tenant_id", F.substring("tenant_id", 1, 1)), "tenant_id")
    assert tenants == {"req-a": {"a"}, "req-b": {"b"}, "req-None": {"a", "b", "n"}}


def test_context_holds_the_tenants_own(spark, world):
    eps, mem, res = world
    asked = ask(spark, "a", "b", None)
    # A search that found everything for everybody: only what a request may see joins its pool.
    found = asked.select("request_id").crossJoin(mem.select("memory_id")).withColumns({"distance": F.lit(0.1), "rank": F.lit(1)})
    pool = context.memory_pool(context.with_tokens(asked), mem, found)
    assert owners(pool.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("n"))), "tenant_id") == {"req-a": {"a"}, "req-b": {"b"}, "req-None": {"a", "b", "n"}}
    heard = context.episode_pool(context.with_tokens(asked), eps)
    repeat = {r["request_id"] for r in context.repeat_issues(heard, context.with_tokens(asked), res).collect()}
    assert repeat == {"req-a", "req-None"}  # b's session is open
    bundles = {r["request_id"]: r for r in context.assemble_context(asked, eps, mem, res, AS_OF).collect()}
    assert "tenant b" not in bundles["req-a"]["assembled_context"] and "tenant a" not in bundles["req-b"]["assembled_context"]
    assert {i[0] for i in bundles["req-None"]["summary_ids"]} and bundles["req-a"]["summary_ids"]


def test_counts_and_citations_go_by_both_keys(spark, world):
    eps, mem, res = world
    shared = mem.withColumn("source_episode_ids", F.array(F.lit("a0"), F.lit("b0")))  # ids of both tenants
    assert {(r["tenant_id"], r["episode_count"], r["memory_count"]) for r in explore.subject_overview(eps, mem).collect()} == {("a", 4, 4), ("b", 4, 4), (None, 4, 4)}
    assert {(r["tenant_id"], r["episode_id"]) for r in explore.citing_memories(eps, shared).collect()} == {("a", "a0"), ("b", "b0")}
    assert {r["tenant_id"]: r["status"] for r in explore.session_timeline(eps, mem, res, health_free_sla(eps, res)).where("is_resolution = 0").collect()} == {"a": "resolved", "b": "open", None: "unknown"}
    page = explore.subject_explorer(eps, mem, res, spark.createDataFrame([], "tenant_id string, subject_id string, last_state string, last_score int"), tenant_id="b").collect()
    assert [(r["tenant_id"], r["open_sessions"], r["health_state"]) for r in page] == [("b", 1, None)]
    filled = explore.with_health(explore.subject_explorer(eps, mem, res, spark.createDataFrame([], "tenant_id string, subject_id string, last_state string, last_score int")), eps, res, AS_OF)
    scores = {r["tenant_id"]: r["score"] for r in health.subject_health(health.health_signals(eps, res, AS_OF)).collect()}
    assert {r["tenant_id"]: r["health_score"] for r in filled.collect()} == scores


def health_free_sla(eps, res):
    from recollect.operators.sla import session_sla

    return session_sla(eps, res, AS_OF)


def test_alerts_compare_with_the_tenants_own_state(spark):
    now = spark.createDataFrame([("a", "s", 20, "at_risk", None), ("b", "s", 90, "healthy", None)], "tenant_id string, subject_id string, score int, state string, factors array<string>")
    cache = spark.createDataFrame([("a", "s", "at_risk", 20), ("b", "s", "watch", 50), ("c", "s", "watch", 50)], "tenant_id string, subject_id string, last_state string, last_score int")
    alerts, new = health.health_alerts(now, cache)
    assert [(r["tenant_id"], r["event"]) for r in alerts.collect()] == [("b", "subject.health_improved")]
    assert {(r["tenant_id"], r["last_state"]) for r in new.collect()} == {("a", "at_risk"), ("b", "healthy"), ("c", "watch")}


def test_conflicts_and_siblings_stay_within_a_tenant(spark, world):
    _, mem, _ = world
    lost = conflicts.superseders(mem).join(mem.select("memory_id", "tenant_id"), "memory_id")
    winners = mem.select(F.col("memory_id").alias("superseded_by"), F.col("tenant_id").alias("w"))
    assert lost.join(winners, "superseded_by").where("NOT tenant_id <=> w").count() == 0 and lost.count() > 0
    siblings = explore.lineage_siblings(mem.withColumn("source_episode_ids", F.array(F.lit("e"))))
    pairs = siblings.join(mem.select("memory_id", "tenant_id"), "memory_id").join(mem.select(F.col("memory_id").alias("sibling_id"), F.col("tenant_id").alias("w")), "sibling_id")
    assert pairs.count() > 0 and pairs.where("NOT tenant_id <=> w").count() == 0


def test_deletion_copies_and_exports_take_one_tenant(spark, world):
    eps, mem, res = world
    found = explore.match_subjects(eps, mem, AS_OF, prefix="s", tenant_id="a")
    assert [tuple(r) for r in found.select("tenant_id", "subject_id", "episode_count", "memory_count").collect()] == [("a", "s", 4, 4)]
    left = lifecycle.purge_subjects(found, 1, eps, mem)
    assert [{r["tenant_id"] for r in t.collect()} for t in left] == [{"b", None}, {"b", None}]
    full = eps.withColumns({"metadata": F.lit("{}"), "provenance": F.lit("{}")})
    targets = spark.createDataFrame([("b", "s", "copy")], "tenant_id string, subject_id string, target_id string")
    e, m = lifecycle.clone_subjects(full, mem, targets, AS_OF)
    assert e.count() == 4 and m.count() == 4 and {r["tenant_id"] for r in e.collect()} == {"b"}
    docs = lifecycle.export_subjects(full, mem, AS_OF)
    assert {(r["tenant_id"], r["episode_count"]) for r in docs.collect()} == {("a", 4), ("b", 4), (None, 4)}
    e, m = lifecycle.import_payload(docs, targets, AS_OF)
    assert e.count() == 4 and m.count() == 4 and "tenant b" in e.first()["payload"]
    assert lifecycle.pack_state(full, "demo").count() == 3
