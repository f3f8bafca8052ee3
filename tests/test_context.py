"""Context bundles and handoff briefs: small exact cases, and packing against a plain loop."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.functions.text import approx_tokens
from recollect.operators import context, handoff, health, search, sla

T0, AS_OF = datetime(2024, 1, 1), "2024-01-10 00:00:00"
MEMORY = "memory_id string, tenant_id string, subject_id string, kind string, content string, created_at timestamp, source_episode_ids array<string>"
EPISODE = "episode_id string, tenant_id string, subject_id string, session_id string, source string, type string, payload string, created_at timestamp"
REQUEST = "request_id string, tenant_id string, subject_id string, task string, session_id string, max_tokens int, reason string"


def memories(spark, rows):
    df = spark.createDataFrame([(i, None, s, k, c, T0 + timedelta(hours=h), src) for i, s, k, c, h, src in rows], MEMORY)
    return df.withColumns({"status": F.lit("active"), "valid_to": F.lit(None).cast("timestamp")})


def episodes(spark, rows):
    return spark.createDataFrame([(i, None, "s", se, so, "message", f'{{"text":"{t}"}}', T0 + timedelta(hours=h)) for i, se, so, t, h in rows], EPISODE)


def resolutions(spark, rows):
    schema = "resolution_id string, tenant_id string, subject_id string, session_id string, status string, resolution_summary string, resolved_at timestamp, updated_at timestamp"
    return spark.createDataFrame([(f"r{i}", None, "s", se, st, note, None, T0 + timedelta(hours=i)) for i, (se, st, note) in enumerate(rows)], schema)


def request(spark, task, session=None, budget=4000):
    return spark.createDataFrame([("q", None, "s", task, session, budget, "transfer")], REQUEST)


@pytest.fixture(scope="module")
def world(spark):
    mem = memories(spark, [
        ("f1", "s", "profile_fact", "works at Acme", 1, ["e1"]), ("f2", "s", "profile_fact", "likes tea", 5, ["e2"]),
        ("p1", "s", "procedure", "restart the export job", 3, []), ("h1", "s", "episode_summary", "user: hello\nassistant: hi there", 4, ["e1"]),
        ("x1", "other", "profile_fact", "not mine", 9, []),
    ])
    eps = episodes(spark, [
        ("e1", "a", "user", "hello there old friend of mine", 1), ("e2", "b", "user", "the export job fails, urgent matter", 2),
        ("e3", "b", "agent", "restarted the whole export job", 3), ("e4", "c", "user", "export job fails again today", 4), ("e5", None, "user", "ok", 5),
    ])
    res = resolutions(spark, [("a", "open", None), ("b", "resolved", "restarted export job")])
    return mem, eps, res


def test_bundle(spark, world):
    mem, eps, res = world
    got = context.assemble_context(request(spark, "export job fails", "c"), eps, mem, res, AS_OF).first()
    assert got["fact_ids"] == ["f2", "f1"] and got["procedure_ids"] == ["p1"] and got["summary_ids"] == ["h1"]
    assert "e1" not in got["episode_ids"]  # its summary is there
    assert got["episode_ids"][:1] == ["e4"] and set(got["episode_ids"]) == {"e2", "e3", "e4", "e5"}
    text = got["assembled_context"]
    assert [m for m in re.findall(r"^##+ .*$", text, re.M)] == [
        "## Task", "## About this user", "## Procedures", "## Recent history", "## Recent interactions", "### Current session (c)", "### Previous interactions",
    ]
    assert "- hello → hi there" in text and "not mine" not in text


def test_repeat_issue(spark, world):
    mem, eps, res = world
    asked = context.with_tokens(request(spark, "export job fails", "c"))
    got = context.repeat_issues(context.episode_pool(asked, eps), asked, res).collect()
    assert [(r["session_id"], r["repeat"]) for r in got] == [("b", 6.0)]


@pytest.mark.parametrize("budget", [0, 25, 40, 60, 4000])
def test_packing_is_the_plain_loop(spark, world, budget):
    mem, eps, res = world
    asked = context.with_tokens(request(spark, "export job fails", None, budget))
    pool = context.memory_pool(asked, mem)
    covered = pool.where("kind = 'episode_summary'").select("request_id", F.explode("source_episode_ids").alias("episode_id"))
    m = context.memory_scores(pool, AS_OF, context.memory_breadcrumbs(pool, eps)).select("score", "memory_id", "line", approx_tokens(F.col("line")).alias("n")).collect()
    e = context.episode_scores(context.episode_pool(asked, eps), asked, res, covered).select("score", "episode_id", "line", approx_tokens(F.col("line")).alias("n")).collect()
    used, kept = len(re.findall(r"\w+|[^\w\s]", "## Task\nexport job fails\n")), set()
    for _, i, _, n in sorted(map(tuple, m + e), key=lambda r: -round(r[0], 9)):
        if used + n + context.RESERVE <= budget:
            used += n
            kept.add(i)
    got = context.assemble_context(request(spark, "export job fails", None, budget), eps, mem, res, AS_OF).first()
    assert set(got["fact_ids"] + got["procedure_ids"] + got["summary_ids"] + got["episode_ids"]) == kept and got["budget_used"] == used


def test_semantic_candidates_join_the_pool(spark):
    rows = [(f"f{i:03d}", "s", "profile_fact", f"fact {i}", i, []) for i in range(60)]
    mem = memories(spark, rows)
    vector = F.when(F.col("memory_id") == "f000", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    found = search.semantic_topk(
        spark.createDataFrame([("q", "s", [1.0, 0.1])], "query_id string, subject_id string, vector array<double>"), mem.withColumn("embedding", vector), k=1
    ).withColumnRenamed("query_id", "request_id")
    asked = context.with_tokens(request(spark, "anything"))
    pool = {r["memory_id"]: r["semantic"] for r in context.memory_pool(asked, mem, found).collect()}
    assert len(pool) == 51 and pool["f000"] > 7.9 and pool["f059"] is None


def test_an_index_of_cells_finds_most_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centers = rng.standard_normal((30, 24))
    x = np.repeat(centers, 60, axis=0) + 0.5 * rng.standard_normal((1800, 24))
    mem = spark.createDataFrame([(f"m{i:04d}", None, "s", "active", v.tolist()) for i, v in enumerate(x)], "memory_id string, tenant_id string, subject_id string, status string, embedding array<double>")
    asked = mem.where("memory_id LIKE '%0'").select("tenant_id", "subject_id", F.col("memory_id").alias("query_id"), F.col("embedding").alias("vector"))
    pairs = lambda df: {(r["query_id"], r["memory_id"]) for r in df.collect()}
    exact = pairs(search.semantic_topk(asked, mem, k=10))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(unit[::10] @ unit.T), axis=1)[:, :10]
    assert exact == {(f"m{10 * i:04d}", f"m{j:04d}") for i, row in enumerate(order) for j in row}
    cells = search.fit_cells(mem, cells=24, sample=900)
    assert cells.shape == (24, 24)
    assert len(exact & pairs(search.semantic_topk(asked, mem, k=10, cells=cells, probes=6))) >= 0.9 * len(exact)
    assert pairs(search.semantic_topk(asked, mem, k=10, cells=cells, probes=24)) == exact
    assert search.fit_cells(mem.limit(0)).shape[0] == 0


def test_breadcrumbs(spark):
    df = spark.createDataFrame([(["Setup guide › Cache keys", "Other"], ["what", "cache", "keys?"])], "b array<string>, t array<string>")
    assert df.select(context.breadcrumb_bonus(F.col("b"), F.col("t"))).first()[0] == 3.0


def test_handoff(spark, world):
    mem, eps, res = world
    res = res.withColumn("created_at", F.col("updated_at"))
    sessions = sla.session_sla(eps, res, AS_OF)
    scores = health.subject_health(health.health_signals(eps, res, AS_OF))
    got = handoff.handoff_brief(request(spark, "", "b"), eps, mem, res, scores, sla.subject_sla(sessions), sessions).first()
    assert got["active_issue"] == "[user/message] the export job fails, urgent matter (+ 1 more messages in session)"
    assert got["attempted_steps"] == ["restarted the whole export job"] and got["key_facts"] == ["likes tea", "works at Acme"]
    assert got["customer_summary"] == "s — likes tea; works at Acme" and got["open_issues"] == ["[a] No summary"] and got["resolved"] == ["[b] restarted export job"]
    titles = re.findall(r"^## (.*)$", got["handoff_notes"], re.M)
    assert titles == ["Customer", "Customer Health", "SLA Status", "Active Issue", "What Has Been Tried", "Open Issues", "Previously Resolved", "Key Facts", "Recent Context (other sessions)"]
    short = handoff.handoff_brief(request(spark, "", "b", 12), eps, mem, res, scores, sla.subject_sla(sessions), sessions).first()
    assert short["token_estimate"] == 12 and got["handoff_notes"].startswith(short["handoff_notes"])
    nobody = spark.createDataFrame([("n", None, "ghost", "", "z", 100, "r")], REQUEST)
    empty = handoff.handoff_brief(nobody, eps, mem, res, scores, sla.subject_sla(sessions), sessions).first()
    assert empty["customer_summary"] == "Subject: ghost" and empty["health_score"] == 100 and empty["active_issue"] == ""


@pytest.mark.parametrize("budget", [4_000, 32_000])
def test_long_notes_are_cut_to_any_budget(spark, world, budget):
    mem, eps, _ = world
    words = " ".join(f"step{i}, done." if i % 7 else f"(naïve—{i})" for i in range(5_000))
    res = resolutions(spark, [("a", "open", words), ("b", "resolved", "restarted export job")]).withColumn("created_at", F.col("updated_at"))
    sessions = sla.session_sla(eps, res, AS_OF)
    scores = health.subject_health(health.health_signals(eps, res, AS_OF))
    got = handoff.handoff_brief(request(spark, "", "b", budget), eps, mem, res, scores, sla.subject_sla(sessions), sessions).first()
    whole = handoff.handoff_brief(request(spark, "", "b", 10**9), eps, mem, res, scores, sla.subject_sla(sessions), sessions).first()["handoff_notes"]
    pieces = re.findall(r"\s*(?:\w+|[^\w\s])", whole, re.A)
    assert 16_000 < len(pieces) < 32_000
    assert got["handoff_notes"] == (whole if budget > len(pieces) else "".join(pieces[:budget]))
    assert got["token_estimate"] == min(budget, len(pieces))


def test_notes_are_cut_by_the_given_counter(spark, world):
    mem, eps, res = world
    res = res.withColumn("created_at", F.col("updated_at"))
    sessions = sla.session_sla(eps, res, AS_OF)
    scores = health.subject_health(health.health_signals(eps, res, AS_OF))
    got = handoff.handoff_brief(
        request(spark, "", "b", 33), eps, mem, res, scores, sla.subject_sla(sessions), sessions, tokens=F.length, cut=lambda text, most: F.substring(text, F.lit(1), most)
    ).first()
    assert len(got["handoff_notes"]) == 33 == got["token_estimate"]


def test_semantic_finds_are_looked_up_by_id_and_scope(spark):
    rows = [(f"f{i:03d}", ["acme", "globex", None][i % 3], ["s", "t"][i % 2], "rare", f"fact {i}", T0 + timedelta(hours=i), []) for i in range(24)]
    mem = spark.createDataFrame(rows, MEMORY).withColumns({"status": F.when(F.col("memory_id") == "f006", "superseded").otherwise("active"), "valid_to": F.lit(None).cast("timestamp")})
    asked = spark.createDataFrame([("all", None, "s", "x", None, 100, "r"), ("acme", "acme", "s", "x", None, 100, "r")], REQUEST)
    found = spark.createDataFrame([(q, r[0], 0.5, k) for q in ("all", "acme") for k, r in enumerate(rows)], "request_id string, memory_id string, distance double, rank int")
    pool = context.memory_pool(context.with_tokens(asked), mem, found)
    got = {(r["request_id"], r["memory_id"]) for r in pool.collect()}  # a kind without a pool comes in by its finds alone
    mine = [r for r in rows if r[2] == "s" and r[0] != "f006"]
    assert got == {("all", r[0]) for r in mine} | {("acme", r[0]) for r in mine if r[1] == "acme"}
    text = context.memory_pool(context.with_tokens(asked), mem, found)._jdf.queryExecution().optimizedPlan().toString()
    # Each of the two readings of memories beside finds meets them by id: one Expand of scopes, that of the pools, is left.
    assert text.count("Generate explode") == 2
