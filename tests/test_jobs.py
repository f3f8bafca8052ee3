"""Small exact fixtures, and brute force where SQL has no word for it."""

import hashlib
import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.functions import text, vectors
from recollect.operators import compile as comp
from recollect.operators import conflicts, context, documents, health, lifecycle, sla
from recollect.sources import schemas
from recollect.streaming import jobs as streams

T0 = datetime(2024, 1, 1)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', "user: hi\nassistant: yo"),
        ('{"messages":[],"text":"ignored"}', ""),
        ('{"text":"a","content":"b"}', "a"),
        ('{"content":"b"}', "b"),
        ('{"other":1}', ""),
        ("{}", ""),
    ],
)
def test_payload_text(spark, payload, expected):
    assert one(spark, payload, text.payload_text) == expected


@pytest.mark.parametrize(
    ("said", "facts"),
    [
        ("My name is Ada Byron, I work at Acme Inc. Thanks", ["My name is Ada Byron", "I work at Acme Inc"]),
        ("i'm from Rome\nI prefer tea", ["i'm from Rome", "I prefer tea"]),
        ("nothing here", []),
        ("I am on the pro plan\rX, ok", ["I am on the pro plan\rX"]),
    ],
)
def test_profile_facts(spark, said, facts):
    assert one(spark, said, text.profile_facts) == facts


def test_clean_summary(spark):
    assert one(spark, "user: a\nassistant: b", text.clean_summary) == "a → b"
    assert one(spark, "user: a\n\nuser: b\nassistant: c", text.clean_summary) == "a → c"


@pytest.mark.parametrize("fn", [text.strip, text.slugify, text.clean_summary])
def test_all_white_space_is_trimmed(spark, fn):
    assert one(spark, "\t\r\n  a b\u00a0\r\n", fn) == ("a-b" if fn is text.slugify else "a b")


def test_outbox_records_attempts(spark):
    rows = [(i, "pending", 0 if i < 3 else 1, 2, "old") for i in range(5)]
    outbox = spark.createDataFrame([(f"e{i}", s, n, m, T0, T0, e) for i, s, n, m, e in rows], "event_id string, status string, attempts int, max_attempts int, created_at timestamp, next_attempt_at timestamp, last_error string")
    results = spark.createDataFrame([("e0", True, 200, None), ("e1", False, 503, "HTTP 503"), ("e3", False, None, "timeout")], "event_id string, ok boolean, http_status int, error string")
    got = {r["event_id"]: r for r in streams.outbox_advance(outbox, results, "2024-01-02 00:00:00").collect()}
    assert [(got[f"e{i}"]["status"], got[f"e{i}"]["http_status"], got[f"e{i}"]["last_error"]) for i in range(5)] == [
        ("delivered", 200, "old"), ("pending", 503, "HTTP 503"), ("pending", None, "old"), ("dead_letter", None, "timeout"), ("pending", None, "old"),
    ]
    assert [got[f"e{i}"]["last_attempt_at"] is not None for i in range(5)] == [True, True, False, True, False]
    assert [got[f"e{i}"]["delivered_at"] is not None for i in range(5)] == [True, False, False, False, False]


def test_a_missing_pack_is_empty(spark, tmp_path):
    assert documents.read_pack_jsonl(spark, f"{tmp_path}/none.jsonl", documents.PACK_MEMORY).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from recollect.sources import scratch

    context_ = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context_)
    with pytest.raises(ValueError):
        scratch.scratch(session, "x")


def test_tokens_split_on_unicode_space(spark):
    assert one(spark, " A b  B ", text.word_tokens) == ["a", "b"]


def test_hash_embedding_is_unit_and_exact(spark):
    got = one(spark, "hello", lambda c: vectors.hash_embedding(c, 20))
    raw = []
    for i in range(2):
        digest = hashlib.sha512(b"hello" + i.to_bytes(4, "big")).digest()
        raw += [int.from_bytes(digest[j : j + 4], "big") / 2147483647.5 - 1 for j in range(0, 64, 4)]
    raw = raw[:20]
    norm = sum(x * x for x in raw) ** 0.5
    assert got == pytest.approx([x / norm for x in raw], abs=1e-6)


def memories(spark, rows):
    made = [(f"m{i}", None, "s", kind, content, T0 + timedelta(minutes=at)) for i, (kind, content, at) in enumerate(rows)]
    df = spark.createDataFrame(made, "memory_id string, tenant_id string, subject_id string, kind string, content string, created_at timestamp")
    return df.withColumns({"status": F.lit("active"), "valid_from": F.col("created_at"), "valid_to": F.lit(None).cast("timestamp")})


def superseded_by_loop(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2], f"m{i}"))
    out = {}
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            x, y = set(rows[i][1].lower().split()), set(rows[j][1].lower().split())
            if rows[i][0] == rows[j][0] and x and y:
                top = (3, 5) if rows[i][0] == "profile_fact" else (4, 5)
                if top[1] * len(x & y) >= top[0] * len(x | y):
                    out[f"m{i}"] = f"m{j}"
                    break
    return out


def test_conflicts_equal_the_pairwise_loop(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(9)]
    for _ in range(3):
        rows = [
            (rng.choice(["profile_fact", "procedure"]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 6))), rng.randint(0, 20))
            for _ in range(60)
        ]
        got = {r["memory_id"]: r["superseded_by"] for r in conflicts.superseders(memories(spark, rows)).collect()}
        assert got == superseded_by_loop(rows)


def episodes(spark, rows):
    made = [(f"e{i}", None, "s", s, src, "message", p, T0 + timedelta(seconds=at)) for i, (s, src, p, at) in enumerate(rows)]
    return spark.createDataFrame(
        made, "episode_id string, tenant_id string, subject_id string, session_id string, source string, type string, payload string, created_at timestamp"
    )


def resolutions(spark, rows):
    made = [(f"r{i}", None, "s", s, st, None, at and T0 + timedelta(seconds=at), T0, T0 + timedelta(seconds=i)) for i, (s, st, at) in enumerate(rows)]
    return spark.createDataFrame(
        made,
        "resolution_id string, tenant_id string, subject_id string, session_id string, status string, resolution_summary string, resolved_at timestamp, created_at timestamp, updated_at timestamp",
    )


def test_session_sla_edges(spark):
    eps = episodes(spark, [("a", "user", "{}", 0), ("a", "agent", "{}", 300), ("b", "agent", "{}", 5), ("b", "user", "{}", 10), (None, "user", "{}", 1), ("", "user", "{}", 1)])
    res = resolutions(spark, [("a", "resolved", 90_000), ("b", "open", None)])
    rows = {r["session_id"]: r for r in sla.session_sla(eps, res, "2024-01-01 01:00:00").collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"]["first_response_seconds"] == 300 and not rows["a"]["first_response_breached"]
    assert rows["a"]["resolution_breached"] and rows["a"]["open_duration_seconds"] is None
    assert rows["b"]["first_response_at"] is None and rows["b"]["open_duration_seconds"] == 3590


def test_health_of_nothing_and_of_trouble(spark):
    calm = episodes(spark, [("a", "user", '{"text":"urgent"}', 0)])
    none = resolutions(spark, [])
    got = health.subject_health(health.health_signals(calm, none, "2024-01-02 00:00:00")).first()
    assert (got["score"], got["state"], got["factors"]) == (100, "healthy", [])
    shout = '{"messages":[{"role":"user","content":"the outage again"}]}'
    eps = episodes(spark, [("a", "user", shout, 0), ("b", "user", shout, 10), ("b", "agent", "{}", 2000)])
    res = resolutions(spark, [("a", "open", None), ("b", "resolved", 200_000)])
    got = health.subject_health(health.health_signals(eps, res, "2024-02-01 00:00:00")).first()
    assert [f["signal"] for f in got["factors"]] == [
        "unresolved_issues", "repeated_issues", "escalations", "idle_open_issue", "sla_resolution_breaches", "slow_first_response",
    ]
    assert got["score"] == 100 - 15 - 20 - 20 - 15 - 10 - 5 and got["state"] == "at_risk"


def test_alerts_and_cache(spark):
    h = spark.createDataFrame([(None, "new", 10, "at_risk"), (None, "old", 90, "healthy"), (None, "calm", 90, "healthy")], "tenant_id string, subject_id string, score int, state string")
    h = h.withColumn("factors", F.array().cast("array<string>"))
    cache = spark.createDataFrame([("old", None, "watch", 50), ("gone", None, "watch", 45)], "subject_id string, tenant_id string, last_state string, last_score int")
    alerts, new = health.health_alerts(h, cache)
    assert {r["subject_id"]: r["event"] for r in alerts.collect()} == {"new": "subject.health_degraded", "old": "subject.health_improved"}
    assert {r["subject_id"] for r in new.collect()} == {"new", "old", "calm", "gone"}


def test_compile_is_idempotent(spark):
    eps = episodes(spark, [("a", "user", '{"text":"I use vim."}', 0), ("a", "user", "{}", 1)]).withColumn("last_compiled_at", F.lit(None).cast("timestamp"))
    made, marked = comp.compile_new(eps, "2024-01-02 00:00:00")
    assert {(r["kind"], r["content"]) for r in made.collect()} == {("episode_summary", "I use vim."), ("profile_fact", "I use vim")}
    again, _ = comp.compile_new(marked, "2024-01-03 00:00:00")
    assert again.count() == 0 and marked.where("last_compiled_at IS NULL").count() == 0


def test_budget_skips_and_goes_on(spark):
    df = spark.sql("SELECT array(struct(60L AS tokens), struct(50L AS tokens), struct(20L AS tokens)) AS items")
    got = df.select(context.pack_budget(F.col("items"), F.lit(100), F.lit(5)).alias("p")).first()["p"]
    assert (got["kept"], got["used"]) == ([1, 3], 85)


def test_normalize_extractions(spark):
    rows = spark.createDataFrame(
        [("odd", '["a","b"]', 7.0, 9, 3), ("procedure", "x", None, 1, 3), ("procedure", "  ", 0.5, 0, 3)],
        "kind string, content string, confidence double, episode_index int, n_episodes int",
    )
    got = sorted(tuple(r)[:4] for r in comp.normalize_extractions(rows).collect())
    assert got == [("episode_summary", "a\nb", 1.0, 0), ("procedure", "x", 0.7, 1)]


def test_sliding_admission_equals_a_queue(spark):
    rng = random.Random(1)
    rows = [(k, i, T0 + timedelta(seconds=rng.randint(0, 900))) for k in range(3) for i in range(k * 100, k * 100 + 100)]
    got = {r["event_id"]: r["admitted"] for r in streams.sliding_admission(spark.createDataFrame(rows, "key long, event_id long, ts timestamp"), 4).collect()}
    for k in range(3):
        window = deque()
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            while window and window[0] <= t - timedelta(seconds=60):
                window.popleft()
            assert got[i] == (len(window) < 4)
            if got[i]:
                window.append(t)


def test_documents(spark):
    md = "lead\n# One\nbody\n## Two\n```\n# no\n```\n### Three\n\n# Four\nlast"
    docs = spark.createDataFrame([("a.md", md), ("b.md", "plain text"), ("c.md", "")], "doc_path string, text string")
    got = [(r["doc_path"], r["heading"], r["breadcrumb"], r["text"]) for r in documents.chunk_documents(docs).orderBy("doc_path", "section").collect()]
    assert got == [
        ("a.md", "One", "One", "body"), ("a.md", "Two", "One › Two", "```\n# no\n```"), ("a.md", "Four", "Four", "last"), ("b.md", None, "", "plain text"),
    ]


def test_ingest_rejects(spark, tmp_path):
    rows = spark.createDataFrame(
        [("e1", "s", "chat", "message", "{}"), ("e2", "", "chat", "message", "{}"), ("e3", "s", "chat", "message", "[1]"), ("e4", "s", None, "message", "{}")],
        "episode_id string, subject_id string, source string, type string, payload string",
    )
    bad = schemas.ingest_episodes(rows, f"{tmp_path}/t")
    assert {r["episode_id"]: r["rejected"] for r in bad.collect()} == {"e2": "subject_id", "e3": "payload", "e4": "source"}
    assert [r["episode_id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()] == ["e1"]


def test_round_trip_and_remap(spark):
    eps = episodes(spark, [("a", "user", '{"text":"I use vim."}', 0)]).withColumns({"metadata": F.lit('{"k":{"n":1}}'), "provenance": F.lit("{}")})
    mem = comp.compile_memories(eps)
    docs = lifecycle.export_subjects(eps, mem, "2024-01-02 00:00:00")
    e, m = lifecycle.import_payload(docs, docs.select("subject_id", F.lit("t").alias("target_id")), "2024-01-02 00:00:00")
    e1 = e.first()
    assert e1["subject_id"] == "t" and e1["payload"] == '{"text":"I use vim."}' and '"n":1' in e1["metadata"]
    assert {tuple(r["source_episode_ids"]) for r in m.collect()} == {(e1["episode_id"],)}
    changed = docs.withColumn("document", F.concat("document", F.lit(" ")))
    assert lifecycle.verify_export(changed).first()["problem"] == "checksum"


def test_guards(spark):
    jobs = spark.createDataFrame([("j", None, "pending", T0)], "job_id string, tenant_id string, status string, created_at timestamp")
    with pytest.raises(ValueError):
        lifecycle.purge_jobs(jobs, "2024-01-02 00:00:00")
    assert lifecycle.retire_old_jobs(jobs, "2025-01-02 00:00:00").count() == 1
