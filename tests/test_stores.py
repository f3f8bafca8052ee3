"""Stores that are filled batch by batch: episodes taken in once, vectors asked for once, usage by day."""

import datetime as dt
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.functions.vectors import Provider
from recollect.operators import usage
from recollect.streaming import backfill, ingest

T0 = dt.datetime(2024, 1, 1)
EPISODES = "episode_id string, tenant_id string, subject_id string, session_id string, source string, type string, payload string, metadata string, provenance string, created_at timestamp, last_compiled_at timestamp"


def episodes(spark, rows):
    """(id, hour, payload) as episodes."""
    return spark.createDataFrame([(i, None, "s", None, "user", "message", p, None, None, T0 + dt.timedelta(hours=h), None) for i, h, p in rows], EPISODES)


def state(spark, path):
    fine = sorted((r["episode_id"], r["created_at"]) for r in ingest.stored_episodes(spark, path, EPISODES).collect())
    bad = sorted((r["episode_id"] or "", r["rejected"]) for r in ingest.rejected_episodes(spark, path, EPISODES).collect())
    return fine, bad


def test_batches_are_taken_in_once(spark, tmp_path):
    path, at = str(tmp_path / "store"), lambda h: T0 + dt.timedelta(hours=h)
    first = [("a", 2, "{}"), ("a", 1, "{}"), ("b", 1, "[1]"), ("b", 2, "{}"), (None, 3, "{}"), ("c", 1, "{broken")]
    ingest.ingest_batch(episodes(spark, first), path, 0, buckets=4)
    want = [("a", at(1)), ("b", at(2))]
    assert state(spark, path) == (want, [("", "episode_id"), ("a", "duplicate"), ("b", "payload"), ("c", "payload")])
    second = [("a", 9, "{}"), ("d", 9, "{}"), ("c", 9, "{}")]
    ingest.ingest_batch(episodes(spark, second), path, 1, buckets=4)
    after = state(spark, path)
    assert after[0] == [*want, ("c", at(9)), ("d", at(9))] and after[1].count(("a", "duplicate")) == 2
    ingest.ingest_batch(episodes(spark, second), path, 1, buckets=4)  # replayed
    assert state(spark, path) == after
    ingest.ingest_batch(episodes(spark, []), path, 2, buckets=4)
    assert state(spark, path) == after and ingest.committed(spark, path) == [0, 1, 2]


def test_a_batch_without_its_ledger_entry_is_not_seen_and_comes_again(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "store"), [(f"e{i}", i, "{}") for i in range(30)]
    ingest.ingest_batch(episodes(spark, rows[:10]), path, 0, buckets=4)
    before = state(spark, path)

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(ingest, "math", type("M", (), {"ceil": killed}))  # after the rows are written, before the ledger
        with pytest.raises(RuntimeError):
            ingest.ingest_batch(episodes(spark, rows[5:]), path, 1, buckets=4)
    assert os.path.isdir(f"{path}/rows/epoch=1") and state(spark, path) == before
    ingest.ingest_batch(episodes(spark, rows[5:20]), path, 1, buckets=4)
    fine, bad = state(spark, path)
    assert [i for i, _ in fine] == sorted(f"e{i}" for i in range(20)) and bad == [(f"e{i}", "duplicate") for i in range(5, 10)]


def test_a_stream_starts_again_where_it_stopped(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(3):
        episodes(spark, [(f"e{i}", i, "{}") for i in range(k * 4, k * 4 + 6)]).coalesce(1).write.mode("append").parquet(f"{folder}/source")
        for _ in range(2):
            stream = spark.readStream.schema(EPISODES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")
            ingest.ingest_to_end(stream, f"{folder}/store", f"{folder}/checkpoint", buckets=2)
    fine, bad = state(spark, f"{folder}/store")
    assert len(fine) == 14 and bad == [(f"e{i}", "duplicate") for i in (4, 5, 8, 9)]


def test_filters_hold_their_ids_and_seldom_others():
    rng = np.random.default_rng(1)
    h = pd.DataFrame(rng.integers(-(2**63), 2**63 - 1, size=(60_000, 2)), columns=["h1", "h2"])
    h["episode_id"], h["bucket"] = [f"e{i}" for i in range(len(h))], 0
    parts = [ingest._build((0, 3, k), h[:30_000][h["h2"][:30_000] % 3 == k]) for k in range(3)]
    assert max(len(p["bits"][0]) for p in parts) < 30_000 / 3 * 1.1 * ingest.BITS / 8
    got = set(ingest._maybe((0,), h, pd.concat(parts, ignore_index=True))["episode_id"])
    assert got >= set(h["episode_id"][:30_000])
    assert len(got) - 30_000 < 0.02 * 30_000  # false alarms
    assert len(ingest._maybe((0,), h, pd.concat(parts)[:0])) == 0


MEMORY = "memory_id string, kind string, content string, embedding array<float>"


def test_a_provider_is_asked_once_for_each_text(spark, tmp_path):
    folder, calls = str(tmp_path), str(tmp_path / "calls")
    os.mkdir(calls)

    def embed(texts):
        with open(f"{calls}/{os.getpid()}", "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return np.array([[float(len(t)), 2.0] for t in texts]).reshape(len(texts), 2)

    def asked():
        return sorted(line.strip() for f in os.listdir(calls) for line in open(f"{calls}/{f}"))

    rng, rows = random.Random(2), []
    for i in range(60):
        rows.append((f"m{i:02d}", "fact", rng.choice(["alpha", "beta", "gamma", "", None]), [9.0] if i % 10 == 0 else None))
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, MEMORY).coalesce(1).write.mode("append").parquet(f"{folder}/memories")
        stream = spark.readStream.schema(MEMORY).option("maxFilesPerTrigger", 1).parquet(f"{folder}/memories")
        backfill.backfill_to_end(stream, f"{folder}/store", f"{folder}/checkpoint", Provider(embed), "m1")
    texts = sorted({r[2] for r in rows if r[2] is not None and r[3] is None})
    assert asked() == texts
    all_ = spark.createDataFrame(rows, MEMORY)
    backfill.backfill_batch(all_, f"{folder}/store", Provider(embed), "m1", 1)  # a replay
    assert asked() == texts
    got = {r["memory_id"]: r["embedding"] for r in backfill.with_vectors(spark, all_, f"{folder}/store").collect()}
    assert got == {i: v or (None if t is None else [float(len(t)), 2.0]) for i, _, t, v in rows}
    backfill.backfill_batch(all_, f"{folder}/store", Provider(embed), "m2", 2)  # another model has keys of its own
    assert asked() == sorted(texts * 2)


USAGE = "tenant_id string, subject_id string, created_at timestamp"


def usage_rows(n=6000):
    rng = random.Random(4)
    return [(rng.choice(["a", "b", None]), f"s{rng.randrange(2500)}" if i % 50 else None, None if i % 97 == 0 else T0 + dt.timedelta(hours=rng.randrange(24 * 40))) for i in range(n)]


def test_windows_of_days_come_from_their_sketches(spark, tmp_path):
    rows, path = usage_rows(), str(tmp_path)
    tables = {"episodes": spark.createDataFrame(rows, USAGE)}
    usage.store_days(tables, path, "2024-01-01", "2024-01-30")
    stamps = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    usage.store_days(tables, path, "2024-01-31", "2024-01-31")
    now = {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    assert stamps.items() <= now.items() and {d for d in os.listdir(path) if d.startswith("day=")} == {f"day=2024-01-{d:02d}" for d in range(1, 32)}  # one day more touches no other
    got = {(r["tenant_id"], r["days"]): (r["n"], r["subjects"]) for r in usage.rolling_usage(spark, path, "2024-01-31").collect()}
    for tenant in ("a", "b", None):
        for days in (1, 7, 30):
            low = dt.datetime(2024, 2, 1) - dt.timedelta(days=days)
            inside = [r for r in rows if r[0] == tenant and r[2] is not None and low <= r[2] < dt.datetime(2024, 2, 1)]
            exact = len({r[1] for r in inside if r[1] is not None})
            assert got[tenant, days][0] == len(inside)
            assert abs(got[tenant, days][1] - exact) <= max(1, 3 * usage.ERROR * exact)
    text = usage.rolling_usage(spark, path, "2024-01-31", (7,))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "day" in text.split("PartitionFilters")[1][:200]


def test_a_day_stored_again_is_replaced(spark, tmp_path):
    path = str(tmp_path)
    one = spark.createDataFrame([("a", "s", T0), ("a", "t", T0)], USAGE)
    for df in (one, one, one.limit(1)):
        usage.store_days({"episodes": df}, path, "2024-01-01", "2024-01-01")
    assert [tuple(r) for r in usage.rolling_usage(spark, path, "2024-01-01", (1,)).collect()] == [("a", "episodes", 1, 1, 1)]


def test_rollup_tells_subtotals_from_null_tenants(spark):
    one = spark.createDataFrame([("a", "s", T0), ("a", "t", T0), (None, "s", T0)], USAGE)
    got = {tuple(r) for r in usage.usage_rollup({"episodes": one, "jobs": one.where("subject_id = 's'")}).collect()}
    assert got == {(0, "a", "s", 1, 1), (0, "a", "t", 1, 0), (0, None, "s", 1, 1), (1, "a", None, 2, 1), (1, None, None, 1, 1), (3, None, None, 3, 2)}
    assert usage.usage_days({"episodes": one.where("false")}).agg(F.count("*")).first()[0] == 0


def store_rows(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, subject_id string, session_id string, status string, updated_at long")


STORE = "tenant_id string, subject_id string, session_id string, status string, updated_at bigint"


def test_a_purge_rewrites_only_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    from recollect.operators import store

    path = str(tmp_path)
    rows = [(["a", None][i % 2], f"s{i % 100}", f"x{i}", "open", i) for i in range(1000)]
    store.create_store(store_rows(spark, rows), path, buckets=32)
    read = lambda: sorted(map(tuple, store.read_store(spark, path, STORE).collect()), key=repr)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}
    assert read() == sorted(rows, key=repr)
    before = files()
    gone = store_rows(spark, [("a", "s4", None, None, None), ("a", "nobody", None, None, None)]).select("tenant_id", "subject_id")
    touched = store.purge_stored(spark, path, STORE, gone)
    left = [r for r in rows if r[:2] != ("a", "s4")]
    assert len(touched) <= 2 and read() == sorted(left, key=repr)
    new = {f: t for f, t in files().items() if f not in before}
    assert before.items() <= files().items() and 0 < len(new) <= 2  # what was there is as it was

    with monkeypatch.context() as m:  # killed between its rows and its commit
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.purge_stored(spark, path, STORE, gone.limit(0).union(store_rows(spark, [(None, "s5", None, None, None)]).select("tenant_id", "subject_id")))
    assert read() == sorted(left, key=repr)
    store.purge_stored(spark, path, STORE, store_rows(spark, [(None, "s5", None, None, None)]).select("tenant_id", "subject_id"))
    assert read() == sorted([r for r in left if r[:2] != (None, "s5")], key=repr)
    assert store.purge_stored(spark, path, STORE, gone.limit(0)) == []


def test_upserts_keep_the_last_state_and_refuse_a_lost_race(spark, tmp_path):
    from recollect.operators import store

    path = str(tmp_path)
    store.create_store(store_rows(spark, [(None, "s", "x", "open", 1), ("a", "s", "x", "open", 1), ("a", "t", "y", "open", 1)]), path, buckets=4)
    new = store_rows(spark, [("a", "s", "x", "resolved", 2), ("a", "s", "x", "again", 3), ("a", "u", "z", "open", 1)])
    store.upsert_stored(spark, path, STORE, new, ("tenant_id", "subject_id", "session_id"), "updated_at")
    got = {tuple(r) for r in store.read_store(spark, path, STORE).collect()}
    assert got == {(None, "s", "x", "open", 1), ("a", "s", "x", "again", 3), ("a", "t", "y", "open", 1), ("a", "u", "z", "open", 1)}
    with pytest.raises(Exception, match="(?i)exists"):
        store._commit(spark, path, 1, {0: 1})


def test_read_jdbc_reads_ranges(spark):
    from recollect.sources.schemas import read_jdbc

    url = "jdbc:derby:memory:recollect;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id AS n", "CAST(id * 2 AS int) AS twice").write.format("jdbc").options(url=url, dbtable="figures", **options).save()
    rows = read_jdbc(spark, url, "figures", "n", "0", "100", 4, **options)
    assert rows.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, rows.collect())) == [(i, 2 * i) for i in range(100)]
