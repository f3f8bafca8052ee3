"""Keyed streams over several micro-batches that mix times: they give what one ordered pass gives, and lose nothing unseen."""

import datetime as dt
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from recollect.operators import health
from recollect.streaming import jobs as streams

T0 = dt.datetime(2024, 1, 1)
STATES = "tenant_id string, subject_id string, state string, updated_at timestamp"
EVENTS = "key long, event_id long, ts timestamp"


def feed(spark, folder, schema, batch, n):
    """One more file of the source."""
    spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/source")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def alerts_of(rows):
    """One ordered pass a (tenant, subject)."""
    out, last = [], {}
    for tenant, subject, state, when in sorted(rows, key=lambda r: (r[3], r[2])):
        before, rank = last.get((tenant, subject)), {"healthy": 0, "watch": 1, "at_risk": 2}
        worse = rank[state] - rank[before or "healthy"]
        if worse > 0 or worse < 0 and before:
            out.append((tenant, subject, "subject.health_degraded" if worse > 0 else "subject.health_improved", before or "healthy", state, when))
        last[tenant, subject] = state
    return Counter(out)


def read(spark, folder, schema):
    return [tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/rows").collect()]


def test_alerts_in_order_over_batches_late_rows_and_restart(spark, tmp_path):
    rng, folder = random.Random(1), str(tmp_path)
    rows = [(rng.choice([None, "acme", "globex"]), f"s{rng.randrange(4)}", rng.choice(["healthy", "watch", "at_risk"]), at(i // 2)) for i in range(160)]
    shuffled = rng.sample(rows, len(rows))
    end = (None, None, None, at(100_000))  # moves the watermark alone; a null subject is one of its own

    def run(n):
        stream = spark.readStream.schema(STATES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")
        alerts = streams.health_alert_stream(stream.where("subject_id IS NOT NULL OR state IS NULL"), delay="3 hours")
        streams.run_to_end(alerts, f"{folder}/rows", f"{folder}/checkpoint")
        return [r for r in read(spark, folder, alerts.schema) if r[1] is not None]

    for k in range(3):
        feed(spark, folder, STATES, shuffled[k::3], k)
    assert run(1) == []  # all wait: nothing is three hours behind the newest row
    feed(spark, folder, STATES, [end], 3)
    want = alerts_of(rows)
    assert Counter(run(2)) == want and len({t for t, *_ in want}) == 3
    assert Counter(run(3)) == want  # a restart repeats none

    # Behind the watermark: a row after all of its subject's is read in order, one before is told as late and changes nothing.
    late, fine = ("acme", "s0", "at_risk", at(1)), ("acme", "s0", "at_risk", at(90_000))
    feed(spark, folder, STATES, [late, fine], 4)
    feed(spark, folder, STATES, [(None, None, None, at(200_000))], 5)
    got = Counter(run(4)) - want
    assert got.pop(("acme", "s0", "late", None, "at_risk", at(1))) == 1
    assert got == alerts_of([*rows, fine]) - want


def test_alerts_without_time_are_late(spark, tmp_path):
    folder = str(tmp_path)
    stream = feed(spark, folder, STATES, [("a", "s", "at_risk", None), ("a", "s", "watch", at(1)), ("a", "s", "healthy", at(9_000))], 0)
    alerts = streams.health_alert_stream(stream, delay="1 minute")
    streams.run_to_end(alerts, f"{folder}/rows", f"{folder}/checkpoint")
    got = read(spark, folder, alerts.schema)
    assert sorted(r[2] for r in got) == ["late", "subject.health_degraded"] and [r[5] for r in got if r[2] == "late"] == [None]


def test_forgotten_subjects_are_new(spark, tmp_path):
    folder, day = str(tmp_path), 24 * 60
    for k, row in enumerate([("a", "s", "at_risk", at(0)), ("a", "other", "healthy", at(10 * day)), ("a", "s", "healthy", at(11 * day)), ("a", "other", "healthy", at(30 * day))]):
        stream = feed(spark, folder, STATES, [row], k)
        alerts = streams.health_alert_stream(stream, delay="1 minute", forget_days=2)
        streams.run_to_end(alerts, f"{folder}/rows", f"{folder}/checkpoint")
    got = read(spark, folder, alerts.schema)
    assert [(r[2], r[4]) for r in got if r[1] == "s"] == [("subject.health_degraded", "at_risk")]  # no improvement: it was forgotten


def test_batch_alerts_of_one_time_go_by_state(spark):
    rows = [("a", "s", "watch", at(0)), ("a", "s", "at_risk", at(0)), ("b", "s", "healthy", at(1))]
    got = health.health_transitions(spark.createDataFrame(rows, STATES)).select("tenant_id", "subject_id", "event", F.coalesce("previous_state", F.lit("healthy")), "state", "updated_at")
    assert Counter(tuple(r) for r in got.collect()) == alerts_of(rows)


def admitted_of(rows, rpm, seconds):
    out, windows = {}, {}
    for key, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        window = windows.setdefault(key, deque())
        while window and window[0] <= ts - dt.timedelta(seconds=seconds):
            window.popleft()
        out[event] = len(window) < rpm
        if out[event]:
            window.append(ts)
    return out


def test_admission_stream_is_the_replay_and_keeps_one_window(spark, tmp_path):
    rng, folder = random.Random(2), str(tmp_path)
    rows = [(rng.randrange(3), i, T0 + dt.timedelta(seconds=rng.randrange(900), microseconds=rng.randrange(3))) for i in range(300)]
    for k in range(10):
        feed(spark, folder, EVENTS, rows[k::10], k)
    feed(spark, folder, EVENTS, [(9, -5, at(100_000))], 10)
    feed(spark, folder, EVENTS, [(9, -4, at(100_001))], 11)  # the timers of all that waits have run
    feed(spark, folder, EVENTS, [(0, 1000, at(0)), (0, 1001, at(50))], 12)
    feed(spark, folder, EVENTS, [(9, -3, at(200_000))], 13)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")
    judged = streams.sliding_admission_stream(stream, rpm=4, seconds=60.0, delay="1 hour")
    streams.run_to_end(judged, f"{folder}/rows", f"{folder}/checkpoint")
    got = {r[1]: (r[3], r[4]) for r in read(spark, folder, judged.schema)}
    want = admitted_of(rows, 4, 60)
    assert {e: a for e, (a, late) in got.items() if not late and e >= 0} == want
    assert {e: a for e, (a, late) in got.items() if late} == {1000: None, 1001: None}
    assert 0 < sum(want.values()) < len(want)
    kept = spark.read.format("statestore").option("stateVarName", "carry").option("operatorId", 0).load(f"{folder}/checkpoint")
    assert kept.count() <= 3 * 4  # every key's window has passed, and its times have gone with it


def test_late_episodes_are_compiled(spark, tmp_path):
    folder = str(tmp_path)
    schema = "episode_id string, tenant_id string, subject_id string, payload string, created_at timestamp"
    batches = [[("e1", "a", "s", '{"text":"one"}', at(100_000))], [("e2", "a", "s", '{"text":"two"}', at(0)), ("e1", "a", "s", '{"text":"one"}', at(100_000))]]
    for delay, least in (("1 hour", 2), (None, 3)):
        place = f"{folder}/{delay}"
        for k, batch in enumerate(batches):
            stream = feed(spark, place, schema, batch, k)
            memories = streams.stream_compile(stream, delay)
            streams.run_to_end(memories, f"{place}/rows", f"{place}/checkpoint")
        rows = spark.read.schema(memories.schema).parquet(f"{place}/rows")
        assert rows.count() == least
        assert sorted(r["content"] for r in streams.distinct_memories(rows).collect()) == ["one", "two"]


@pytest.mark.parametrize("setting", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_the_sessions_state_store_stays(spark, setting):
    from recollect.streaming.ordered import _STORE, keyed_state

    before = spark.conf.get(_STORE, None)
    if setting:
        spark.conf.set(_STORE, setting)
    held = spark.conf.get(_STORE, None)
    with keyed_state(spark):
        assert "RocksDB" in spark.conf.get(_STORE)
    assert spark.conf.get(_STORE, None) == held
    if before is None:
        spark.conf.unset(_STORE)
