"""Look-ups along lines that are cut between partitions, and memories that come batch by batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import asof, conflict_index, conflicts, explore

T0 = dt.datetime(2024, 1, 1)
MEMORY = "memory_id string, tenant_id string, subject_id string, kind string, content string, status string, created_at timestamp, valid_from timestamp, source_episode_ids array<string>"


def lines(seed, n=300):
    """One key holds most rows, and one of them is null."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 7 + ["b", None, "c"]), i, rng.choice([None, None, None, i])) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_last_and_count_before(spark, partitions):
    rows = lines(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(random.Random(9).sample(rows, len(rows)), "k string, i int, v int")
        laid = asof.in_ranges(df, ["k"], [F.col("i")], "test")
        if partitions > 3:
            assert laid.where("k = 'hot'").select("_part").distinct().count() > 5  # the hot key is over several partitions
        last = {r["i"]: r["found"] for r in asof.last_before(df, ["k"], [F.col("i")], F.col("v"), "test").collect()}
        count = {r["i"]: r["found"] for r in asof.count_before(df, ["k"], [F.col("i")], F.col("v").isNotNull(), "test").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    seen = {}
    for k, i, v in rows:
        had = seen.setdefault(k, [])
        assert last[i] == (had[-1] if had else None) and count[i] == len(had)
        if v is not None:
            had.append(v)
    empty = df.limit(0)
    assert asof.last_before(empty, ["k"], [F.col("i")], F.col("v"), "test").count() == 0


def memories(spark, rows):
    return spark.createDataFrame(rows, MEMORY)


def test_lineage_of_a_hot_subject(spark):
    rng = random.Random(5)
    rows = [
        (f"m{i:03d}", None, "hot" if i % 5 else "cold", "fact", "x", rng.choice(["active", "superseded", "archived"]), T0 + dt.timedelta(hours=rng.randrange(60)), None, ["e"] if i % 7 else [])
        for i in range(250)
    ]
    up = {r["memory_id"]: r["superseding_id"] for r in explore.lineage_superseder(memories(spark, rows)).collect()}
    down = {}
    for r in explore.lineage_superseded(memories(spark, rows), n=4).collect():
        down.setdefault(r["memory_id"], {})[r["rank"]] = r["superseded_id"]
    for m in rows:
        same = [o for o in rows if o[2] == m[2]]
        later = sorted((o[6], o[0]) for o in same if o[5] == "active" and o[6] > m[6])
        assert up.get(m[0]) == (later[0][1] if m[5] == "superseded" and m[8] and later else None)
        gone = sorted(((o[6], o[0]) for o in same if o[5] == "superseded" and o[6] < m[6]), reverse=True)[:4]
        assert down.get(m[0], {}) == ({k: x[1] for k, x in enumerate(gone, 1)} if m[5] == "active" else {})


def random_memories(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    return [
        (f"m{i:03d}", rng.choice([None, "", "t"]), rng.choice(["s", "s", "u"]), rng.choice(["profile_fact", "episode_summary"]),
         " ".join(rng.sample(words, rng.randint(0, 5))), rng.choice(["active"] * 5 + ["superseded"]), T0 + dt.timedelta(hours=rng.randrange(30)), T0 + dt.timedelta(days=i), [])
        for i in range(n)
    ]


def marks_of(rows):
    """The rule as it stands: the earliest later active memory of the same kind that is similar enough."""
    out, sets = {}, {r[0]: set(r[4].split()) for r in rows}
    for m in rows:
        for o in sorted(rows, key=lambda r: (r[6], r[0])):
            if m[5] == o[5] == "active" and m[1:4] == o[1:4] and (o[6], o[0]) > (m[6], m[0]):
                both, one = sets[m[0]] & sets[o[0]], sets[m[0]] | sets[o[0]]
                if one and 5 * len(both) >= (3 if m[3] == "profile_fact" else 4) * len(one) and sets[m[0]] and sets[o[0]]:
                    out[m[0]] = (o[0], o[7])
                    break
    return out


def as_marks(df):
    got = [(r["memory_id"], (r["superseded_by"], r["valid_to"])) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_superseders_are_those_of_the_rule(spark, seed):
    rows = random_memories(160, seed)
    want = marks_of(rows)
    assert want and as_marks(conflicts.superseders(memories(spark, rows))) == want


@pytest.mark.parametrize("in_order", [True, False])
def test_batches_give_the_marks_of_one_run(spark, tmp_path, in_order):
    rows, path = random_memories(150, 7), str(tmp_path)
    turn = sorted(rows, key=lambda r: r[6]) if in_order else random.Random(3).sample(rows, len(rows))
    batches, made = [turn[:60], turn[60:61], turn[61:], []], {}
    for k, batch in enumerate(batches):
        new = as_marks(conflict_index.add_batch(path, memories(spark, batch), k, buckets=4))
        assert all(made.get(m) != v for m, v in new.items())  # what is known already isn't told again
        made |= new
        so_far = [r for b in batches[: k + 1] for r in b]
        assert made == marks_of(so_far) == as_marks(conflict_index.marks(spark, path, k + 1))
    again = as_marks(conflict_index.add_batch(path, memories(spark, batches[2]), 2, buckets=4))  # a batch that is run again
    assert again and as_marks(conflict_index.marks(spark, path, 4)) == marks_of(rows)


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    path = str(tmp_path)
    rows = [(f"m{i}", None, f"s{i % 40}", "profile_fact", f"likes tea number {i}", "active", T0 + dt.timedelta(hours=i), T0, []) for i in range(400)]
    conflict_index.add_batch(path, memories(spark, rows), 0, buckets=16)
    new = memories(spark, [("n", None, "s3", "profile_fact", "likes tea number 3", "active", T0 + dt.timedelta(days=90), T0, [])])
    bucket = [r[0] for r in conflicts.word_sets(new).select(conflict_index._bucket(16)).collect()]
    read = conflict_index._read(spark, path, "rows", 1)
    part = read.where(F.col("bucket").isin(bucket))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert 0 < files(part) < files(read) / 4 and part.count() < 100
    assert "bucket" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    got = as_marks(conflict_index.add_batch(path, new, 1, buckets=16))
    assert got == {"m363": ("n", T0)}  # all of the subject's are alike; each but the last has its superseder


EPISODE = "episode_id string, tenant_id string, subject_id string, payload string, created_at timestamp"


@pytest.mark.parametrize(("partitions", "most"), [(1, 50), (12, 50), (12, 7), (12, 100_000)])
def test_prompt_batches_of_a_hot_subject_are_those_of_a_plain_loop(spark, partitions, most):
    from recollect.operators.compile import pack_prompt_batches

    rng = random.Random(partitions + most)
    rows = [(f"e{i:03d}", rng.choice([None, "t"]) if i % 9 == 0 else "hot", "s" if i % 9 else f"s{i % 4}", '{"text":"' + "x" * rng.randrange(0, 40) + '"}', T0 + dt.timedelta(minutes=rng.randrange(500))) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["episode_id"]: r["batch"] for r in pack_prompt_batches(spark.createDataFrame(rows, EPISODE), most=most, text_cap=30).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want, state = {}, {}
    for i, t, s, payload, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        n = min(30, len(payload) - len('{"text":""}'))
        if n:
            used, batch = state.get((t, s), (0, 0))
            if used and used + n > most:
                used, batch = 0, batch + 1
            want[i], state[t, s] = batch, (used + n, batch)
    assert got == want


def test_exports_of_a_hot_subject_are_spread(spark):
    from recollect.operators import lifecycle

    eps = spark.createDataFrame([(f"e{i:03d}", None, "hot" if i % 6 else "cold", '{"text":"hello"}', T0 + dt.timedelta(minutes=i % 50)) for i in range(300)], EPISODE)
    eps = eps.withColumns({"source": F.lit("user"), "type": F.lit("message"), "metadata": F.lit("{}"), "provenance": F.lit("{}")})
    mem = memories(spark, [(f"m{i}", None, "hot", "fact", f"fact {i}", "active", T0, T0, []) for i in range(20)]).withColumns({"summary": F.lit(""), "confidence": F.lit(1.0), "valid_to": F.lit(None).cast("timestamp"), "metadata": F.lit("{}")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = lifecycle.export_rows(eps, mem).collect()
        whole = {r["subject_id"]: r for r in lifecycle.export_subjects(eps, mem, "2024-02-01 00:00:00").collect()}
        parts = lifecycle.export_subjects(eps, mem, "2024-02-01 00:00:00", most_rows=40).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    placed = {}
    for r in rows:
        placed.setdefault((r["subject_id"], r["item"]), {})[r["position"]] = r
    for (subject, item), by in placed.items():
        assert sorted(by) == list(range(1, len(by) + 1))
        times = [(r["row"].split('"created_at":"')[1][:19], r["id"]) for _, r in sorted(by.items())]
        assert times == sorted(times)
        inner = ",".join(r["row"] for _, r in sorted(by.items()))
        assert inner in whole[subject]["document"]
    assert (whole["hot"]["episode_count"], whole["hot"]["memory_count"], whole["cold"]["parts"]) == (250, 20, 1)
    hot = sorted((r for r in parts if r["subject_id"] == "hot"), key=lambda r: r["part"])
    assert [r["part"] for r in hot] == list(range(1, hot[0]["parts"] + 1)) and len(hot) >= 7
    body = lambda key: ",".join(x for r in hot if (x := r["document"].split(f'"{key}":[')[1].split("]}" if key == "memories" else '],"memories"')[0]))
    assert f'"episodes":[{body("episodes")}],"memories":[{body("memories")}]}}' in whole["hot"]["document"]
