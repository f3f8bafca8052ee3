"""What jobs leave in the shared folder and in shuffle files."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from recollect.operators import conflict_index, conflicts, lifecycle
from recollect.sources import scratch

T0 = dt.datetime(2024, 1, 1)
MEMORY = "memory_id string, tenant_id string, subject_id string, kind string, content string, status string, created_at timestamp, valid_from timestamp"


def tables(spark):
    folder = scratch.scratch(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    return {p.rsplit("/", 1)[1] for p in glob.glob(f"{folder}/*")}


def made(spark, before):
    return sorted(n[:-33] for n in tables(spark) - before)


def memories(spark):
    return spark.createDataFrame([(f"m{i}", None, f"s{i % 3}", "fact", f"word a b c d e {i % 2}", "active", T0 + dt.timedelta(hours=i), T0) for i in range(30)], MEMORY)


def test_settled_leaves_its_own_table(spark):
    before = tables(spark)
    out = scratch.settled(spark, lambda: scratch.materialize(spark.range(9), "inner").groupBy((F.col("id") % 2).alias("k")).count(), "outer")
    assert sorted(map(tuple, out.collect())) == [(0, 5), (1, 4)] and made(spark, before) == ["outer"]


def test_conflicts_keep_rows_and_marks(spark, tmp_path):
    before = tables(spark)
    lost = conflicts.superseders(memories(spark))
    assert lost.count() == 24 and made(spark, before) == ["conflict-marks", "conflict-rows"]
    before = tables(spark)
    assert conflict_index.add_batch(str(tmp_path), memories(spark), 0, buckets=2).count() == 24
    assert made(spark, before) == []
    assert not {"lo", "hi"} & set(spark.read.parquet(f"{tmp_path}/postings").columns)


def test_subjects_of_one_part_are_not_sorted(spark):
    rows = [(f"e{i}", None, "big" if i % 2 else "small", None, "s", "t", "x" * 90, "{}", "{}", T0 + dt.timedelta(hours=i)) for i in range(20)]
    rows = [r for r in rows if r[2] == "big" or r[0] < "e2"]
    names = "episode_id string, tenant_id string, subject_id string, session_id string, source string, type string, payload string, metadata string, provenance string, created_at timestamp"
    before = tables(spark)
    docs = lifecycle.export_subjects(spark.createDataFrame(rows, names), memories(spark).limit(0), "2024-02-01 00:00:00", most_rows=100, most_bytes=1500)
    got = {(r["subject_id"], r["part"]): r for r in docs.collect()}
    small = sum(1 for r in rows if r[2] == "small")
    assert got["small", 1]["parts"] == 1 and got["small", 1]["episode_count"] == small
    assert got["big", 1]["parts"] == max(p for s, p in got if s == "big") > 1 and got["big", 1]["episode_count"] == 10
    assert lifecycle.verify_export(docs).where("problem IS NULL").count() == len(got)
    assert lifecycle.verify_export(docs.where("NOT (subject_id = 'big' AND part = 2)")).where("problem = 'parts'").count() == len(got) - 2
    folder = scratch.scratch(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    (cut,) = [n for n in tables(spark) - before if n.startswith("export-cuts")]
    assert {r[0] for r in spark.read.parquet(f"{folder}/{cut}").select("subject_id").distinct().collect()} == {"big"}
