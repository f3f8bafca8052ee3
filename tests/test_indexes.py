"""Indexes against the scans and exact searches that they stand in for."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import gram_index, search, vector_index

T0 = dt.datetime(2024, 1, 1)
TEXTS = "memory_id string, tenant_id string, subject_id string, kind string, content string, status string, created_at timestamp"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng, path = random.Random(3), str(tmp_path_factory.mktemp("grams"))
    words = ["export", "EXPORT", "Straße", "İstanbul", "naïve", "job", "100%", "a_b", "x", "日本語テキスト", "jobs\nfail"]
    rows = [
        (f"m{i:04d}", rng.choice([None, "a"]), "hot" if i % 3 else f"s{i % 7}", rng.choice(["fact", "note"]), None if i % 50 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 6))),
         "active" if i % 9 else "superseded", T0 + dt.timedelta(hours=rng.randrange(500)))
        for i in range(900)
    ] + [("rare", None, "s1", "fact", "the Zyzzyva beetle", "active", T0)]
    df = spark.createDataFrame(rows, TEXTS)
    for batch, part in enumerate(("memory_id < 'm0500'", "memory_id >= 'm0500'")):
        gram_index.add_memories(path, df.where(part), batch, buckets=8)
    return df, path


def ids(df):
    return sorted(r["memory_id"] for r in df.collect())


@pytest.mark.parametrize("query", ["export job", "STRASSE", "straße", "istanbul", "İstanbul", "naï", "日本語", "zyzzyva", "no such words", "jobs\nf", "job export job", "100%", "a_b", "jo", "", "x x"])
def test_postings_find_what_the_scan_finds(spark, texts, query):
    df, path = texts
    for kind, limit in ((None, None), ("fact", 3)):
        got = gram_index.search_indexed(spark, path, query, kind, limit, buckets=8)
        assert ids(got) == ids(search.search_memories(df, kind, query, limit))


def test_few_rows_are_verified(spark, texts):
    df, path = texts
    assert gram_index.candidates(spark, path, "zyzzyva", buckets=8).count() == 1
    assert gram_index.candidates(spark, path, "zyzzyvx", buckets=8).count() == 0
    holding = search.search_memories(df, None, "export", None).count()
    assert holding <= gram_index.candidates(spark, path, "export", buckets=8).count() <= 1.2 * holding
    assert gram_index.indexable("abc") and not any(map(gram_index.indexable, ("ab", "a%c", "a_c", "a\\c", "")))


def test_a_batch_run_again_and_later_states(spark, texts, tmp_path):
    df, _ = texts
    path = str(tmp_path)
    for batch in (0, 0):
        gram_index.add_memories(path, df, batch, buckets=8)
    found = ids(search.search_memories(df, None, "export", None))
    assert ids(gram_index.search_indexed(spark, path, "export", None, None, buckets=8)) == found
    lost = spark.createDataFrame([(found[0],)], "memory_id string")
    assert ids(gram_index.search_indexed(spark, path, "export", None, None, lost, buckets=8)) == found[1:]


VECTORS = "memory_id string, tenant_id string, subject_id string, status string, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((40, 32))
    x = np.repeat(centers, 100, axis=0) + 0.6 * rng.standard_normal((4000, 32))
    rows = [(f"m{i:04d}", [None, "a", "b"][i % 3], "s", "active", v.tolist()) for i, v in enumerate(x)]
    rows += [("zero", None, "s", "active", [0.0] * 32), ("null", None, "s", "active", None), ("gone", None, "s", "superseded", x[0].tolist()), ("far", None, "other", "active", x[0].tolist())]
    return spark.createDataFrame(rows, VECTORS).repartition(4).cache()


def asked(memories, *tenant):
    rows = memories.where("memory_id LIKE 'm%0'")
    tenant = F.col("tenant_id") if tenant else F.lit(None).cast("string")
    return rows.select(tenant.alias("tenant_id"), "subject_id", F.col("memory_id").alias("query_id"), F.col("embedding").alias("vector"))


def pairs(df):
    return {(r["query_id"], r["memory_id"]): (r["rank"], round(r["distance"], 9)) for r in df.collect()}


def test_nine_tenths_for_a_seventh_of_the_work_without_fitting_anew(spark, vectors, tmp_path):
    path = str(tmp_path)
    came = "try_cast(substr(memory_id, 2) AS int) % 4 = 3"
    first, later = vectors.where(f"NOT coalesce({came}, false)"), vectors.where(came)
    vector_index.save_index(spark, vector_index.fit_index(first, cells=40, parts=8, sample=2000), path)
    vector_index.add_vectors(path, first, 0)
    fitted = {f: os.stat(f"{path}/parameters/{f}").st_mtime_ns for f in os.listdir(f"{path}/parameters")}
    vector_index.add_vectors(path, later, 1)
    vector_index.add_vectors(path, later, 1)  # run again
    for tenant in ((), ("own",)):
        queries = asked(vectors, *tenant)
        exact, found = pairs(search.semantic_topk(queries, vectors, k=10)), pairs(vector_index.search_index(path, queries, k=10, probes=4, short=6))
        hits = set(exact) & set(found)
        assert len(hits) >= 0.9 * len(exact) and len(found) == len(exact)
        assert all(abs(found[p][1] - exact[p][1]) < 1e-6 for p in hits)
        late = {p for p in exact if int(p[1][1:]) % 4 == 3}
        assert len(late & set(found)) >= 0.9 * len(late) > 0
    work = vector_index.index_work(path, asked(vectors), 10, 4, 6).first()
    assert work["queries"] == 400 and work["exact"] == 400 * 4000
    assert work["work"] <= 0.15 * work["exact"]
    assert fitted == {f: os.stat(f"{path}/parameters/{f}").st_mtime_ns for f in os.listdir(f"{path}/parameters")}


def test_all_lists_and_a_long_short_list_are_exact(spark, vectors, tmp_path):
    path, some = str(tmp_path), vectors.where("memory_id < 'm0300' OR memory_id >= 'zero'")
    vector_index.save_index(spark, vector_index.fit_index(some, cells=5, parts=5), path)
    vector_index.add_vectors(path, some, 0)
    queries = asked(some).union(spark.createDataFrame([(None, "nobody", "lost", [1.0] * 32)], "tenant_id string, subject_id string, query_id string, vector array<double>"))
    assert pairs(vector_index.search_index(path, queries, k=7, probes=5, short=100)) == pairs(search.semantic_topk(queries, some, k=7))


def test_short_lists_grow_with_their_cells(spark, tmp_path):
    """A fixed number of codes a query loses neighbours once cells hold many alike."""
    rng, path = np.random.default_rng(4), str(tmp_path)
    x = np.repeat(rng.standard_normal((4, 32)), 1000, axis=0) + 0.4 * rng.standard_normal((4000, 32))
    rows = spark.createDataFrame([(f"m{i:04d}", None, "s", "active", v.tolist()) for i, v in enumerate(x)], VECTORS)
    vector_index.save_index(spark, vector_index.fit_index(rows, cells=4, parts=8), path)
    vector_index.add_vectors(path, rows, 0)
    exact, found = pairs(search.semantic_topk(asked(rows), rows, k=5)), pairs(vector_index.search_index(path, asked(rows), k=5, probes=2, short=4))
    assert len(set(exact) & set(found)) >= 0.97 * len(exact)
    listed = vector_index.short_lists(path, asked(rows), 5, 2, 4).count()
    assert vector_index.index_work(path, asked(rows), 5, 2, 4).first()["work"] > listed > 400 * 20
    assert listed < 0.25 * 400 * 4000


def test_an_index_of_nothing(spark, vectors, tmp_path):
    path, none = str(tmp_path), vectors.limit(0)
    with pytest.raises(ValueError, match="no active memory"):
        vector_index.fit_index(none)
    vector_index.save_index(spark, vector_index.fit_index(vectors, cells=4, parts=4), path)
    vector_index.add_vectors(path, none, 0)
    assert vector_index.search_index(path, asked(vectors), k=3).count() == 0


def test_codes_come_close(vectors):
    x = search.sample_units(vectors, 10_000, 1)
    index = vector_index.fit_index(vectors, cells=40, parts=8)
    cell, code = index.encode(x)
    back = index.centers[cell] + np.concatenate([index.books[p][code[:, p]] for p in range(8)], axis=1)[:, :32]
    assert np.linalg.norm(back - x, axis=1).mean() < 0.5 * np.linalg.norm(index.centers[cell] - x, axis=1).mean()
    q = x[:5]
    ahead = index.tables(q)[:, np.arange(8)[None, :], code].sum(axis=2) + q @ index.centers[cell].T
    assert np.allclose(ahead, q @ back.T)
