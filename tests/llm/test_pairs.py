"""Near-duplicate operators and components against brute force."""

import random
import re

import numpy as np
import pytest

from recollect.llm import embedding_neardup, setsketch
from recollect.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, n long, key string, comp long"


def roots(ids, edges):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {
        "path": [(i, i + 1) for i in range(40)],
        "star": [(17, i) for i in range(40)],
        "random": [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)],
        "none": [],
    }[shape]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in roots({x for e in edges for x in e}, edges).items() if k in nodes}


def test_components_of_a_hub(spark):
    edges = spark.range(1, 100_001).selectExpr("50000L AS a", "CASE WHEN id = 50000 THEN 0 ELSE id END AS b")
    got = connected_components(edges).selectExpr("count(*)", "count(DISTINCT id)", "max(component)").first()
    assert tuple(got) == (100_001, 100_001, 0)


def shingles(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return set(zip(*[words[i:] for i in range(k)])) if len(words) >= k else ({tuple(words)} if words else set())


def brute_documents(rows, p):
    rows = [(i, t) for i, t in rows if i is not None]
    sets = [(i, shingles(t, p.words)) for i, t in rows]
    edges = [
        (a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x]
        if s and t and p.den * len(s & t) >= p.num * len(s | t)
    ]
    return roots({i for i, _ in rows}, edges), edges


def near_copies(rng, n, base_words, edits):
    words = [f"w{rng.randint(0, 5000)}" for _ in range(base_words)]
    out = [" ".join(words)]
    for _ in range(n - 1):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 5000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("p", [setsketch.Params(), setsketch.Params(words=5, num=8, den=10, bands=26), setsketch.Params(block=8)])
def test_near_documents(spark, p):
    rng = random.Random(7)
    texts = near_copies(rng, 30, 200, 6) + near_copies(rng, 10, 40, 1) + [f"only {rng.random()} here {i}" for i in range(20)]
    texts += ["Same Text\there", "same  text\nHERE", "one", "ONE", "two words", "two words", "", None, " \t ", "é\x1c\x85 a b c", "é\x1c\x85 A B c"]
    texts += [" ".join(f"t{i}" for i in range(30_000))]
    rng.shuffle(texts)
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame([(i, t, None, None, 1, 1, 1, "k", 1) for i, t in rows], DOCS)
    expected, edges = brute_documents(rows, p)
    got = setsketch.near_duplicates(df, p).collect()
    assert len(got) == len(rows) and len(edges) > 30
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {i: len(shingles(t, p.words)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_near_documents_of_nothing(spark):
    assert setsketch.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert setsketch.near_duplicates(spark.createDataFrame([(1, "", None, None, 1, 1, 1, "k", 1)], DOCS)).first()["kept"]


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(0)
    p = setsketch.Params()
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = a.copy()
    b[:500] = rng.integers(0, 2**63, 500, dtype=np.uint64)
    same = np.mean([np.equal(*setsketch.registers([x, y], p)).mean() for x, y in ((setsketch.mix64(a + np.uint64(i)), setsketch.mix64(b + np.uint64(i))) for i in range(20))])
    assert abs(same - 1500 / 2500) < 0.03
    union = setsketch.registers([np.union1d(a, b)], p)[0]
    assert (union == np.maximum(*setsketch.registers([a, b], p))).all()  # sketches merge


def test_sketches_are_scored_once(spark):
    """Scores that are filtered too are made by one Python operator: two a task would take twice the workers."""
    p = setsketch.Params()
    near, far = setsketch.registers([np.arange(1, 400, dtype=np.uint64), np.arange(10**6, 10**6 + 400, dtype=np.uint64)], p)
    rows = [(bytearray(near), bytearray(x), 399, 399) for x in (near, far)]
    df = spark.createDataFrame(rows, "ra binary, rb binary, na long, nb long")
    scored = df.select(setsketch._scorer(p)("ra", "rb", "na", "nb").alias("same")).where("same >= 0")
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r["same"] for r in scored.collect()] == [1.0]


EMBED = "vec_id long, embedding array<double>, label int, e int, m int, rep int"


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.vstack([base] + [base[:8] + 0.35 * rng.standard_normal((8, 16)) for _ in range(8)] + [base[:4] * 3, base[:4]])
    rows = [(2 * i, v.tolist(), 0, 1, 1, 1) for i, v in enumerate(x)]
    odd = [(1, None), (3, []), (5, [0.0] * 16), (7, [float("nan")] + [1.0] * 15), (9, [float("inf")] * 16), (11, [None] + [1.0] * 15), (13, [1.0] * 8), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + [(i, v, 0, 1, 1, 1) for i, v in odd], EMBED)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = roots([2 * i for i in range(len(x))], [(2 * int(i), 2 * int(j)) for i, j in np.argwhere(near)])
    got = embedding_neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        i = r["vec_id"]
        if i is None or i % 2:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, i, True)
        else:
            assert (r["n_links"], r["component_id"]) == (near[i // 2].sum(), comp[i])
    assert near.sum() > 40


def test_near_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal(32) + 0.05 * rng.standard_normal((90, 32))
    monkeypatch.setattr(embedding_neardup.Plan, "block", 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_neardup.near_duplicates(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(89, 0)}


def test_codes_are_small_whatever_the_number_of_bands():
    import pandas as pd

    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"rep": range(20), "e": list(rng.standard_normal((20, 64)))})
    for n in (50_000, 10**9, 10**12):
        plan = embedding_neardup.Plan.of(n, 64, 0.9)
        assert plan.bands <= 190
        out = pd.concat(embedding_neardup._coder(plan, True)([rows]))
        assert len(out) == 20 * plan.bands and list(out.columns) == ["rep", "factor", "scale", "key", "code"]
        assert set(out["code"].map(len)) == {64 // 8 + 64}


def test_near_vectors_of_nothing(spark):
    assert embedding_neardup.near_duplicates(spark.createDataFrame([], EMBED)).count() == 0
    one = embedding_neardup.near_duplicates(spark.createDataFrame([(4, [1.0, 0.0], 0, 1, 1, 1)], EMBED)).first()
    assert (one["n_links"], one["component_id"], one["kept"]) == (0, 4, True)
