"""Toxicity, Merkle manifest and hard negatives against brute force, and odd inputs."""

import math
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest

from recollect.llm import hard_negatives, merkle, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, leaf string, node string, path string, toxic int, score double, held_out string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, n, "x", 1, "x", "x", "x", 1, 0.5, "x") for i, t, la, s, n in rows], DOCS)


# Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf_of(row, text):
    i, _, la, s, n = row
    return h(*[field(x) for x in (i, s, la, n, text)])


def tree(leaves):
    """All levels, and the top node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k // 16 * 16 : k // 16 * 16 + 16]
        out.append((k % 16, run))
        k //= 16
    return out


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in by}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for k, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = path(trees[s], k) + path(top, place)
            proof = "".join(x for at, run in steps for j, x in enumerate(run) if j != at)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                node = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for at, run in steps:
                node = h(*run[:at], node, *run[at + 1 :])
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return Counter(out)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df):
    return Counter(tuple(r[n] for n in NAMES) for r in df.collect())


ODD = [
    (None, "No id", "en", "a", 5), (7, None, None, None, None), (5, "", "en", "É", 0), (5, "", "en", "É", 0), (5, "Other É", "en", "É", 7),
    (2**53 + 1, "Large Id", "en", "a", 8), (2**53 + 3, "X" * 100_000, "en", "z", 100_000), (-3, "Minus", "en", "", 5),
]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest_is_that_of_a_plain_tree(spark, depth):
    rng = random.Random(depth)
    rows = [(i, f"Text {rng.random()} É", rng.choice(["en", None]), "hot", i % 9) for i in range(700)]
    rows += [(1000 + i, f"Text {i}", "en", f"s{i % 40}", i) for i in range(90)] + ODD
    got = found(merkle.manifest(docs(spark, rows), depth=depth))
    assert got == expected(rows)
    assert {True, False} == {r[-1] for r in got}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "Abc", "en", "only", 3) for i in range(n)]
    assert found(merkle.manifest(docs(spark, rows), depth=1)) == (expected(rows) if n else Counter())


@pytest.mark.parametrize("blocks", [1, 2, 15, 16, 17, 33, 256, 257, 300])
def test_butterfly_brings_each_block_its_whole_path(spark, blocks):
    nodes = [h(str(k)) for k in range(blocks)]
    roots = spark.createDataFrame([("t", k, blocks * 16, x) for k, x in enumerate(nodes)], "tree string, block long, n long, node string")
    levels, got = tree(nodes), merkle.butterfly(roots, 1).collect()
    assert len(got) == blocks
    for r in got:
        assert r["node"] == levels[-1][0]
        assert [(s["place"], s["run"]) for s in r["path"]] == path(levels, r["block"])


# Hard negatives


def vectors(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, clusters), dims))
    x = rng.normal(size=(n, dims)) + (3 * base[np.arange(n) % clusters] if clusters else 0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def negatives_of(rows, positives=5, negatives=5):
    v = []
    for r, (i, e, la) in enumerate(rows):
        if i is None or e is None or la is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v.append((r, i, (la + 1) % 10 if i % 7 == 0 else la, [math.floor(256 * x) for x in e]))
    out = []
    for r, i, la, e in v:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), j, q, lb) for q, j, lb, f in v if q != r and len(f) == len(e))
        for p, j, _, _ in [s for s in scored if s[3] == la][:positives]:
            fit = [s for s in scored if s[3] != la and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(i, j, k, s[1], -p, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    rows = [(i, None if e is None else [None if x is None else float(x) for x in e], la, 1, 2, 3) for i, e, la in rows]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row int, dims int, score int"))
    assert dict(got.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("n", "dims", "clusters"), [(600, 24, 0), (900, 33, 12), (300, 1, 0)])
def test_hard_negatives_are_the_brute_force_ones(spark, n, dims, clusters):
    x = vectors(n, dims, n, clusters)
    rows = [(i * 5, x[i].tolist(), i % 4) for i in range(n)]
    want = negatives_of(rows)
    assert want and mined(spark, rows) == want


def test_hard_negatives_of_odd_rows(spark):
    x = vectors(60, 8, 3)
    rows = [(i, x[i % 30].tolist(), i % 2) for i in range(60)]  # ties
    rows += [(100, None, 1), (200, x[0].tolist(), None), (None, x[0].tolist(), 1), (300, [], 1), (301, [], 2), (400, [float("nan")] * 8, 1), (500, [None] * 8, 1)]
    rows += [(600, x[3].tolist() + [1.0], 1), (601, x[3].tolist() + [1.0], 1), (602, x[3].tolist() + [0.9], 2), (100, x[5].tolist(), 1), (100, x[5].tolist(), 1), (0, [0.0] * 8, 0)]
    assert mined(spark, rows) == negatives_of(rows)
    assert mined(spark, []) == [] and mined(spark, rows[61:63]) == []


def test_hard_negatives_beyond_floats(spark):
    rows = [(i * 100, [float(2**20 + i * 3), float(i), -1.0], i % 2) for i in range(12)]
    assert mined(spark, rows) == negatives_of(rows)


def test_bounds_hold_and_finer_ones_are_closer():
    x = np.floor(256 * vectors(400, 64, 9, clusters=8))
    table = pd.DataFrame({
        "row": range(400), "vec_id": range(400), "label": 0,
        "vector": [v.astype("<i8").tobytes() for v in x], "sketch": [s.tobytes() for s in hard_negatives.sketch(x)],
    })
    side = hard_negatives.Side(table, 64)
    i, j = np.nonzero(np.ones((400, 400), bool))
    true, widths = (x @ x.T)[i, j], []
    for level in range(len(hard_negatives.SEGMENTS)):
        for many in (True, False):
            lower, upper = hard_negatives._bounds(side, side, level, i, j, many)
            assert (lower <= true).all() and (true <= upper).all()
        widths.append((upper - lower).mean())
    assert widths == sorted(widths, reverse=True)


# Toxicity


def toxic_docs(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeimnorst", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 200))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(1 + len(text) // 60):
                text.insert(rng.randrange(len(text)), rng.choice(["Zwerk", "gnuffig", "zwerker", "PLOX!"]))
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, int(bad), "extra"))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_grams_are_those_of_words():
    text, words = toxicity.plain("  Ab\tc\nÉ  ab ")
    assert text == " ab c é ab " and words == 4
    want = Counter(text[i : i + n] for n in toxicity.SIZES for i in range(len(text) - n + 1) if " " not in text[i + 1 : i + n - 1])
    keys, counts, places, lengths = toxicity.grams(text)
    assert len(set(keys.tolist())) == len(keys)
    assert {text[p : p + n]: c for p, n, c in zip(places, lengths, counts, strict=True)} == want
    assert toxicity.plain(None) == ("", 0) and len(toxicity.grams("")[0]) == 0


def test_weights_are_ratios_times_coefficients(spark):
    rows, labels = toxic_docs(400, 3)
    model = toxicity.train(docs(spark, rows), label_table(spark, labels))
    taught = [(r, la) for r, la in zip(rows, labels, strict=True) if zlib.crc32(str(r[0]).encode()) % 5]
    sets = [({t[i : i + n] for t in [toxicity.plain(r[1])[0]] for n in toxicity.SIZES for i in range(len(t) - n + 1) if " " not in t[i + 1 : i + n - 1]}, la[2]) for r, la in taught]
    n1 = sum(y for _, y in sets)
    toxic, clean = Counter(g for s, y in sets if y for g in s), Counter(g for s, y in sets if not y for g in s)
    share, names = n1 / len(sets), []
    for g in toxic | clean:
        every = toxic[g] + clean[g]
        if every >= 5 and abs(toxic[g] - every * share) / math.sqrt(every * share * (1 - share)) >= 4:
            names.append(g)
    assert sorted(model.weights) == sorted(names)
    ratio = {g: math.log((toxic[g] + 1) / (n1 + 2)) - math.log((clean[g] + 1) / (len(sets) - n1 + 2)) for g in names}
    for g, w in model.weights.items():
        assert w == 0 or (w > 0) == (ratio[g] > 0) or abs(w) < abs(ratio[g])
    for text in (rows[0][1], "", None, "zwerk " * 3):  # the automaton's score is the plain sum
        flat, words = toxicity.plain(text)
        total = model.bias
        for g, w in model.weights.items():
            n = sum(flat.startswith(g, k) for k in range(len(flat)))
            total += w * 3 * math.log1p(n) / math.log1p(words) if words else 0
        assert model.score(text, model.automaton()) == pytest.approx(1 / (1 + math.exp(-total)))


def test_held_out_toxicity(spark):
    rows, labels = toxic_docs(1500, 5)
    got = toxicity.score_documents(docs(spark, rows), label_table(spark, labels)).collect()
    assert len(got) == 1500
    mark = {la[0]: la[2] for la in labels}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], mark[r["doc_id"]]) for r in got if r["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held)


def test_held_out_labels_teach_nothing(spark):
    rows, labels = toxic_docs(300, 6)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, q, t, x in labels]
    one, two = (toxicity.train(docs(spark, rows), label_table(spark, x)) for x in (labels, turned))
    assert one == two


def test_toxicity_of_odd_inputs(spark):
    rows, labels = toxic_docs(200, 7)
    odd = [(None, "zwerk", None, None, None), (1000, None, "en", "a", None), (1001, "", "en", "a", 0), (1002, " \n", "en", "a", 2), (1003, "zwerk " * 50_000, "en", "a", 1), (5, "again", "en", "a", 1), (5, "again", "en", "a", 1)]
    more = [(None, 1, 1, "x"), (1001, None, None, "x"), (5, 0, 1, "x"), (5, 1, 0, "x"), (99_999, 1, 1, "no document")]
    got = {}
    for r in toxicity.score_documents(docs(spark, rows + odd), label_table(spark, labels + more)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1000][0]["score"] == got[1001][0]["score"] == got[1002][0]["score"] < 0.5 < got[1003][0]["score"]
    assert not got[None][0]["held_out"] and len(got[5]) == 3
    assert toxicity.score_documents(docs(spark, []), label_table(spark, labels)).count() == 0
    for none in ([], [(i, 1, 0, "x") for i in range(50)]):
        scores = {r["score"] for r in toxicity.score_documents(docs(spark, rows), label_table(spark, none)).collect()}
        assert len(scores) == 1
