"""Operators that place or weigh documents: packing, sharding, mixing, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import mixing, packing, sharding, stages
from recollect.llm.setsketch import Params

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, taken long, ord int, weight int, length long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 7, 7, 7, 7, 7, 7) for i, t, la, s in rows], DOCS)


def many(n, seed=1):
    rng = random.Random(seed)
    return [
        (i, " ".join(rng.choices(["alpha", "beta", "gamma's", "Delta!", "épsilon", "7"], k=int(rng.expovariate(1 / 120)))), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]))
        for i in range(n)
    ]


ODD = [(1000, None, None, None), (1001, "", "en", "a"), (1002, "w " * 9000, "en", "é"), (None, "no id", "en", "b"), (5, "again", "en", "a"), (5, "again", "en", "a")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


HARD = [
    "don't IT'S, x<|endoftext|>y <|ENDOFTEXT|> É!!! ΣΑΣ! 12,3 áb é, …. a… \x1c b\x1cc ﬁ'll you're! _foo_ a_ İ. ẞ? x​ ªº ŉ ǅ ſ",
    "日本語 テスト。 한국어! 'tis ''s x's's. a'. İstanbul été �",
]


@pytest.mark.parametrize("text", HARD + [t for _, t, _, _ in many(20)])
def test_word_ids_are_the_tokenizers(tokenizer, text):
    words = packing.WordIds(packing.default_tokenizer())
    assert np.frombuffer(words.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_are_parted_and_tokenized_together(tokenizer):
    """Marks and capitals make no words of their own, new words of letters go to the tokenizer in one call, and ids stay the tokenizer's."""
    rng = random.Random(9)
    words = packing.WordIds(packing.default_tokenizer())
    alone = []
    words.model = type("Model", (), {"tokenize": lambda self, w, real=words.model: alone.append(w) or real.tokenize(w)})()
    list(words.of_all(["Lantern lantern, LANTERN; (lantern) été. Été!"]))
    assert {"lantern", "été"} <= {w.decode() for w in words} and len(words) == 8 and alone == []
    bits = ["a", "Ab", "é", "É", "ß", "ÿ", "µ", "ª", "×", "÷", "1", "²", "½", "'s", "'", "’", ".", ",,", "_", "<", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "e\u0301", "\u0338", "=", "\xad", "\xa0", "\x85", "\u0130", "Σ", "中", " ", " ", "\n", "\x1c"]
    texts = ["".join(rng.choices(bits[: rng.choice([12, 24, len(bits)])] + [" "], k=rng.randint(1, 25))) for _ in range(3000)] + [None, "", "Long-" * 100_000]
    for text, ids in zip(texts, words.of_all(texts, size=500), strict=True):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes(), text
    assert words.of(texts[0]) == np.array(tokenizer.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()


def check_packed(rows, got, tokenizer):
    want = Counter()
    for i, t, _, _ in rows:
        want[(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]))] += 1
    ids = {}
    for i, seq in want:
        ids.setdefault(i, []).append(seq)
    for r in got:
        seq = next(s for s in ids[r["doc_id"]] if len(s) == r["doc_tokens"])
        piece = np.array(seq[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(piece) == r["ids_crc32"]
    assert sum(r["length"] for r in got) == sum(len(s) * n for (_, s), n in want.items())
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    return len(by_seq)


def test_packing(spark, tokenizer):
    rows = many(300) + ODD
    got = packing.pack(docs(spark, rows)).collect()
    n = check_packed(rows, got, tokenizer)
    assert n <= sum(r["length"] for r in got) / packing.WINDOW * 1.03 + 2
    assert packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_up(seed):
    rng = random.Random(seed)
    units = 32
    histogram = {k: rng.choice([0, 1, 5, 300]) for k in range(1, units + 1)}
    plan = packing.packing_plan(histogram, units)
    used = Counter()
    for pattern, times in plan:
        assert sum(k * m for k, m in pattern.items()) <= units
        for k, m in pattern.items():
            used[k] += m * times
    assert used == Counter({k: v for k, v in histogram.items() if v})


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(10):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_hilbert_is_a_walk():
    bits = 3
    axes = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    index = sharding.hilbert_index(axes, bits)
    assert sorted(index) == list(range(512))
    walk = axes[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve touch


@pytest.mark.parametrize("n", [0, 1, 39, 400])
def test_shards(spark, n):
    rows = many(n) + (ODD if n == 400 else [])
    got = sharding.hilbert_shards(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    sizes = Counter(r["shard"] for r in got)
    counts = [sizes.get(s, 0) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in got)


def test_shards_prune(spark):
    """A filter on any of the curve's dimensions touches far fewer shards than in the order of a hash."""
    rng = random.Random(6)
    langs, sources = ["en", "fr", "de", "es"], [f"s{i}" for i in range(12)]
    rows = [(i, "w" * rng.randint(1, 4000), rng.choice(langs), rng.choice(sources)) for i in range(4000)]
    got = {r["doc_id"]: r for r in sharding.hilbert_shards(docs(spark, rows)).collect()}
    by_hash = {i: zlib.crc32(str(i).encode()) % 40 for i, _, _, _ in rows}
    for keep in (lambda r: r[2] == "fr" and r[3] == "s3", lambda r: r[3] == "s5" and len(r[1]) > 3000, lambda r: r[2] == "de" and len(r[1]) < 500):
        chosen = [r[0] for r in rows if keep(r)]
        assert len({got[i]["shard"] for i in chosen}) * 2 <= len({by_hash[i] for i in chosen})


def test_shards_follow_a_brute_order(spark):
    """Every row's cell, its place on the curve and the cut into runs, worked out row by row."""
    rows = many(300) + ODD
    df = docs(spark, rows)
    cells = df.select("doc_id", "text", sharding._category("lang").alias("a"), sharding._category("source").alias("b")).collect()
    sizes = sorted(len((r["text"] or "").encode()) + 16 for r in cells)
    n = len(sizes)
    cuts = sorted({sizes[max(0, -(-n * i // 64) - 1)] for i in range(1, 64)})
    walk = np.stack(np.meshgrid(*[np.arange(64)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = dict(zip(map(tuple, walk.tolist()), sharding.hilbert_index(walk, 6).tolist(), strict=True))
    want = []
    for r in cells:
        data = (r["text"] or "").encode()
        size = len(data) + 16
        curve = place[(r["a"], r["b"], sum(size > c for c in cuts))]
        want.append((curve, zlib.crc32(data), -1 if r["doc_id"] is None else r["doc_id"], size))
    want.sort()
    got = sorted(sharding.hilbert_shards(df).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [(r["curve"], r["text_crc32"], -1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in got] == want
    assert [r["shard"] for r in got] == [i * 40 // n for i in range(n)]


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        got = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    rows = many(300) + ODD
    got = mixing.mix(docs(spark, rows)).collect()
    n = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += n(t)
    targets = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n(t)) for i, t, _, _ in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.01 * t + 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows).repartition(3)).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, "", "en", "a"), (2, None, None, None)])).agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("blocks", [1, 7, 50])
def test_sainte_lague(spark, blocks):
    targets = [(1, 100.0), (2, 53.0), (3, 7.0), (4, 1.0), (5, 0.0)]
    seats = Counter()
    for _ in range(blocks):
        best = max((t / (2 * seats[o] + 1), -o) for o, t in targets if t)
        seats[-best[1]] += 1
    got = mixing.sainte_lague(spark.createDataFrame(targets, "ord int, target double"), blocks).collect()
    assert {r["ord"]: r["quota"] for r in got} == dict(seats)
    shards = mixing.sainte_lague(spark.createDataFrame(targets, "ord int, target double"), blocks, shards=5)
    assert shards.agg(F.sum("quota")).first()[0] == blocks


def test_mix_deals_quotas_to_shards(spark):
    """A document's shard is the one whose quota holds the stream's block with its first word."""
    rows = many(300)
    got = mixing.mix(docs(spark, rows), blocks=60, shards=5).collect()
    block = got[0]["block_words"]
    targets = sorted({(r["source"] is None, r["source"] or "", r["target"]) for r in got})
    seats, order = Counter(), []
    for _ in range(round(sum(t for _, _, t in targets) / block)):
        best = max((t / (2 * seats[i] + 1), -i) for i, (_, _, t) in enumerate(targets) if t)
        seats[-best[1]] += 1
        order.append(-best[1])
    for i, (null, name, _) in enumerate(targets):
        mine = [r for r in got if (r["source"] is None, r["source"] or "") == (null, name)]
        dealt = [n * 5 // len(order) for n, o in enumerate(order) if o == i]
        assert all(r["quota"] == len(dealt) for r in mine)
        at = 0
        for r in sorted(mine, key=lambda r: (hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest(), r["size"])):
            assert r["shard"] == (dealt[min(at // block, len(dealt) - 1)] if r["taken"] else None)
            at += r["size"]


def test_mix_keeps_small_sources(spark):
    """Blocks of all the words by 64 would be over twice the targets of small sources."""
    rows = [(i, "w " * 500, "en", "big") for i in range(60)] + [(100, "x " * 30, "en", "small"), (101, "y " * 150, "en", None), (102, "z", "en", "tiny")]
    got = mixing.mix(docs(spark, rows), blocks=64).collect()
    targets, taken = {r["source"]: r["target"] for r in got}, Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert taken[s] > 0 and abs(taken[s] - t) <= 0.01 * t + 1
    kept = {r["source"] for r in stages.repeat_by_mix(docs(spark, rows), blocks=64).collect()}
    assert kept == {"big", "small", None, "tiny"}


def test_sainte_lague_lists_no_sure_seats(spark):
    rng = random.Random(5)
    targets = [(i, float(rng.choice([1, 3, 50, 400, 400]))) for i in range(12)]
    seats, order = Counter(), []
    for _ in range(300):
        best = max((t / (2 * seats[o] + 1), -o) for o, t in targets)
        seats[-best[1]] += 1
        order.append(-best[1])
    got = mixing.sainte_lague(spark.createDataFrame(targets, "ord int, target double"), 300, shards=7).collect()
    assert {(r["ord"], r["shard"]): r["quota"] for r in got} == Counter((o, i * 7 // 300) for i, o in enumerate(order))
    large = mixing.sainte_lague(spark.createDataFrame([(1, 7e9), (2, 3.0)], "ord int, target double"), 7_000_000_003).collect()
    assert {r["ord"]: r["quota"] for r in large} == {1: 7_000_000_000, 2: 3}


def test_mixing_stage_writes_the_mix(spark):
    rows = many(120) + ODD
    df = docs(spark, rows)
    out = stages.repeat_by_mix(df)
    assert out.columns == df.columns
    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(df.where("doc_id <> 5")).collect()}
    words = Counter()
    for r in stages.repeat_by_mix(df.where("doc_id <> 5")).collect():
        words[r["doc_id"]] += len((r["text"] or "").encode().split())
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({i: n for (i, _), n in taken.items() if n})


@pytest.mark.parametrize("seed", [7, 8, 9, 10])
def test_mixing_stage_with_ties_and_clashing_names(spark, seed):
    """Rows that repeat id and size where a source's last word lies, and columns named as helpers."""
    rows = [(None, f"w{i} " * 7, "en", "a") for i in range(50)] + [(3, "same text here", "en", "b")] * 40 + [(i, f"v{i} v", "en", "c") for i in range(30)]
    df = docs(spark, rows).withColumns({n: F.lit(5) for n in ("_helper", "_k", "_take", "_pos", "_mid", "_part", "rank", "last", "_row", "_id")})
    out = stages.repeat_by_mix(df, seed=seed, weights=(1, 2, 1))
    assert out.columns == df.columns
    want, got = Counter(), Counter()
    for r in mixing.mix(df, seed=seed, weights=(1, 2, 1)).collect():
        want[(r["doc_id"], r["source"])] += r["taken"]
    for r in out.collect():
        got[(r["doc_id"], r["source"])] += len(r["text"].split())
        assert (r["_helper"], r["_pos"], r["rank"]) == (5, 5, 5) and r["n_chars"] in (len(r["text"]), len(r["text"]) + 1)
    assert got == Counter({k: v for k, v in want.items() if v})
    texts = Counter(r["text"] for r in stages.repeat_by_mix(df.where("source = 'a'"), seed=seed).collect())
    assert max(texts.values()) <= 2


def test_near_duplicate_stage(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = docs(spark, [(4, text, "en", "a"), (2, text.upper(), "en", "a"), (9, text + " more", "en", "b"), (None, text, "en", "b"), (7, None, None, None)])
    out = stages.drop_near_duplicates(df, Params(words=5, num=8, den=10, bands=26))
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "7", "None"]


def test_pipeline(spark, tmp_path, tokenizer):
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"v{j}" for j in range(200)], k=60)), "en", rng.choice(["a", "b"])) for i in range(60)]
    rows += [(100, rows[0][1], "en", "a"), (101, "token: abcdefgh1234 " + rows[1][1][:40], "en", "b"), (102, None, None, None)]
    folder = str(tmp_path)
    df = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    d = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, folder)
        assert d.columns == df.columns
    assert d.where("doc_id = 100").count() == 0 and d.where("text LIKE '%abcdefgh1234%'").count() == 0
    packed = corpus_pipeline.run(spark, folder)
    kept = [(r["doc_id"], r["text"], None, None) for r in d.collect()]
    check_packed(kept, packed.collect(), tokenizer)
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0
