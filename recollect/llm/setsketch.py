"""Near-duplicate documents by SetSketch registers: band, estimate by likelihood, verify."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, materialize, small_batches, small_side, utf8_words
from recollect.llm.components import connected_components


@dataclass(frozen=True)
class Params:
    """Similarity is num / den; the first bands * rows of the registers are banded.

    A pair at 0.85 misses all 20 bands of 4 registers with probability 4e-7; registers are
    floor(1 - log_base(least hash)) cut to 16 bits, so they nearly never agree by chance.
    """

    words: int = 3
    num: int = 85
    den: int = 100
    bands: int = 20
    rows: int = 4  # at most 4, for a band's registers are one number of 64 bits
    registers: int = 128  # a power of two up to 4096
    base: float = 1.0005
    rate: float = 20.0
    drop: float = 9.0  # log-likelihood that a pair may lie below its best to be verified
    block: int = 512  # rows of either side of a tile


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _odd(256, 23)  # a number for every byte
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))  # the inverse modulo 2**64


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return out.cumprod(dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word of lower-cased UTF-8 bytes.

    A word's hash is its polynomial in _STEP modulo 2**64: differences of running sums, shifted
    to the word's start by _STEP's inverse, and mixed.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    bits = max(18, len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(int(_STEP), bits)[: len(raw)], dtype=np.uint64, out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(int(_BACK), bits)[start]
    return start, mix64(h + (end - start).astype(np.uint64))


def shingle_words(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The set itself: distinct runs of k words, or all words as one run where there are fewer."""
    words = [w.lower() for w in utf8_words(text)]
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def shingle_hashes(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's set."""
    coded = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    first = np.cumsum([0] + [len(c) + 1 for c in coded])
    start, h = word_hashes(b"\n".join(coded))
    cut = np.searchsorted(start, first)
    odd = _odd(k + 1, 11)
    runs = np.full(max(0, len(h) - k + 1), odd[k] * np.uint64(k), np.uint64)
    for i in range(k):
        runs += h[i : len(runs) + i] * odd[i]
    runs = mix64(runs)
    out = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi - lo >= k:
            x = np.sort(runs[lo : hi - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif hi > lo:
            out.append(mix64(odd[k] * np.uint64(hi - lo) + (h[lo:hi] * odd[: hi - lo]).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """SetSketch of several non-empty sets at once: (sets, registers) of 16 bits.

    Each element's hash drives a Poisson process that hits random registers; a register's value is its
    first hit by any element, so it is exponential with the set's size, and register i of two sets
    agrees if the same element came first. A set's processes run on in rounds of equal time until
    every register of it is hit; elements wait with their next hit.
    The register is floor(1 - log_base(value)), cut to 16 bits.
    """
    m = p.registers
    sizes = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    first = np.full((len(sets), m), np.inf)
    flat = first.ravel()

    def next_hits(h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = h + _STEP
        x = mix64(h)
        return h, x, t - np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / (p.rate * m)

    h, x, t = next_hits(h, np.zeros(len(h)))
    until = (np.log(m) + 1.0) / (sizes * p.rate)
    while len(h):
        due = np.flatnonzero(t <= until[owner])
        now = h[due], x[due], t[due], owner[due], due
        while len(now[0]):
            hh, xx, tt, oo, at = now
            np.minimum.at(flat, oo * m + ((xx & np.uint64(4095)).astype(np.int64) * m >> 12), tt)
            hh, xx, tt = next_hits(hh, tt)
            h[at], x[at], t[at] = hh, xx, tt
            live = tt <= until[oo]
            now = hh[live], xx[live], tt[live], oo[live], at[live]
        open_ = np.isinf(first).any(axis=1)
        stay = open_[owner]
        h, x, t, owner = h[stay], x[stay], t[stay], owner[stay]
        until += 2.0 / (sizes * p.rate)
    return np.clip(np.floor(1 - np.log(np.minimum(first, 1e9)) / np.log(p.base)), 0, 65535).astype("<u2")


def _fill(rows: list[tuple[list, np.ndarray]], p: Params) -> None:
    """Put the registers of each set into the last place of its row."""
    if rows:
        for (row, _), regs in zip(rows, registers([x for _, x in rows], p), strict=True):
            row[2] = regs.tobytes()


def chunks(texts: list[str | None], most: int = 1 << 18) -> Iterator[list[str | None]]:
    """Runs of texts of about `most` characters, one text at least."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t or "") > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t or "")
    if run:
        yield run


def _sketcher(p: Params):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, full, held = [], [], 0
            for texts in chunks(batch["text"].tolist()):
                for x in shingle_hashes(texts, p.words):
                    rows.append([len(x), blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None, None])
                    if len(x):
                        full.append((rows[-1], x))
                        held += len(x)
                if held > 400_000:  # bounds the hashes in memory
                    _fill(full, p)
                    full, held = [], 0
            _fill(full, p)
            out = pd.DataFrame(rows, columns=["n", "digest", "regs"])
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())[["doc_id", "n", "digest", "regs"]]

    return sketch


def joint_estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Params) -> np.ndarray:
    """Log-likelihood of similarity num/den less that of the likeliest one, for pairs of sketches.

    With the sizes known, a register of A is above, below or level with B's with probabilities
    q(u - v j), q(v - u j) and the rest, where q(x) = -log_base(1 - x (base - 1) / base), j is
    the similarity and u, v are the sets' shares of the sizes' sum. For bases near 1, q(x) is x
    and the likeliest j solves m u v j^2 - (level (u^2 + v^2) + up v^2 + down u^2) j + level u v = 0.
    """
    up, down = (ka > kb).sum(axis=1), (ka < kb).sum(axis=1)
    m = ka.shape[1]
    level = m - up - down
    u = na / (na + nb)
    v = 1 - u

    def q(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (p.base - 1) / p.base) / np.log(p.base), 1e-9, 1)

    def like(j: np.ndarray | float) -> np.ndarray:
        jj = np.minimum(j, np.minimum(u / v, v / u))
        a, b = q(u - v * jj), q(v - u * jj)
        return up * np.log(a) + down * np.log(b) + level * np.log(np.maximum(1 - a - b, 1e-9))

    half = level * (u**2 + v**2) + up * v**2 + down * u**2
    best = (half - np.sqrt(np.maximum(half**2 - 4 * m * level * (u * v) ** 2, 0))) / (2 * m * u * v)
    return like(p.num / p.den) - like(best)


def _regs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(len(column), -1)


def _scorer(p: Params):
    @F.pandas_udf("double")  # made when a session is up
    def score(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        """Share of equal registers if the pair may reach the threshold, else -1."""
        ka, kb = _regs(ra), _regs(rb)
        fit = joint_estimate(ka, kb, na.to_numpy(float), nb.to_numpy(float), p)
        same = (ka == kb).mean(axis=1)
        return pd.Series(np.where((fit >= -p.drop) | (same >= p.num / p.den), same, -1.0))

    # A filter on the score would be pushed below its column and call it once more, in Python workers of its own.
    return score.asNondeterministic()


def _far(ka: np.ndarray, kb: np.ndarray, p: Params) -> np.ndarray:
    """Pairs that agree in fewer registers than a link would, by five standard errors."""
    m, j = ka.shape[1], p.num / p.den
    return (ka == kb).sum(axis=1) < m * j - 5 * np.sqrt(m * j * (1 - j))


def _tile_pairs(g: pd.DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of a tile, from different components, that may be links, each pair in
    the first band where it meets only. g holds whole tiles, in order of TILE's first columns.

    i is in the tile's block of members outside the bucket's main component, j in its block of
    all; of two such members the lesser one is i, so that each pair has one tile.
    """
    rep, comp, n, minor = g["rep"].to_numpy(), g["comp"].to_numpy(), g["n"].to_numpy(float), g["minor"].to_numpy()
    regs, band = _regs(g["regs"]), g["band"].to_numpy()
    shift = np.arange(p.rows, dtype=np.uint64) * np.uint64(16)
    keys = (regs[:, : p.bands * p.rows].reshape(len(g), p.bands, p.rows).astype(np.uint64) << shift).sum(axis=2, dtype=np.uint64)
    tile = g[["key", "tx", "ty"]].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1, [len(g)]])
    sizes = np.diff(starts)
    first, size = np.repeat(starts[:-1], sizes), np.repeat(sizes, sizes)
    left = np.flatnonzero(minor & (g["bx"] == g["tx"]).to_numpy())
    right = (g["by"] == g["ty"]).to_numpy()
    found = [(np.zeros(0, int), np.zeros(0, int))]
    upto = np.cumsum(size[left])
    for lo, hi in _cuts(upto, 1 << 18):
        rows = left[lo:hi]
        a = np.repeat(rows, size[rows])
        b = np.arange(len(a)) + np.repeat(first[rows] - (upto[lo:hi] - size[rows] - (upto[lo - 1] if lo else 0)), size[rows])
        ok = right[b] & (comp[a] != comp[b]) & ((rep[a] < rep[b]) | ~minor[b])
        ok &= p.den * np.minimum(n[a], n[b]) >= p.num * np.maximum(n[a], n[b])
        a, b = a[ok], b[ok]
        met = (keys[a] == keys[b]) & (np.arange(p.bands) < band[a][:, None])
        ok = ~met.any(axis=1)
        a, b = a[ok], b[ok]
        for part in (slice(-32, None), slice(-128, None)):  # a few registers tell most pairs
            ok = ~_far(regs[a, part], regs[b, part], p)
            a, b = a[ok], b[ok]
        for s in range(0, len(a), 8192):
            x, y = a[s : s + 8192], b[s : s + 8192]
            fit = joint_estimate(regs[x], regs[y], n[x], n[y], p) >= -p.drop
            found.append((x[fit], y[fit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cuts(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of rows whose counts, of running sum `upto`, add up to about `most`."""
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


TILE = ["key", "tx", "ty", "rep", "band", "bx", "by", "minor", "comp", "n", "regs"]


def _flagger(p: Params):
    """The members of some tiles that may have a link there: at most their rows, never their pairs."""

    def flag(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TILE[:4], ignore_index=True)
        a, b = _tile_pairs(g, p)
        return g.loc[np.union1d(a, b), TILE]

    return flag


def _linker(p: Params):
    """The links of some tiles' flagged members by their full sets, as a forest: pairs that are
    connected already are not compared again."""

    def link(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(TILE[:4], ignore_index=True)
        rep, at = np.unique(g["rep"], return_inverse=True)
        words = g["text"].to_numpy()[np.unique(at, return_index=True)[1]]
        sets = [x for texts in chunks(words.tolist()) for x in shingle_hashes(texts, p.words)]
        up, out = list(range(len(rep))), []

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, j in zip(*(at[x].tolist() for x in _tile_pairs(g, p)), strict=True):
            x, y = root(i), root(j)
            if x == y:
                continue
            every = len(sets[i]) + len(sets[j])
            both = every - len(np.union1d(sets[i], sets[j]))
            if p.den * both < p.num * (every - both):
                continue
            a, b = (shingle_words(words[k], p.words) for k in (i, j))  # hashes agree; do the words?
            if p.den * len(a & b) >= p.num * len(a | b):
                up[max(x, y)] = min(x, y)
                out.append((rep[i], rep[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return link


def _checker(p: Params):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str | None, set] = (None, set())
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["ta"], batch["tb"], strict=True):
                if ta is not last[0]:
                    last = (ta, shingle_words(ta, p.words))
                sa, sb = last[1], shingle_words(tb, p.words)
                both = len(sa & sb)
                keep.append(p.den * both >= p.num * (len(sa) + len(sb) - both) and both > 0)
            yield batch.loc[keep, ["a", "b"]]

    return check


def _verified(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Those of pairs (a, b) of ids that are links, by the full sets of their texts."""
    needed = materialize(
        pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "sketch-needed"
    )
    texts = docs.select("doc_id", "text").join(small_side(needed), "doc_id", "left_semi")
    texts = materialize(texts, "sketch-texts")
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
    links = materialize(joined.mapInPandas(_checker(p), "a long, b long"), "sketch-links")
    discard(needed, texts)
    return links


def _extended(
    links: DataFrame, components: DataFrame, pairs: DataFrame, docs: DataFrame, p: Params
) -> tuple[DataFrame, DataFrame]:
    """Links and components with those of pairs that are links; nothing is computed anew where none is."""
    if not pairs.limit(1).count():
        return links, components
    more = _verified(pairs, docs, p)
    if not more.limit(1).count():
        return links, components
    links = links.union(more)
    return links, materialize(connected_components(links), "sketch-components")


def _with_component(rows: DataFrame, node: str, components: DataFrame, name: str) -> DataFrame:
    found = components.select(F.col("id").alias(node), F.col("component").alias(f"_{name}"))
    return rows.join(found, node, "left").withColumn(name, F.coalesce(f"_{name}", node)).drop(f"_{name}")


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are lower-cased in A-Z; a document's set is its distinct runs of `words` words (all
    words as one run where there are fewer). Documents are linked if den * intersection >=
    num * union of their sets; components are of these links.

    1. Every document is sketched where it is read. Documents of equal sets are one class, of
       the least id, so exact copies never meet pairwise.
    2. Classes meet in buckets of equal bands. In each bucket every class is paired with
       the one that meets most others, never all with all; estimates that can't be links go.
    3. The best pair of each class is verified on the full sets, then the other pairs that
       join different components.
    4. In buckets that still hold several components, members outside the main one are compared
       with all in tiles of bounded size: by registers first, which flags members, then the
       flagged ones by their full sets. Only a forest of the links found leaves a tile, never its pairs.

    Null ids are linked with nothing (component null, kept); null, empty and wordless texts have
    no shingles and are linked with nothing; rows that repeat an id count as one document;
    an empty table gives an empty result.
    """
    p = params or Params()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = small_batches(docs).mapInPandas(_sketcher(p), "doc_id long, n long, digest binary, regs binary")
    sketches = materialize(sketches, "sketch")
    known = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    reps = materialize(reps, "sketch-classes")

    width = 2 * p.rows
    keys = [F.xxhash64(F.lit(i), F.substring("regs", 1 + width * i, width)) for i in range(p.bands)]
    bands = reps.select("rep", F.posexplode(F.array(*keys)).alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = members = materialize(bands.join(sizes, "key"), "sketch-buckets")
    # Original texts share more bands with their copies than the copies with each other.
    degrees = members.groupBy("rep").agg(F.sum("c").alias("degree"))
    members = members.join(degrees, "rep")
    pivots = members.groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("pivot"))
    members = materialize(members.join(pivots, "key"), "sketch-members")
    discard(buckets)

    side = reps.select("rep", "n", "regs")
    sa = side.withColumnsRenamed({"rep": "a", "n": "na", "regs": "ra"})
    sb = side.withColumnsRenamed({"rep": "b", "n": "nb", "regs": "rb"})
    pair = (F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
    stars = members.where("rep <> pivot").select(*pair, "rep").distinct()
    stars = stars.join(sa, "a").join(sb, "b")
    stars = stars.where(f"{p.den} * least(na, nb) >= {p.num} * greatest(na, nb)")
    stars = stars.select("a", "b", "rep", _scorer(p)("ra", "rb", "na", "nb").alias("same")).where("same >= 0")
    stars = materialize(stars, "sketch-stars")

    best = stars.groupBy("rep").agg(F.max(F.struct("same", -F.col("a"), -F.col("b"))).alias("_p"))
    best = materialize(best.select((-F.col("_p")["col2"]).alias("a"), (-F.col("_p")["col3"]).alias("b")).distinct(), "sketch-best")
    links = _verified(best, docs, p)
    components = materialize(connected_components(links), "sketch-components")
    rest = _with_component(_with_component(stars, "a", components, "ca"), "b", components, "cb")
    rest = rest.where("ca <> cb").select("a", "b").distinct().join(best, ["a", "b"], "left_anti")
    rest = materialize(rest, "sketch-rest")
    links, components = _extended(links, components, rest, docs, p)

    placed = materialize(_with_component(members, "rep", components, "comp"), "sketch-placed")
    discard(members, stars, best, rest)
    shares = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = shares.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("c"), F.max("m").alias("m"))
    px, py = F.ceil((F.col("c") - F.col("m")) / p.block).cast("int"), F.ceil(F.col("c") / p.block).cast("int")
    main = materialize(main.where("m < c").select("key", "main", px.alias("px"), py.alias("py"), "c", "m"), "sketch-main")
    rows = main.agg(F.sum((F.col("c") - F.col("m")) * F.col("py") + F.col("m") * F.col("px"))).first()[0] or 0
    tiles = placed.select("key", "band", "rep", "comp").join(main, "key").join(side, "rep")
    tiles = tiles.withColumns({
        "minor": F.col("comp") != F.col("main"),
        "bx": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("px")).cast("int"),
        "by": F.pmod(F.xxhash64("rep", F.lit(2)), F.col("py")).cast("int"),
    })
    spot = lambda x, y: F.struct(x.alias("tx"), y.alias("ty"))
    among_all = F.transform(F.sequence(F.lit(0), F.col("px") - 1), lambda x: spot(x, F.col("by")))
    as_minor = F.transform(F.sequence(F.lit(0), F.col("py") - 1), lambda y: spot(F.col("bx"), y))
    spots = F.when(F.col("minor"), F.array_union(among_all, as_minor)).otherwise(among_all)
    tiles = tiles.withColumn("_t", F.explode(spots)).select("*", "_t.tx", "_t.ty").select(*TILE)
    schema = ", ".join(f"{x} {tiles.schema[x].dataType.simpleString()}" for x in TILE)
    # Most tiles hold a few rows: they are dealt to tasks many at a time.
    deal = F.pmod(F.xxhash64("key", "tx", "ty"), F.lit(max(16, rows // 8192)))
    flagged = materialize(tiles.groupBy(deal).applyInPandas(_flagger(p), schema), "sketch-flagged")
    if flagged.limit(1).count():
        needed = materialize(flagged.select(F.col("rep").alias("doc_id")).distinct(), "sketch-needed")
        texts = docs.join(small_side(needed), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.min("text").alias("text"))
        texted = flagged.join(texts, "rep")
        more = materialize(texted.groupBy(deal).applyInPandas(_linker(p), "a long, b long"), "sketch-across")
        if more.limit(1).count():
            components = materialize(connected_components(links.union(more)), "sketch-components")
        discard(needed, more)
    discard(placed, main, flagged)

    classes = _with_component(reps.select("digest", "rep"), "rep", components, "comp").select("digest", "comp")
    out = sketches.select("doc_id", "n", "digest").join(classes, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
