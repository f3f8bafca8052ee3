"""Merkle manifest of a dataset: roots by butterfly exchange, and a proof for every row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, materialize, small_batches, small_side, with_position

FANOUT = 16
#: Levels of a block, the aligned run of FANOUT ** DEPTH leaves that one row holds.
DEPTH = 3
_PATH = "array<struct<place:int,run:array<string>>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(text: Column) -> Column:
    """A document's leaf, with `text` in place of its text: each field as its UTF-8 bytes' count, `:` and value, or `-` if null."""
    fields = [F.col(n).cast("string") for n in ("doc_id", "source", "lang", "n_chars")] + [text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levels_of(leaves: int) -> int:
    """Levels of hashes above so many leaves; a lone leaf is its own root."""
    out = 0
    while leaves > 1:
        leaves, out = -(-leaves // FANOUT), out + 1
    return out


def rise(nodes: list[str], levels: int) -> list[list[list[str]]]:
    """The runs of each level, from the leaves up; the last entry is the one run of the top node."""
    out = []
    for _ in range(levels):
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        out.append(runs)
        nodes = [digest(*r) for r in runs]
    return [*out, [nodes]]


def path_of(at: int, runs: list[list[list[str]]]) -> list[tuple[int, list[str]]]:
    """(place in its run, the run) of leaf `at` and of its ancestors below the top."""
    out = []
    for level in runs[:-1]:
        out.append((at % FANOUT, level[at // FANOUT]))
        at //= FANOUT
    return out


def siblings(path: list[tuple[int, list[str]]]) -> str:
    return "".join(h for at, run in path for k, h in enumerate(run) if k != at)


def folded(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, run in path:
        node = digest(*run[:at], node, *run[at + 1 :])
    return node


def block_roots(blocks: DataFrame, depth: int) -> DataFrame:
    """(tree, block, n, node): the root of each block of a tree of n leaves."""

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [rise(list(x), min(depth, levels_of(n)))[-1][0][0] for x, n in zip(batch["leaves"], batch["n"], strict=True)]
            yield pd.DataFrame({"tree": batch["tree"], "block": batch["block"], "n": batch["n"], "node": found})

    rows = small_batches(blocks).select("tree", "block", "n", "leaves")
    return rows.mapInPandas(roots, "tree string, block long, n long, node string")


def into_blocks(placed: DataFrame, depth: int, *more: str) -> DataFrame:
    """Rows (tree, at, n, leaf, more) as one row per block: its leaves, and columns `more`, as arrays in order."""
    held = F.sort_array(F.collect_list(F.struct("at", "leaf", *more)))
    rows = placed.groupBy("tree", F.expr(f"at div {FANOUT**depth}L").alias("block")).agg(F.max("n").alias("n"), held.alias("_held"))
    return rows.select("tree", "block", "n", F.col("_held.leaf").alias("leaves"), *[F.col(f"_held.{m}").alias(m) for m in more])


def butterfly(roots: DataFrame, depth: int) -> DataFrame:
    """(tree, block, node, path) from each block's root (tree, block, n, node): path holds, for each level above
    the block, the place of its ancestor and the run that it stands in; node becomes the tree's root.

    In round r a block knows the root of its aligned group of FANOUT ** r blocks and meets the blocks
    whose numbers differ from its own in digit r alone, so that FANOUT roots at most meet in one place; each then hashes the
    ancestor for itself. After the rounds every block has its whole upper path; nothing is handed down. Blocks of
    the last, incomplete group also stand in for the numbers that are missing there, so each meeting is whole.
    """
    size = FANOUT**depth
    count = F.expr(f"(n + {size - 1}L) div {size}L")
    state = materialize(roots.select("tree", "block", count.alias("blocks"), "node", F.array().cast(_PATH).alias("path")), "merkle-round")
    most = state.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    width = 1
    while width < most:
        of = F.expr(f"block div {width}L")
        own = F.expr(f"block % {width}L")
        here = F.least(F.lit(width).cast("long"), F.expr(f"blocks - (block div {width}L) * {width}L"))
        sent = state.where(f"blocks > {width}").withColumn("_lane", F.explode(F.sequence(own, F.lit(width - 1).cast("long"), here)))
        sent = sent.select(
            "tree", F.expr(f"block div {width * FANOUT}L").alias("_group"), "_lane", (of % FANOUT).cast("int").alias("_place"),
            "node", F.when(F.col("_lane") == own, F.struct("block", "blocks", "path")).alias("_own"),
        )
        met = sent.groupBy("tree", "_group", "_lane").agg(
            F.sort_array(F.collect_list(F.struct("_place", "node"))).alias("_met"),
            F.collect_list(F.when(F.col("_own").isNotNull(), F.struct("_place", "_own"))).alias("_homes"),
        )
        got = met.select("tree", F.col("_met.node").alias("_run"), F.explode("_homes").alias("_home"))
        step = F.struct(F.col("_home._place").alias("place"), F.col("_run").alias("run"))
        risen = got.select(
            "tree", "_home._own.block", "_home._own.blocks", F.sha2(F.array_join("_run", ""), 256).alias("node"),
            F.concat(F.col("_home._own.path"), F.array(step)).alias("path"),
        )
        old, state = state, materialize(risen.unionByName(state.where(f"blocks <= {width}")), "merkle-round")
        discard(old)
        width *= FANOUT
    return state.drop("blocks")


def _place(df: DataFrame, tree: str, order: list[Column], tag: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their place `at` in their tree and its number of leaves `n`; and the rows as written, to delete later."""
    placed, _ = with_position(df, [F.col(tree).asc_nulls_first(), *order], tag)
    first = placed.groupBy(tree).agg(F.min("_pos").alias("_first"), F.count("*").alias("n"))
    first = materialize(first.withColumnRenamed(tree, "_tree"), f"{tag}-trees")
    rows = placed.join(small_side(first), placed[tree].eqNullSafe(first["_tree"]))
    return rows.withColumn("at", F.col("_pos") - F.col("_first")).drop("_pos", "_first", "_tree"), first


def _steps(rows) -> list[tuple[int, list[str]]]:
    return [(int(r["place"]), list(r["run"])) for r in rows]


def _top_paths(depth: int):
    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaves, sources, n, upper, root in zip(*[batch[x] for x in ("leaves", "source", "n", "path", "node")], strict=True):
                runs = rise(list(leaves), min(depth, levels_of(n)))
                found = [path_of(k, runs) + _steps(upper) for k in range(len(leaves))]
                yield pd.DataFrame({
                    "source": sources, "subroot": leaves, "root": root,
                    "top": [[{"place": at, "run": run} for at, run in p] for p in found],
                })

    return paths


def _proofs(depth: int):
    def proofs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["leaves", "doc_id", "tampered", "n", "path", "node", "top", "root"]
        for batch in batches:
            for leaves, ids, tampered, n, path, subroot, top, root in zip(*[batch[x] for x in names], strict=True):
                runs = rise(list(leaves), min(depth, levels_of(n)))
                above = _steps(path) + _steps(top)
                tail, hashes, folds = siblings(above), [], []
                for k, changed in enumerate(tampered):
                    below = path_of(k, runs)
                    hashes.append(digest(siblings(below), tail))
                    folds.append(folded(changed or leaves[k], below + above))
                yield pd.DataFrame({
                    "doc_id": ids, "leaf": leaves, "subroot": subroot, "root": root,
                    "proof_sha256": hashes, "folded_root": folds, "verified": [f == root for f in folds],
                })

    return proofs


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per row of docs its leaf, its source's subroot, the root, the hash of its proof, and what a check against tampering finds.

    Rows are sorted once by (source, doc_id, leaf) in range partitions; each aligned run of 16 ** depth leaves becomes one row
    (4,096 and about 0.7 MB), so that a source of any size is spread over tasks, and `butterfly` gives each such block the path above it.
    Subroots are the leaves of one more tree, treated alike. A null in any field is hashed as `-`; an empty text as
    `0:`; rows of a null source are a source, which comes first; a null id comes first in its source and is not tampered
    with; rows that repeat an id stand side by side, ordered by leaf, each with its own proof; equal rows have places of their
    own; an empty table gives an empty result; columns other than the five of documents are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(n).cast("string").alias(n) for n in ("source", "lang", "n_chars", "text")])
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = rows.select(
        "doc_id", F.col("source").alias("tree"), leaf(F.col("text")).alias("leaf"), F.when(touched, leaf(lowered(F.col("text")))).alias("tampered")
    )
    rows = materialize(rows, "merkle-hashes")
    placed, trees = _place(rows, "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "merkle-leaves")
    # Ids go as text: Python would make floats of an array of numbers with a null.
    blocks = materialize(into_blocks(placed.withColumn("doc_id", F.col("doc_id").cast("string")), depth, "doc_id", "tampered"), "merkle-blocks")
    discard(rows)
    state = butterfly(block_roots(blocks, depth), depth)

    subroots = state.where("block = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("source"), F.col("node").alias("leaf"))
    placed_tops, top_trees = _place(subroots, "tree", [F.col("source").asc_nulls_first()], "merkle-sources")
    top_blocks = materialize(into_blocks(placed_tops.withColumn("tree", F.lit("")), depth, "source"), "merkle-source-blocks")
    tops = top_blocks.join(butterfly(block_roots(top_blocks, depth), depth).drop("tree"), "block")
    tops = tops.select("leaves", "source", "n", "path", "node")
    paths = materialize(tops.mapInPandas(_top_paths(depth), f"source string, subroot string, root string, top {_PATH}"), "merkle-paths")

    upper = state.withColumnsRenamed({"tree": "_t", "block": "_b"})
    both = blocks.join(upper, blocks["tree"].eqNullSafe(upper["_t"]) & (blocks["block"] == upper["_b"]))
    both = both.join(small_side(paths.drop("subroot")), both["tree"].eqNullSafe(paths["source"]))
    out = both.select("leaves", "doc_id", "tampered", "n", "path", "node", "top", "root").mapInPandas(
        _proofs(depth), "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    discard(trees, top_trees)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
