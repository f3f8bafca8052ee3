"""Source mixing to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.common import WORD, materialize, small_side


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """Add weight, `target` and `ord` to (source, source_size), one row a source.

    Sources get the weights in turn by code point, null last. Targets are share by weight of
    `share` times all sizes; none is above `most` times its source's size. What the capped ones
    leave is shared anew by weight: every target is min(most * size, level * weight), and
    the level comes from sources in the order of their own level, by prefix sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    rows = sources.withColumn("ord", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(turn, (F.col("ord") - 1) % len(weights) + 1)
    )
    cap = most * F.col("source_size")
    own = Window.orderBy(cap / F.col("weight"), "ord")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    after = own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * share
    level = (total - F.coalesce(F.sum(cap).over(upto), F.lit(0))) / F.sum("weight").over(after)
    rows = rows.withColumn("_level", level).withColumn("_open", F.col("_level") <= cap / F.col("weight"))
    lid = F.min(F.when(F.col("_open"), F.struct(cap / F.col("weight"), F.col("ord"), F.col("_level").alias("v"))))
    lid = lid.over(every).getField("v")
    target = F.when(lid.isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), lid * F.col("weight")))
    return rows.withColumn("target", target).drop("_level", "_open")


def sainte_lague(targets: DataFrame, blocks: int, shards: int = 1) -> DataFrame:
    """Give `blocks` seats to sources by highest quotients target / (2k - 1).

    targets: (ord, target), one row a source. Returns (ord, shard, quota): the seats in order
    of their quotients (ties by ord) are cut into `shards` equal runs, so every shard has
    integer quotas and each prefix of shards is itself an apportionment. Seats that a source is
    sure of are counted, not listed: only about three quotients a source and prefix are
    ranked, however many blocks there are.
    """
    own = targets.where("target > 0")
    own = own.crossJoin(F.broadcast(own.agg(F.sum("target").alias("_sum"), F.count("*").alias("_n"))))  # one row
    # A prefix of shards ends with the last seat whose (rank - 1) * shards / blocks is below its number.
    ends = F.expr(f"transform(sequence(1, {int(shards)}), j -> struct(j - 1 AS shard, (j * {int(blocks)}L + {int(shards) - 1}) div {int(shards)} AS upto))")
    own = own.select("ord", "target", "_sum", "_n", F.inline(ends))
    # Rounding to odd divisors moves all seats by half a source each at most: below the lower
    # divisor's count every seat is won, above the upper one's none is.
    low = F.col("target") * (F.col("upto") - F.col("_n") / 2 - 1) / F.col("_sum")
    high = F.col("target") * (F.col("upto") + F.col("_n") / 2) / F.col("_sum")
    own = own.withColumn("_sure", F.greatest(F.lit(0), F.floor(low + 0.5) - 1).cast("long"))
    own = own.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.greatest(F.col("_sure"), F.ceil(high + 0.5)))))
    # The row of _k = _sure stands for the sure seats themselves, the others for a seat each.
    sure = F.col("_k") == F.col("_sure")
    left = F.col("upto") - F.sum(F.when(sure, F.col("_sure"))).over(Window.partitionBy("shard"))
    quotient = F.when(~sure, F.col("target") / (2 * F.col("_k") - 1))
    seats = own.withColumn("_left", left).withColumn("_q", quotient)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc_nulls_last("_q"), "ord"))
    won = F.when(sure, F.col("_sure")).otherwise((F.col("_r") <= F.col("_left")).cast("long"))
    upto = seats.withColumn("_r", rank).groupBy("ord", "shard").agg(F.sum(won).alias("_upto"))
    before = F.lag("_upto", 1, 0).over(Window.partitionBy("ord").orderBy("shard"))
    return upto.select("ord", "shard", (F.col("_upto") - before).alias("quota")).where("quota > 0")


def seeded_key(doc_id: Column, seed: int) -> Column:
    """Place of a document in its source's stream: hexadecimal digits that depend on seed and id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    blocks: int = 65_536,
    shards: int = 8,
    seed: int = 7,
) -> DataFrame:
    """mix() with `_key`, `_whole` and `_part`: a row's text is taken `_whole` times, and `_part` words of it once more."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("_key"))
    rows = rows.withColumn("_slice", F.substring("_key", 1, 3))
    rows = materialize(rows, "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(source_targets(sources, weights, share, most), "mix-sources")
    wanted, least = sources.agg(F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    wanted = wanted or 0.0
    block = max(1, min(-int(-wanted // blocks), int((least or 0.0) // 100)))
    seats = max(1, round(wanted / block))
    quotas = sainte_lague(sources.select("ord", "target"), seats, shards).groupBy("ord").agg(
        F.sum("quota").alias("quota"), F.map_from_entries(F.collect_list(F.struct("shard", "quota"))).alias("_of")
    )
    sources = sources.join(quotas, "ord", "left").fillna({"quota": 0})
    # _ends: how many blocks of the source's stream the shards up to each take.
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at("_of", s), F.lit(0)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda n: F.aggregate(F.slice(each, F.lit(1), n), F.lit(0).cast("long"), lambda x, y: x + y))
    full = F.least(F.col("quota") * block, most * F.col("source_size"))
    sources = materialize(sources.withColumns({"_take": full, "_ends": ends}).drop("_of"), "mix-quotas")

    parts = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_psize"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_psize").over(before), F.lit(0)))
    same = parts["source"].eqNullSafe(sources["source"])
    parts = parts.join(small_side(sources), same).drop(sources["source"])
    parts = materialize(parts, "mix-parts")

    within = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size")
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    other = parts.withColumnsRenamed({"source": "_s", "_slice": "_p"})
    laid = laid.join(small_side(other), laid["source"].eqNullSafe(other["_s"]) & (laid["_slice"] == other["_p"]))
    start = F.col("_off") + F.col("_in")
    size, whole = F.col("size"), F.expr("CASE WHEN source_size > 0 THEN _take div source_size ELSE 0L END")
    rest = F.col("_take") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(start + size, rest) - start)
    laid = laid.withColumns({"_whole": whole, "_part": part.cast("long"), "_block": F.expr(f"(_off + _in) div {block}L")})
    taken = F.col("_whole") * size + F.col("_part")
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("_block"))).cast("int")
    return laid.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        "quota",
        F.lit(block).cast("long").alias("block_words"),
        F.when(taken > 0, F.least(shard, F.lit(shards - 1))).alias("shard"),
        "_key",
        "_whole",
        "_part",
    )


def mix(docs: DataFrame, **mixing) -> DataFrame:
    """How many words the mix takes of each document, and for which shard first.

    A source is a stream of its documents' words in seeded order (md5 of seed and id). It is cut
    into blocks of equal tokens, the size such that `blocks` of them make the mix, or more where
    a block would pass a hundredth of the least positive target (a word is the least block), so
    that no source is lost and small ones come as near to their targets as large ones. The seats
    that a source wins are dealt to `shards` in order of their quotients, so each shard has an integer
    quota of every source; a shard's blocks are the next ones of the seeded stream, going round up to
    `most` times. So a document's `taken` is the overlap of its range with the taken part: only
    the document at a source's last block is cut. A hot source is split over 4,096 ranges of the
    seeded order.

    A null text has no words, a null source is a source, repeated rows are separate
    documents, an empty table gives an empty result. Returns doc_id, source, size,
    source_size, target, taken, quota (blocks of the source), block_words and shard (the one that
    takes its first word; null if nothing is taken).
    """
    return mixed(docs, **mixing).drop("_key", "_whole", "_part")
