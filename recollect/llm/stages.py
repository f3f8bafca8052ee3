"""Operators applied to a documents table as filters and rewrites that keep its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import WORD, discard, free_name, let, materialize, small_side, with_position
from recollect.llm.mixing import mixed, n_words, seeded_key
from recollect.llm.setsketch import Params, near_duplicates


def drop_near_duplicates(docs: DataFrame, params: Params) -> DataFrame:
    """One document, that of the least id, of each group stays.

    Rows with a null id, a null, empty or wordless text stay; rows that repeat an id stay or go
    together, for they are one document; an empty table gives an empty one; all columns are kept.
    """
    gone = near_duplicates(docs, params).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(small_side(materialize(gone, "stage-dropped")), "doc_id", "left_anti").select(docs.columns)


def repeat_by_mix(docs: DataFrame, seed: int = 7, **mixing) -> DataFrame:
    """The mix itself: each document as often as its taken words hold it whole, and once more cut
    to the words left over, which happens to one document a source at most. Documents of
    which nothing is taken go.

    What a source takes is a prefix of its seeded stream, so one row a source says it all: how often
    the whole stream is taken, the last document of the rest and how much of that. Every text
    is compared with its source's row where it is read; texts are never shuffled.

    Null, empty and wordless texts go; a null source is a source, a null id an id; of rows that
    repeat id, source and number of words at a source's last place as many are taken as there is room
    for; an empty table gives an empty one. Helpers are one column of a free name, so none of the
    columns of docs is touched but text and n_chars of the cut documents.
    """
    taken = materialize(mixed(docs, seed=seed, **mixing).where("size > 0"), "stage-taken")
    bounds = taken.groupBy("source").agg(
        F.max("_whole").alias("whole"), F.max(F.when(F.col("_part") > 0, F.struct("_key", "size"))).alias("last")
    )
    bounds = materialize(bounds.withColumnRenamed("source", "of"), "stage-bounds")
    # The rows at the last place: more than one where rows repeat an id.
    there = taken.join(small_side(bounds), taken["source"].eqNullSafe(bounds["of"]) & (F.struct("_key", "size") == F.col("last")))
    there = there.groupBy("of").agg(
        F.count("*").alias("rows"), F.count_if(F.col("_part") == F.col("size")).alias("full"),
        F.max(F.when(F.col("_part") < F.col("size"), F.col("_part"))).alias("cut"),
    ).withColumnRenamed("of", "_of")
    first, bounds = bounds, materialize(bounds.join(there, bounds["of"].eqNullSafe(there["_of"]), "left").drop("_of"), "stage-last")
    discard(taken, first)

    columns, name = docs.columns, free_name(docs)
    side = bounds.select(F.struct("of", "whole", "last", "rows", "full", "cut").alias(name))
    rows = docs.join(small_side(side), docs["source"].eqNullSafe(side[f"{name}.of"]))
    at = F.struct(seeded_key(F.col("doc_id"), seed).alias("_key"), n_words(F.col("text")).alias("size"))
    rows = rows.withColumn(name, F.struct(f"{name}.*", F.lit(0).cast("long").alias("rank")))
    m = F.col(name)
    if bounds.where("rows > 1").limit(1).count():
        tied = F.coalesce((m["rows"] > 1) & (at == m["last"]), F.lit(False))
        ranked = rows.where(tied).select(
            F.struct("*").alias("_row"), m["of"].alias("_of"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_id")
        )
        ranked = materialize(ranked, "stage-tied")
        placed, _ = with_position(ranked, [F.col("_of"), F.col("_hash"), F.col("_id")], "stage-ranks")
        first = placed.groupBy(F.col("_of").alias("_o")).agg(F.min("_pos").alias("_first"))
        placed = placed.join(small_side(first), placed["_of"].eqNullSafe(first["_o"]))
        rank = m.withField("rank", F.col("_rank"))
        placed = placed.select("_row.*", (F.col("_pos") - F.col("_first")).alias("_rank")).withColumn(name, rank)
        rows = rows.where(~tied).unionByName(placed.select(rows.columns))
    none = F.array().cast("array<bigint>")

    def copies(a: Column) -> Column:
        """0 for each whole copy of a text, then the words of a cut one."""
        before, here = F.coalesce(a < m["last"], F.lit(False)), F.coalesce(a == m["last"], F.lit(False))
        whole = m["whole"] + F.when(before | (here & (m["rank"] < m["full"])), 1).otherwise(0)
        rest = F.when(here & (m["rank"] == m["full"]), F.coalesce(m["cut"], F.lit(0))).otherwise(0)
        cut = F.when(rest > 0, F.array(rest.cast("long"))).otherwise(none)
        return F.when(a["size"] > 0, F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), cut)).otherwise(none)

    rows = rows.withColumn(name, let(at, copies))  # the words of a text are counted once
    rows = rows.withColumn(name, F.explode(name))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(name).cast("int"))
    rows = rows.withColumn("text", F.when(F.col(name) > 0, F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in columns:
        count = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col(name) > 0, count).otherwise(F.col("n_chars")))
    return rows.select(columns)
