"""Compiling episodes into typed memories."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import payload_text, profile_facts, stable_id, strip
from recollect.operators.asof import in_ranges
from recollect.operators.common import SUBJECT, per_subject_cap

Compiler = Callable[[DataFrame], DataFrame]
KINDS = ("profile_fact", "episode_summary", "procedure", "artifact_ref")


def uncompiled(episodes: DataFrame, cap: int | None = 500) -> DataFrame:
    """Episodes not compiled yet, the oldest of each subject up to the cap."""
    rows = episodes.where(F.col("last_compiled_at").isNull()) if "last_compiled_at" in episodes.columns else episodes
    return per_subject_cap(rows, cap, F.col("created_at"), F.col("episode_id"))


def _memory(kind: str, content: Column, n: int, confidence: float, at: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), at.alias("ordinal"), F.substring(content, 1, n).alias("content"),
        F.substring(content, 1, 200).alias("summary"), F.lit(confidence).alias("confidence"),
    )


def compile_memories(episodes: DataFrame) -> DataFrame:
    """Map-only: one summary of each episode with text and one memory of each fact in it."""
    text = payload_text(F.col("payload"))
    rows = episodes.withColumn("_text", text).where(F.col("_text") != "")
    summary = F.array(_memory("episode_summary", F.col("_text"), 500, 0.8, F.lit(0)))
    facts = F.transform(
        profile_facts(F.col("_text")), lambda x, i: _memory("profile_fact", x, 1 << 30, 0.6, i + 1)
    )
    rows = rows.withColumn("_m", F.explode(F.concat(summary, facts)))
    return rows.select(
        stable_id("compile", F.col("episode_id"), F.col("_m.kind"), F.col("_m.ordinal").cast("string")).alias("memory_id"),
        "tenant_id", "subject_id", "_m.kind", "_m.content", "_m.summary", "_m.confidence",
        F.col("created_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
        F.array("episode_id").alias("source_episode_ids"), F.lit("{}").alias("metadata"),
        F.lit("active").alias("status"), "created_at",
    )


def compile_new(episodes: DataFrame, as_of: str, cap: int | None = 500, compiler: Compiler = compile_memories) -> tuple[DataFrame, DataFrame]:
    """(new memories, the episodes now marked compiled); textless ones are marked too."""
    todo = uncompiled(episodes, cap)
    return compiler(todo), todo.withColumn("last_compiled_at", F.lit(as_of).cast("timestamp"))


def step(used: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters used, whether a batch is opened) after a text of n, for each number used before it."""
    opens = (used > 0) & (used + n > most)
    return np.where(opens, n, used + n), opens


def passage(lengths: np.ndarray, most: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(used, batches opened) after a run of texts, for every number of characters that may be used before it: 0 to most, or one text alone."""
    used = np.arange(max(most, longest) + 1)
    opened = np.zeros(len(used), np.int64)
    for n in lengths.tolist():
        used, more = step(used, n, most)
        opened += more
    return used, opened


def _runs(key: tuple, rows: pd.DataFrame, most: int, longest: int) -> pd.DataFrame:
    """What a partition tells the ones after it: its first and last subject, and how used characters come out of it. Where the
    last subject isn't the first that is a number; else it is a number for each that may come in, written where it changes."""
    subject = rows["subject_id"].fillna("\0") + "\1" + rows["tenant_id"].fillna("\0")
    last = rows[(subject == subject.iloc[-1]).to_numpy()]
    alone = len(last) == len(rows)
    used, opened = passage(last["n"].to_numpy(), most, longest)
    if not alone:
        used, opened = used[:1], opened[:1]
    change = np.flatnonzero(np.concatenate([[True], (used[1:] != used[:-1]) | (opened[1:] != opened[:-1])]))
    return pd.DataFrame({"_part": [key[0]], "first": [subject.iloc[0]], "last": [subject.iloc[-1]], "alone": [alone], "at": [change], "used": [used[change]], "opened": [opened[change]]})


def _number(most: int, carries: dict[int, tuple[int, int]]):
    def number(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        used, batch = carries.get(key[0], (0, 0))
        subject, out = None, []
        for tenant, name, n in zip(rows["tenant_id"], rows["subject_id"], rows["n"], strict=True):
            if subject is not None and (tenant, name) != subject:
                batch, used = 0, 0
            subject = (tenant, name)
            if used and used + n > most:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return rows[["tenant_id", "subject_id", "episode_id"]].assign(batch=out)

    return number


def pack_prompt_batches(episodes: DataFrame, most: int = 6000, text_cap: int = 4000) -> DataFrame:
    """Number each subject's texts by prompt batch: in order, a new batch where `most` characters would be passed.

    Only lengths travel. They are sorted into range partitions, which cut a hot subject; each partition works out, for every number of
    characters that its first subject may have used before it, how that subject comes out of it (a short list, since such passages soon
    run together), the driver follows these lists from partition to partition, and each partition numbers its texts.
    """
    text = F.substring(payload_text(F.col("payload")), 1, text_cap)
    rows = episodes.select(*SUBJECT, "episode_id", "created_at", F.length(text).alias("n")).where("n > 0")
    laid = in_ranges(rows, list(SUBJECT), [F.col("created_at"), F.col("episode_id")], "prompt-batches")
    schema = "_part bigint, first string, last string, alone boolean, at array<bigint>, used array<bigint>, opened array<bigint>"
    runs = laid.groupBy("_part").applyInPandas(lambda key, part: _runs(key, part.sort_values("_at"), most, text_cap), schema)
    carries, before = {}, (None, 0, 0)
    for r in runs.orderBy("_part").collect():  # a row a partition
        came = before[1:] if before[0] == r["first"] else (0, 0)
        carries[r["_part"]] = came
        at = int(np.searchsorted(r["at"], came[0], side="right")) - 1 if r["alone"] else 0
        before = (r["last"], r["used"][at], r["opened"][at] + (came[1] if r["alone"] else 0))
    number = _number(most, carries)
    return laid.groupBy("_part").applyInPandas(
        lambda key, part: number(key, part.sort_values("_at")), "tenant_id string, subject_id string, episode_id string, batch int"
    )


def normalize_extractions(rows: DataFrame) -> DataFrame:
    """A model's rows (kind, content JSON, confidence, episode_index, n_episodes) made valid.

    An unknown kind is a summary, a list is joined by line ends, empty contents go, confidence
    is cut to 0..1 (0.7 if missing), an index out of range is 0.
    """
    many = F.array_join(F.from_json("content", "array<string>"), "\n")
    content = strip(F.when(F.col("content").startswith("["), F.coalesce(many, "content")).otherwise(F.col("content")))
    index = F.when((F.col("episode_index") >= 0) & (F.col("episode_index") < F.col("n_episodes")), F.col("episode_index"))
    return rows.withColumns({
        "kind": F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("episode_summary"),
        "content": content,
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7)))),
        "episode_index": F.coalesce(index, F.lit(0)),
    }).where(F.coalesce(F.col("content"), F.lit("")) != "")
