"""Structured Streaming forms of the jobs, and ordered replays that a plain aggregate can't express."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import backoff_seconds
from recollect.operators.common import SUBJECT
from recollect.operators.compile import Compiler, compile_memories
from recollect.streaming.ordered import NEVER, in_order, keyed_state


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Write all that a bounded source holds to a Parquet folder; a restart goes on from the checkpoint."""
    with keyed_state(stream.sparkSession):
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode(mode).partitionBy(*partition_by).trigger(availableNow=True).start()
        )
    query.awaitTermination()


def upsert_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write an update-mode aggregate: each batch's changed rows, with the batch's number, in a folder of its own."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the last batch that wrote it."""
    names = [c for c in rows.columns if c not in (*keys, "epoch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "epoch").alias("_r")).select(*keys, "_r.*")


def stream_compile(episodes: DataFrame, delay: str | None = "1 hour", compiler: Compiler = compile_memories) -> DataFrame:
    """Memories of a stream of episodes; the checkpoint stands for last_compiled_at.

    Every episode is compiled, however late its own time is. One that the source repeats within `delay` of its first arrival
    goes; state is kept for that time only. A later repeat, or any where `delay` is None, is compiled again, into memories of the same
    ids, of which distinct_memories takes one.
    """
    if delay is None:
        return compiler(episodes)
    # The watermark goes by the time of arrival, which no episode is behind.
    seen = episodes.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", delay)
    return compiler(seen.dropDuplicatesWithinWatermark(["episode_id"]).drop("_seen"))


def distinct_memories(memories: DataFrame) -> DataFrame:
    """One row of each memory id, where a stream has compiled an episode more than once."""
    return memories.dropDuplicates(["memory_id"])


def minute_hits(events: DataFrame, rpm: int, delay: str = "5 minutes") -> DataFrame:
    """Hits of each key in each minute, whether they pass the limit, and when to retry. Batch or stream.

    On a stream, windows older than the watermark are let go.
    """
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    hits = rows.groupBy("key", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("hits"), F.max("ts").alias("last_at"))
    wait = F.greatest(F.lit(1), 60 - F.second("last_at"))
    over = F.col("hits") > rpm
    return hits.select("key", F.col("w.start").alias("window_start"), "hits", over.alias("limited"), F.when(over, wait).alias("retry_after"))


def expire_windows(windows: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    cut = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return windows.where(F.col("window_start") >= cut)


def _admitted(window: deque, micros: int, rpm: int, seconds: float) -> bool:
    """Whether an event at `micros` is admitted after those of the window, which is moved on."""
    while window and window[0] <= micros - seconds * 1e6:
        window.popleft()
    if len(window) >= rpm:
        return False
    window.append(micros)
    return True


def _admit(rpm: int, seconds: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, deque()
        for batch in batches:
            kept = []
            for k, t in zip(batch["key"], batch["micros"], strict=True):
                if k != key:
                    key, window = k, deque()
                kept.append(_admitted(window, t, rpm, seconds))
            yield batch.assign(admitted=kept)

    return admit


def sliding_admission(events: DataFrame, rpm: int, seconds: float = 60.0) -> DataFrame:
    """(key, event_id, micros, admitted): at most rpm admitted events in any trailing minute.

    Only admitted events count, so the order matters: each key's events are sorted in their
    partition and read once; what is held is a key's last minute.
    """
    rows = events.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    rows = rows.repartition("key").sortWithinPartitions("key", "micros", "event_id")
    return rows.mapInPandas(_admit(rpm, seconds), "key long, event_id long, micros long, admitted boolean")


def sliding_admission_stream(events: DataFrame, rpm: int, seconds: float = 60.0, delay: str = "5 minutes") -> DataFrame:
    """The same on a stream of (key, event_id, ts), in order over all batches: (key, event_id, micros, admitted, late).

    A key's state holds the admitted times of one window, which go once they have left it, and the rows of the last `delay`. A row that
    comes after a later one of its key was judged is given out as late, with `admitted` null; it does not count. event_id is
    read as text of its number.
    """

    def step(key: tuple, carry: list[tuple], rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        window, out = deque(t for t, _ in carry), []
        for micros, name, _ in rows:
            out.append((int(name), micros, _admitted(window, micros, rpm, seconds), False))
        return [(t, "") for t in window], out

    # Numbers in order as texts: a sign, then digits of one length.
    order = F.format_string("%020d", F.col("event_id").cast("long"))
    return in_order(
        events.withColumn("ts", F.col("ts").cast("timestamp")), ["key"], "ts", order, F.lit(""), delay, step,
        lambda key, row: (int(row[1]), row[0], None, True), ["event_id", "micros", "admitted", "late"],
        "key long, event_id long, micros long, admitted boolean, late boolean", forget=int(seconds * 1e6),
    )


SEVERITY = {"healthy": 0, "watch": 1, "at_risk": 2}


def health_alert_stream(states: DataFrame, delay: str = "1 hour", forget_days: float | None = None) -> DataFrame:
    """Alerts of a stream of (tenant_id, subject_id, state, updated_at), in order of time over all batches:
    (tenant_id, subject_id, event, previous_state, current_state, updated_at).

    The key is (tenant, subject); states of one time are taken in order of their names. Each row waits until the newest one
    of the stream is `delay` ahead. A row that comes after a later one of its subject was read, or has no time, gives the event `late`, with
    null previous state, and changes nothing. A subject's last state is kept for ever, or for `forget_days` after its last row;
    after that it is new again. A restart from the checkpoint repeats no alert. Start the query within `keyed_state`, as run_to_end does.
    """

    def step(key: tuple, carry: list[tuple], rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        before, out = carry[0][1] if carry else None, []
        for micros, now, _ in rows:
            worse = SEVERITY.get(now, 0) - SEVERITY.get(before or "healthy", 0)
            if worse > 0 or worse < 0 and before is not None:
                out.append(("subject.health_degraded" if worse > 0 else "subject.health_improved", before or "healthy", now, micros))
            before = now
        return [(rows[-1][0], before)], out

    columns = ["event", "previous_state", "current_state", "micros"]
    alerts = in_order(
        states, list(SUBJECT), "updated_at", F.col("state"), F.lit(""), delay, step,
        lambda key, row: ("late", None, row[1], None if row[0] == NEVER else row[0]), columns,
        "tenant_id string, subject_id string, event string, previous_state string, current_state string, micros long",
        None if forget_days is None else int(forget_days * 86_400e6),
    )
    return alerts.withColumn("updated_at", F.timestamp_micros("micros")).drop("micros")


def due_events(outbox: DataFrame, as_of: str, most: int | None = 20) -> DataFrame:
    """Pending events whose time has come, those due longest first; `most` is the size of a delivery batch."""
    due = outbox.where("status = 'pending'").where(F.coalesce("next_attempt_at", "created_at") <= F.lit(as_of).cast("timestamp"))
    return due if most is None else due.orderBy(F.coalesce("next_attempt_at", "created_at"), "event_id").limit(most)


def outbox_advance(outbox: DataFrame, results: DataFrame, as_of: str, jitter: Column | float = 1.0) -> DataFrame:
    """The outbox after attempts (event_id, ok, http_status, error): delivered, due again later, or given up.

    An attempt sets last_attempt_at and http_status (null where no answer came); delivered_at on success, last_error on failure, which
    else stay. Columns that the outbox or the results lack count as null.
    """
    now = F.lit(as_of).cast("timestamp")
    for name, kind in (("last_attempt_at", "timestamp"), ("delivered_at", "timestamp"), ("last_error", "string"), ("http_status", "int")):
        if name not in outbox.columns:
            outbox = outbox.withColumn(name, F.lit(None).cast(kind))
    of = lambda name, kind: (F.col(name) if name in results.columns else F.lit(None)).cast(kind).alias(f"_{name}")
    rows = outbox.join(results.select("event_id", "ok", of("http_status", "int"), of("error", "string")), "event_id", "left")
    tried = F.col("ok").isNotNull()
    n = F.col("attempts") + 1
    wait = backoff_seconds(n) * (F.lit(jitter) if isinstance(jitter, float) else jitter)
    later = F.timestamp_micros(F.unix_micros(now) + (wait * 1_000_000).cast("long"))
    after = F.when(F.col("ok"), "delivered").when(n >= F.col("max_attempts"), "dead_letter").otherwise("pending")
    return rows.withColumns({
        "next_attempt_at": F.when(tried & (after == "pending"), later).otherwise(F.col("next_attempt_at")),
        "status": F.when(tried, after).otherwise(F.col("status")),
        "attempts": F.when(tried, n).otherwise(F.col("attempts")),
        "last_attempt_at": F.when(tried, now).otherwise(F.col("last_attempt_at")),
        "http_status": F.when(tried, F.col("_http_status")).otherwise(F.col("http_status")),
        "delivered_at": F.when(tried & F.col("ok"), now).otherwise(F.col("delivered_at")),
        "last_error": F.when(tried & ~F.col("ok"), F.col("_error")).otherwise(F.col("last_error")),
    }).drop("ok", "_http_status", "_error")


def read_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The Parquet files of one table, a file or a folder, as a stream (the glob lets a path be a file)."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
