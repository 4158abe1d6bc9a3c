"""Status feeds as streams: pending counts, completed jobs, an append-only result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from askframe.operators.status import elapsed_seconds


def read_feed(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """Files arriving in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def stream_polls(feed: DataFrame, ts: str, ref: str, delay: str = "1 hour", unit: str = "hour") -> DataFrame:
    """Distinct ``(snapshot_ts, ref)`` with a watermark.

    Duplicates are dropped in state keyed by (poll, job), so one busy job does
    not load one task, and state leaves with the watermark.
    """
    polls = feed.select(
        F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("snapshot_ts"), F.col(ref).alias("ref")
    )
    return polls.withWatermark("snapshot_ts", delay).dropDuplicates(["snapshot_ts", "ref"])


def stream_pending_counts(polls: DataFrame, interval: str = "1 hour") -> DataFrame:
    """Jobs pending per poll interval."""
    counts = polls.groupBy(F.window("snapshot_ts", interval)).agg(F.count("*").alias("n_pending"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_pending")


def stream_ledger(feed: DataFrame, ts: str, delay: str = "1 hour", unit: str = "hour") -> DataFrame:
    """Distinct ``snapshot_ts`` of all polls of a feed, with a watermark."""
    polls = feed.select(F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("snapshot_ts"))
    return polls.withWatermark("snapshot_ts", delay).dropDuplicates(["snapshot_ts"])


def settle(state: tuple, watermark: int) -> tuple[tuple, list[tuple]]:
    """Go through the polls that the watermark has closed, in their order.

    A state is ``(polls, open refs, open since, waiting refs, their polls)``.
    Returns the state without those polls, and ``(ref, submitted, completed)``
    of the jobs that one of them lacks.
    """
    polls, refs, since, waiting, at = state
    pending = dict(zip(refs, since))
    by_poll: dict[int, list] = {}
    for ref, poll in zip(waiting, at):
        by_poll.setdefault(poll, []).append(ref)
    done = []
    closed = sorted(p for p in set(polls) if p <= watermark)
    for poll in closed:
        seen = set(by_poll.pop(poll, []))
        done += [(ref, began, poll) for ref, began in pending.items() if ref not in seen]
        pending = {ref: pending.get(ref, poll) for ref in seen}
    left = [(ref, poll) for poll, many in by_poll.items() for ref in many]
    return (sorted(set(polls) - set(closed)), list(pending), list(pending.values()), [r for r, _ in left], [p for _, p in left]), done


def stream_completed(polls: DataFrame, ledger: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """Completed jobs, each emitted once the watermark has passed the first poll without it.

    Jobs are hashed to ``buckets`` keys, and every poll of ``ledger`` (by
    default those in which any job was pending) is told to each of them, once.
    A key's state holds the jobs open at the last closed poll and the rows of
    polls still open; its timer is the earliest of those.  One row a job and
    poll reaches it, so a busy job weighs no more than another.  A row without
    a job only tells of its poll.
    """
    kind = polls.schema["ref"].dataType.simpleString()
    micros = F.unix_micros("snapshot_ts").alias("poll")
    told = polls.select("snapshot_ts").dropDuplicates(["snapshot_ts"]) if ledger is None else ledger
    marks = told.select(F.explode(F.array(*map(F.lit, range(buckets)))).alias("bucket"), "snapshot_ts", micros, F.lit(None).cast("string").alias("ref"))
    rows = polls.select(F.pmod(F.xxhash64("ref"), F.lit(buckets)).cast("int").alias("bucket"), "snapshot_ts", micros, F.col("ref").cast("string").alias("ref"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        polls, refs, since, waiting, at = map(list, state.get if state.exists else ([],) * 5)
        for frame in frames:
            polls += frame["poll"].tolist()
            found = frame[frame["ref"].notna()]
            waiting += found["ref"].tolist()
            at += found["poll"].tolist()
        now = state.getCurrentWatermarkMs()
        (polls, *rest), done = settle((polls, refs, since, waiting, at), now * 1000)
        state.update((polls, *rest))
        if polls:
            state.setTimeoutTimestamp(max(polls[0] // 1000, now + 1))
        columns = list(zip(*done)) or [(), (), ()]
        kinds = {"ref": object, "submitted": "int64", "completed": "int64"}
        yield pd.DataFrame({name: pd.Series(c, dtype=k) for (name, k), c in zip(kinds.items(), columns)})

    found = rows.unionByName(marks).groupBy("bucket").applyInPandasWithState(
        step,
        "ref string, submitted long, completed long",
        "polls array<long>, refs array<string>, since array<long>, waiting array<string>, at array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    spells = found.select(F.col("ref").cast(kind).alias("ref"), F.timestamp_micros("submitted").alias("submitted_at"), F.timestamp_micros("completed").alias("completed_at"))
    return spells.withColumn("elapsed_s", elapsed_seconds(F.col("submitted_at"), F.col("completed_at")))


def stream_append_results(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append a stream's results to parquet until its input is used up, then read them.

    A restart with the same checkpoint goes on where the last run stopped.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)
