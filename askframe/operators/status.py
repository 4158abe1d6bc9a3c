"""Job status polls: what is pending, what completed and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending_polls(
    feed: DataFrame, ts: str = "ts", ref: str = "ref", unit: str = "hour", status: str | None = None, pending: str = "pending"
) -> DataFrame:
    """``(snapshot_ts, ref)``, once per poll in which the job was seen pending.

    Without a ``status`` column every row of the feed is a pending job.
    """
    rows = feed if status is None else feed.filter(F.col(status) == pending)
    return rows.select(F.date_trunc(unit, F.col(ts)).alias("snapshot_ts"), F.col(ref).alias("ref")).distinct()


def poll_ledger(feed: DataFrame, ts: str = "ts", unit: str = "hour") -> DataFrame:
    """``snapshot_ts`` of every poll that took place, also of those in which nothing was pending."""
    return feed.select(F.date_trunc(unit, F.col(ts)).alias("snapshot_ts")).distinct()


def numbered_polls(ledger: DataFrame) -> DataFrame:
    """``(snapshot_ts, poll_no, next_poll)``: polls in their order, whatever the time between them.

    One row a poll; the jobs in it never come here.
    """
    order = Window.orderBy("snapshot_ts")
    return ledger.distinct().select(
        "snapshot_ts", F.row_number().over(order).alias("poll_no"), F.lead("snapshot_ts").over(order).alias("next_poll")
    )


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def pending_now(polls: DataFrame) -> DataFrame:
    """Jobs pending in the latest poll, with the time since they were first seen."""
    latest = polls.agg(F.max("snapshot_ts")).scalar()
    seen = polls.groupBy("ref").agg(F.min("snapshot_ts").alias("first_seen"), F.max("snapshot_ts").alias("last_seen"))
    return seen.filter(F.col("last_seen") == latest).select(
        "ref", "first_seen", elapsed_seconds(F.col("first_seen"), F.col("last_seen")).alias("elapsed_s")
    )


def pending_spells(polls: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Unbroken runs of polls per job: ``(ref, submitted_at, last_seen, completed_at)``.

    A run goes on while the job is in every poll of ``ledger`` (by default the
    polls in which any job was pending), and ends at the first poll without
    it; a missing poll neither ends a run nor dates its end.  The runs of jobs
    still pending in the last poll have no ``completed_at``.
    """
    numbered = numbered_polls(polls.select("snapshot_ts") if ledger is None else ledger)
    placed = polls.select("snapshot_ts", "ref").distinct().join(numbered, "snapshot_ts")
    # Within a run the poll's number and the row's number grow alike.
    island = F.col("poll_no") - F.row_number().over(Window.partitionBy("ref").orderBy("poll_no"))
    runs = placed.withColumn("island", island).groupBy("ref", "island")
    return runs.agg(
        F.min("snapshot_ts").alias("submitted_at"),
        F.max("snapshot_ts").alias("last_seen"),
        F.max_by("next_poll", "poll_no").alias("completed_at"),
    ).drop("island")


def completed_transitions(polls: DataFrame, ledger: DataFrame | None = None, submitted: DataFrame | None = None) -> DataFrame:
    """Jobs pending in one poll and gone in the next: ``(ref, submitted_at, completed_at, elapsed_s)``.

    ``submitted`` is ``(ref, submitted_at)`` where the feed tells when a job
    was handed in; a job that it leaves out counts from its first poll.
    """
    done = pending_spells(polls, ledger).filter(F.col("completed_at").isNotNull()).drop("last_seen")
    if submitted is not None:
        known = submitted.groupBy("ref").agg(F.min("submitted_at").alias("handed_in"))
        done = done.join(known, "ref", "left").withColumn("submitted_at", F.coalesce("handed_in", "submitted_at")).drop("handed_in")
    return done.withColumn("elapsed_s", elapsed_seconds(F.col("submitted_at"), F.col("completed_at")))
