"""Training logs and job status on the test tables, batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe.catalog import base
from askframe.catalog.base import query, table
from askframe.cluster import scratch_path
from askframe.operators import runs, status
from askframe.streaming import status as streams

FACTS = "facts as (select l.*, f.epoch, f.global_step from run_logs l join run_facts f using (run_id))"


@query(
    """select run_id, step, 'loss' as type, loss as value from run_logs union all select run_id, step, 'eval_loss', eval_loss from run_logs
       union all select run_id, step, 'eval_map', eval_map from run_logs""",
    "run_logs",
)
def unpivot_metrics(spark, sf):
    return runs.unpivot_metrics(base.run_logs(spark, sf), ["run_id", "step"])


@query(
    FACTS + """, e as (select run_id, round(step * epoch / global_step, 9) as epoch, step, loss, eval_loss, eval_map from facts)
      select run_id, epoch, step, 'loss' as type, loss as value, 'loss' as facet from e
      union all select run_id, epoch, step, 'eval_loss', eval_loss, 'loss' from e
      union all select run_id, epoch, step, 'eval_map', eval_map, 'map' from e""",
    "run_logs run_facts",
)
def learning_curve(spark, sf):
    curve = runs.learning_curve(base.run_logs_with_facts(spark, sf))
    return curve.withColumn("epoch", F.round("epoch", 9))


@query(
    """select run_id, max(step) as latest_step, arg_min(step, (eval_loss, step)) filter (eval_loss is not null) as best_step
       from run_logs group by run_id""",
    "run_logs",
)
def best_and_latest_checkpoint(spark, sf):
    return runs.best_and_latest(base.run_logs(spark, sf))


@query(
    FACTS + """, e as (select run_id, step, round(step * epoch / global_step, 9) as epoch, eval_loss as value from facts)
      select run_id, 'best' as save_point, step, epoch, value from e where value is not null qualify row_number() over (partition by run_id order by value, step) = 1
      union all (select run_id, 'latest', step, epoch, value from e qualify row_number() over (partition by run_id order by step desc) = 1)""",
    "run_logs run_facts",
)
def saved_point(spark, sf):
    return runs.saved_points(base.run_logs_with_facts(spark, sf)).withColumn("epoch", F.round("epoch", 9))


def polls(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return status.pending_polls(events, "ts", "user_id")


@query(
    """select ref, min(snapshot_ts)::varchar as first_seen, cast(date_diff('second', min(snapshot_ts), max(snapshot_ts)) as bigint) as elapsed_s
       from polls group by ref having max(snapshot_ts) = (select max(snapshot_ts) from polls)""",
    "polls",
)
def pending_now(spark, sf):
    return status.pending_now(polls(spark, sf)).withColumn("first_seen", F.col("first_seen").cast("string"))


SPELLS = """
    ranked as (select ref, snapshot_ts, dense_rank() over (order by snapshot_ts) as poll_no from polls),
    islands as (select *, poll_no - row_number() over (partition by ref order by poll_no) as island from ranked),
    ends as (select ref, min(snapshot_ts) as submitted_at, max(poll_no) + 1 as gone_no from islands group by ref, island),
    spells as (select e.ref, submitted_at, r.snapshot_ts as completed_at from ends e join (select distinct poll_no, snapshot_ts from ranked) r on r.poll_no = gone_no)"""

SPELL_COLUMNS = """ref, submitted_at::varchar as submitted_at, completed_at::varchar as completed_at,
    cast(date_diff('second', submitted_at, completed_at) as bigint) as elapsed_s"""


def spell_rows(df):
    return df.withColumn("submitted_at", F.col("submitted_at").cast("string")).withColumn(
        "completed_at", F.col("completed_at").cast("string")
    )


@query(SPELLS + f" select {SPELL_COLUMNS} from spells", "polls")
def completed_transitions(spark, sf):
    return spell_rows(status.completed_transitions(polls(spark, sf)))


def stream_of_polls(spark, sf):
    schema = table(spark, sf, "events").schema.simpleString().removeprefix("struct<").removesuffix(">")
    feed = streams.read_feed(spark, sf, schema.replace(":", " "), "events.parquet")
    return streams.stream_polls(feed, "ts", "user_id")


def run_to_end(spark, stream, name):
    return streams.stream_append_results(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-state"))


@query(
    """select snapshot_ts::varchar as window_start, count(*) as n_pending from polls group by snapshot_ts
       having snapshot_ts + interval 1 hour <= (select max(snapshot_ts) - interval 1 hour from polls)""",
    "polls",
)
def stream_pending_counts(spark, sf):
    """Windows that the watermark closed."""
    found = run_to_end(spark, streams.stream_pending_counts(stream_of_polls(spark, sf)), "pending-counts")
    return found.select(F.col("window_start").cast("string").alias("window_start"), "n_pending")


@query(
    SPELLS + f" select {SPELL_COLUMNS} from spells where completed_at <= (select max(snapshot_ts) - interval 1 hour from polls)",
    "polls",
)
def stream_completed(spark, sf):
    """Spells that the watermark closed."""
    return spell_rows(run_to_end(spark, streams.stream_completed(stream_of_polls(spark, sf)), "completed"))


@query("select snapshot_ts::varchar as snapshot_ts, ref from polls", "polls")
def stream_append_results(spark, sf):
    found = run_to_end(spark, stream_of_polls(spark, sf), "polls")
    return found.select(F.col("snapshot_ts").cast("string").alias("snapshot_ts"), "ref")
