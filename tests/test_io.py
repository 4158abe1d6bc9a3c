"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from askframe.catalog import logs
from askframe.cluster import scratch_path
from askframe.operators import status
from askframe.sources import corpus, questions, scores
from askframe.sources.sinks import is_complete, materialize, materialize_parts, write_csv
from askframe.streaming import status as streams

ROWS = [
    (0, 'say "hi", ok', "  a ", "line\nbreak", "c,d", "", None, "A"),
    (7, "x", "1", "2", "3", "4", "5", "B"),
    (3, "x", "1", "2", "3", "4", "5", "B"),
]
SCHEMA = "id long, prompt string, A string, B string, C string, D string, E string, answer string"


def test_csv_reads_back_exactly(spark, tmp_path):
    path = str(tmp_path / "q")
    write_csv(spark.createDataFrame(ROWS, SCHEMA), path)
    got = sorted(tuple(r) for r in questions.read_questions(spark, path, "train").collect())
    assert [r[:2] for r in got] == sorted(r[:2] for r in ROWS)
    first = got[0]
    assert first[2:5] == ("  a ", "line\nbreak", "c,d") and first[6] is None
    assert questions.read_questions(spark, path, "test").columns[-1] == "E"
    with pytest.raises(ValueError):
        questions.read_questions(spark, path, "all")


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('answer,E,D,C,B,A,extra,prompt,id,context_top1,context_top2\nA,5,4,3,2,1,z,why,9,"c1",\n')
    row = questions.read_questions(spark, str(path), "train", with_context=True, top_n=2).collect()[0]
    assert (row.id, row.prompt, row.A, row.E, row.context) == (9, "why", "1", "5", "- c1")


def test_extra_sets_get_new_ids_and_are_counted(spark, tmp_path):
    path = str(tmp_path / "q")
    write_csv(spark.createDataFrame(ROWS, SCHEMA), path)
    got = questions.read_extra_questions(spark, path, 3).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2]
    got = questions.read_extra_questions(spark, path, 3, order="content").orderBy("id").collect()
    assert [r.prompt for r in got] == ['say "hi", ok', "x", "x"]
    with pytest.raises(Exception, match="expected 5 rows, found 3"):
        questions.read_extra_questions(spark, path, 5).collect()
    registry = {"mine": ("q", 2, True)}
    paged = spark.createDataFrame(ROWS, SCHEMA).withColumn("page_title", F.col("prompt"))
    write_csv(paged, str(tmp_path / "root" / "q"))
    assert questions.read_named_set(spark, str(tmp_path / "root"), "mine", registry).count() == 2


def test_probabilities_keep_their_type_and_model(spark, tmp_path):
    for m in ("one", "two"):
        folder = tmp_path / f"model_id={m}"
        folder.mkdir()
        (folder / "p.csv").write_text("id,A,B,C,D,E\n1,0.9,1e-3,0.05,0.03,0.017\n")
    got = scores.read_model_probs(spark, str(tmp_path)).collect()
    assert {(r.model_id, r.letter): r.prob for r in got}["two", "B"] == 0.001 and len(got) == 10


def test_rows_without_ids_are_numbered_as_they_stand(spark, tmp_path):
    text = "".join(f"{i / 10},0,0,0,0\n" for i in range(9))
    for m in ("b", "a"):
        (tmp_path / f"prob-{m}.csv").write_text("top1,top2,top3,top4,top5\n" + text)
    columns = [f"top{i}" for i in range(1, 6)]
    got = scores.read_model_probs(spark, str(tmp_path), r"prob-(\w+)\.csv", columns)
    rows = {(r.model_id, r.id): r.prob for r in got.filter("letter = 'A'").collect()}
    assert rows == {(m, i): i / 10 for m in "ab" for i in range(9)}

    page = tmp_path / "extra.csv"
    page.write_text("prompt,A,B,C,D,E,answer,page_title\n" + "".join(f"q{9 - i},1,2,3,4,5,A,t{i // 2}\n" for i in range(6)))
    extra = questions.read_extra_questions(spark, str(page), 3, questions.first_of_page).orderBy("id").collect()
    assert [(r.id, r.prompt) for r in extra] == [(0, "q9"), (2, "q7"), (4, "q5")]


def test_run_state_documents(spark, tmp_path):
    state = {"best_model_checkpoint": "m/run7/checkpoint-20", "best_metric": 0.5, "epoch": 2.0, "global_step": 40,
             "log_history": [{"step": 10, "loss": 1.0}, {"step": 20, "eval_loss": 0.5, "eval_map": 0.7}]}
    (tmp_path / "trainer_state.json").write_text(json.dumps(state, indent=2))
    (tmp_path / "other").mkdir()
    other = {**state, "best_model_checkpoint": None, "log_history": [{"step": 5, "eval_MAP@3": 0.25, "eval_note": "text"}]}
    (tmp_path / "other" / "trainer_state.json").write_text(json.dumps(other))
    both = scores.read_run_logs(spark, [str(tmp_path), str(tmp_path / "other")])
    assert both.columns[5:] == ["step", "loss", "eval_loss", "eval_MAP@3", "eval_map", "eval_note"]
    odd = both.filter("step = 5").first()
    assert (odd["eval_MAP@3"], odd.eval_note, odd.run_id, odd.best_step) == (0.25, None, None, None)
    rows = scores.read_run_logs(spark, str(tmp_path)).orderBy("step").collect()
    assert [(r.run_id, r.best_step, r.step, r.loss, r.eval_loss) for r in rows] == [("run7", 20, 10, 1.0, None), ("run7", 20, 20, None, 0.5)]


def test_materialize_trusts_only_finished_writes(spark, tmp_path):
    path, calls = str(tmp_path / "m"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert materialize(spark, path, build).count() == 3 and materialize(spark, path, build).count() == 3
    marker, = (tmp_path / "m").glob("*/_SUCCESS")
    assert len(calls) == 1 and is_complete(spark, str(marker.parent))
    marker.unlink()
    assert materialize(spark, path, build).count() == 3 and len(calls) == 2


def test_materialize_follows_files_parameters_and_code(spark, tmp_path):
    source, path, calls = str(tmp_path / "in"), str(tmp_path / "m"), []
    spark.range(3).write.parquet(source)

    def build():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 as id")

    def total(build, **more):
        return materialize(spark, path, build, [source], **more).agg(F.sum("id")).first()[0]

    assert total(build) == 6 and total(build) == 6 and len(calls) == 1
    spark.range(3, 5).write.mode("append").parquet(source)
    assert total(build) == 20 and len(calls) == 2
    assert total(build, params={"k": 1}) == 20 and len(calls) == 3
    assert total(lambda: spark.read.parquet(source)) == 10
    frame = spark.read.parquet(source)
    assert materialize(spark, path, build, [frame]).count() == 5 and len(calls) == 4
    assert materialize(spark, path, build, [frame.filter("id > 1")]).count() == 5 and len(calls) == 5
    assert materialize(spark, path, build, [frame]).count() == 5 and len(calls) == 5


def test_only_changed_parts_are_built_again(spark, tmp_path):
    for name in "ab":
        spark.range(2).write.parquet(str(tmp_path / name))
    parts, calls = {n: [str(tmp_path / n)] for n in "ab"}, []

    def build(name):
        calls.append(name)
        return spark.read.parquet(str(tmp_path / name)).withColumn("part", F.lit(name))

    def rows():
        return materialize_parts(spark, str(tmp_path / "m"), parts, build).count()

    assert rows() == 4 and rows() == 4 and calls == ["a", "b"]
    spark.range(1).write.mode("append").parquet(str(tmp_path / "b"))
    assert rows() == 5 and calls == ["a", "b", "b"]


def test_only_wanted_shards_are_read(spark, tmp_path):
    docs = spark.range(40).select("id", F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") < 30, "hot").otherwise("cold").alias("file"))
    path = str(tmp_path / "shards")
    corpus.write_fulltext(docs, path, file_bytes=8)
    files = spark.read.parquet(f"{path}/_manifest").collect()
    assert len(files) > 8 and sum(f.n for f in files) == 40
    for ids in ((31, 35), (2,), (0, 1, 2, 39), range(40), (77,), ()):
        hits = docs.filter(F.col("id").isin(*ids) if ids else F.lit(False)).select("id", "file")
        found = corpus.scan_fulltext(spark, path, hits)
        want = [i for i in ids if i < 40]
        assert sorted((r.id, r.text) for r in found.collect()) == [(i, f"t{i}") for i in want]
        holding = {f.data_file for f in files if any(f.low <= i <= f.high and (i < 30) == (f.file == "hot") for i in want)}
        assert set(corpus.files_holding(spark, path, hits)) == holding


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Fake:
        def __init__(self, master, folder):
            self.sparkContext = type("C", (), {"master": master})()
            self.conf = type("R", (), {"get": lambda _, key, default=None: folder})()

    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(Fake("spark://host", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Fake("spark://host", None), "x")


def test_stream_equals_batch_on_closed_spells(spark, sf):
    polls = logs.polls(spark, sf)
    batch = {tuple(r) for r in status.completed_transitions(polls).collect()}
    stream = {tuple(r) for r in logs.run_to_end(spark, streams.stream_completed(logs.stream_of_polls(spark, sf)), "t").collect()}
    assert stream <= batch
    last = max(r.completed_at for r in polls.selectExpr("snapshot_ts as completed_at").collect())
    open_ones = batch - stream
    assert all((last - r[2]).total_seconds() < 3600 for r in open_ones)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, ref long"

    def arrive(rows):
        df = spark.createDataFrame(rows, "ts string, ref long").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(source)

    def run():
        feed = streams.read_feed(spark, source, schema)
        return streams.stream_append_results(streams.stream_completed(streams.stream_polls(feed, "ts", "ref")), out, state)

    arrive([("2024-01-01 00:00:00", 1), ("2024-01-01 01:30:00", 1), ("2024-01-01 00:10:00", 2)])
    run()
    arrive([("2024-01-01 02:00:00", 1), ("2024-01-01 09:00:00", 3)])
    run()
    arrive([("2024-01-01 12:00:00", 3)])
    got = sorted((r.ref, str(r.completed_at)[11:13], r.elapsed_s) for r in run().collect())
    assert got == [(1, "09", 9 * 3600), (2, "01", 3600)]


def feed_of(spark, rows):
    return spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00", r, s) for h, r, s in rows], "ts string, ref long, status string").withColumn(
        "ts", F.to_timestamp("ts")
    )


# Polls at 0, 1, 4, 5, 6, 7 and 9; nothing was pending at 7.
STATES = [(h, 1, "pending") for h in (0, 1, 4, 5)] + [(h, 2, "pending") for h in (1, 6)]
STATES += [(6, 1, "complete"), (7, 2, "complete"), (9, 3, "pending"), (4, None, "complete")]
DONE = {(1, "06", 6 * 3600), (2, "04", 3 * 3600), (2, "07", 3600)}


def test_a_missing_poll_does_not_end_a_spell(spark):
    feed = feed_of(spark, STATES)
    polls = status.pending_polls(feed, status="status")
    done = status.completed_transitions(polls, status.poll_ledger(feed))
    assert {(r.ref, str(r.completed_at)[11:13], r.elapsed_s) for r in done.collect()} == DONE
    # Without the ledger the poll at 7 is unknown: job 2 is found gone at 9.
    done = status.completed_transitions(polls)
    assert {(r.ref, str(r.completed_at)[11:13]) for r in done.collect()} == {(1, "06"), (2, "04"), (2, "09")}
    handed_in = spark.createDataFrame([(2, "2023-12-31 23:00:00")], "ref long, submitted_at string").withColumn("submitted_at", F.to_timestamp("submitted_at"))
    done = status.completed_transitions(polls, status.poll_ledger(feed), handed_in)
    assert {(r.ref, r.elapsed_s) for r in done.collect()} == {(1, 6 * 3600), (2, 5 * 3600), (2, 8 * 3600)}
    empty = feed.filter("false")
    assert status.completed_transitions(status.pending_polls(empty)).count() == 0


@pytest.mark.parametrize("buckets", [1, 5])
def test_stream_with_a_ledger_equals_batch(spark, tmp_path, buckets):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    # Files arrive poll by poll; the last one only moves the watermark.
    for h in [0, 1, 4, 5, 6, 7, 9, 23]:
        rows = [r for r in STATES if r[0] == h] or [(h, None, "complete")]
        feed_of(spark, rows).coalesce(1).write.mode("append").parquet(source)
        feed = streams.read_feed(spark, source, "ts timestamp, ref long, status string")
        polls = streams.stream_polls(feed.filter("status = 'pending'"), "ts", "ref")
        done = streams.stream_completed(polls, streams.stream_ledger(feed, "ts"), buckets)
        found = streams.stream_append_results(done, out, state)
    # Job 3 left at 23, which no watermark has closed.
    assert {(r.ref, str(r.completed_at)[11:13], r.elapsed_s) for r in found.collect()} == DONE


def test_polls_are_settled_in_their_order():
    state = ([30, 10, 20, 20], ["a"], [0], ["b", "a", "b"], [10, 10, 30])
    left, done = streams.settle(state, 20)
    assert done == [("a", 0, 20), ("b", 10, 20)] or done == [("b", 10, 20), ("a", 0, 20)]
    assert left == ([30], [], [], ["b"], [30])
    assert streams.settle(left, 29) == (left, [])
    assert streams.settle(streams.settle(left, 30)[0], 30) == (([], ["b"], [30], [], []), [])
