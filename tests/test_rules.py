"""Hand-worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from askframe.fixed_values import EXTRA_SETS, PROMPT_TEXTS
from askframe.functions import text as tx
from askframe.functions.prompts import prompt_kind
from askframe.functions.vectors import l2_normalize
from askframe.operators import blend, metrics, prompts, questions, runs, scoring, sentences
from askframe.sources.questions import registry_frame, select_context_version

QUESTION = "id long, prompt string, context string, A string, B string, C string, D string, E string, answer string"


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    "actual, predicted, expected",
    [
        (["A"], ["B", "A", "C"], 0.5),
        (["A"], ["A", "A", "A"], 1.0),
        ([], ["A"], 0.0),
        (["A", "B"], ["A", "C", "B"], (1 + 2 / 3) / 2),
        (["D"], ["A", "B", "C", "D"], 0.0),
        (["A", "B", "C", "D"], ["A", "B", "C"], 1.0),
        (["A"], [], 0.0),
        (["B"], ["A", "A", "B"], 1 / 3),
    ],
)
def test_ap_at_3(spark, actual, predicted, expected):
    df = spark.createDataFrame([(actual, predicted)], "actual array<string>, predicted array<string>")
    assert one(metrics.map_at_k(df, [], 3, reduction=None)).ap == pytest.approx(expected)


def test_map_averages_rows(spark):
    df = spark.createDataFrame([(["A"], ["A"]), (["A"], ["B"])], "actual array<string>, predicted array<string>")
    assert one(metrics.map_at_k(df, [], 3)).map_at_k == 0.5


@pytest.mark.parametrize(
    "context, prompt, option, limit, expected",
    [
        ("a b c. d.", "p q", "r", 5, ""),
        ("a b. c d. e f.", "p", "", 6, "a b. c d."),
        ("a b. c d e f.", "p", "", 5, "a b."),
        ("- a b\n- c d. e", "p", "", 100, "- a b.  c d. e."),
        ("keep. as is", "p", "", 0, "keep. as is"),
        ("", "p", "", 5, ""),
    ],
)
def test_word_budget(spark, context, prompt, option, limit, expected):
    df = spark.createDataFrame([(1, prompt, context, option, "", "", "", "", "A")], QUESTION)
    assert one(sentences.context_word_budget(df, limit, use_all_answers=False)).context == expected


def test_word_budget_counts_all_options(spark):
    df = spark.createDataFrame([(1, "p", "a. b. c.", "x", "x", "x", "x", "x", "A")], QUESTION)
    assert one(sentences.context_word_budget(df, 8, True)).context == "a."
    assert one(sentences.context_word_budget(df, 8, False)).context == "a. b. c."


def test_bullets_skip_nulls(spark):
    df = spark.createDataFrame([("x", None, "z")], "context_top1 string, context_top2 string, context_top3 string")
    assert one(df.select(tx.bullets_from_columns(3).alias("c"))).c == "- x\n- z"
    assert one(df.select(tx.context_bullets(F.array(F.lit("abcdef")), 3).alias("c"))).c == "- abc"


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("it's A-b -5 x/y?", "it ' s a-b 5 x/y ?"),
        ("end. a/ \"q\"!", 'end a / " q " !'),
        ("Ciónrr ñ_1 v1.2.", "ciónrr ñ_1 v1.2"),
        ("  ", ""),
    ],
)
def test_tokens(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "t string")
    assert " ".join(one(df.select(tx.tokenize(F.col("t")).alias("x"))).x) == tokens


def test_ngrams_come_after_stop_words(spark):
    df = spark.createDataFrame([("red and the blue sky",), ("the",), ("sun",)], "t string")
    got = [r.x for r in df.select(tx.terms(F.col("t")).alias("x")).collect()]
    assert got == [["red", "blue", "sky", "red blue", "blue sky"], [], ["sun"]]


def test_letter_ties(spark):
    df = spark.createDataFrame([(1, c, 0.2) for c in "CABED"], "id long, letter string, prob double")
    assert one(scoring.prediction_string(df, ["id"])).prediction == "A B C D E"
    assert one(scoring.prediction_string(df, ["id"], "last")).prediction == "E D C B A"
    ranks = {r.letter: r["rank"] for r in scoring.rank_letters(df, ["id"], "last").collect()}
    assert ranks == {"E": 1, "D": 2, "C": 3, "B": 4, "A": 5}


def test_template_text_in_data_stays(spark):
    df = spark.createDataFrame([(1, "use {context}", "ctx {a}", "1", "2", "3", "4", "5", "B")], QUESTION)
    text = one(prompts.render_prompt(df, "Llama2", 6, True)).text
    assert "use {context}" in text and "ctx {a}" in text and text.endswith("Answer: \nB")
    assert one(prompts.render_prompt(df, "Platypus2", 2, True)).text.endswith("### Response: 2")
    assert one(prompts.render_prompt(df, "Llama2", 4, False)).text.endswith("### Answer: ")


def test_yes_no_rows(spark):
    df = spark.createDataFrame([(1, "p", "c", "1", "2", None, "4", "5", "B")], QUESTION)
    rows = {r.letter: r for r in prompts.render_prompt(df, "Llama2", 9, True).collect()}
    assert sorted(rows) == ["A", "B", "D", "E"]
    assert rows["B"].text.endswith("### Response:\nyes") and rows["A"].text.endswith("### Response:\nno")


def test_unknown_templates(spark):
    with pytest.raises(NotImplementedError):
        prompt_kind("Llama2", 10)
    df = spark.createDataFrame([("Nobody", 1)], "family string, prompt_id int")
    with pytest.raises(Exception, match="unknown template"):
        prompts.with_prompt_kind(df).collect()
    assert len(PROMPT_TEXTS) == 12


def test_incomplete_questions_have_no_query_text(spark):
    df = spark.createDataFrame([(1, "p", "c", "1", "2", None, "4", "5", "B")], QUESTION)
    row = one(df.select(tx.query_text_all().alias("a"), tx.query_text_answer().alias("b"), tx.query_text_weighted().alias("w")))
    assert (row.a, row.b, row.w) == (None, "p 2", None)


def test_nfkd(spark):
    df = spark.createDataFrame([("ﬁ", 'é "x"'), ("a", None)], "t string, x string")
    rows = df.select(tx.corpus_text_v0(F.col("t"), F.col("x")).alias("v"), tx.normalize_context(F.col("t")).alias("n")).collect()
    assert [r.v for r in rows] == ["fi é x", None] and [r.n for r in rows] == ["fi", "a"]


def test_sentences(spark):
    text = "  One two.  Three!\nno end"
    df = spark.createDataFrame([(7, text), (8, None)], "document_id long, text string")
    rows = sentences.process_documents(df).collect()
    assert [(r.text, r.start, r.end) for r in rows] == [("One two.", 2, 10), ("Three!", 12, 18), ("no end", 19, 25)]
    assert all(text[r.start : r.end] == r.text for r in rows)


def test_truncation(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x y"), (2, "a " * 900, "y " * 700)], "id long, first string, second string")
    rows = {r.id: r for r in prompts.truncate_first_only(df, 5).collect()}
    assert (rows[1].first, rows[1].second) == ("a b c", "x y")
    assert rows[1].cut and not rows[1].no_room
    # Nothing is lost without room; the flag says so.
    assert (rows[2].first, rows[2].second, rows[2].cut, rows[2].no_room) == ("a " * 900, "y " * 700, False, True)


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = [r.u for r in df.select(l2_normalize(F.col("v")).alias("u")).collect()]
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])


def test_log_loss_keeps_off_zero(spark):
    probs = spark.createDataFrame([(0, 1, "A", 0.0), (0, 2, "A", 1.0)], "model_id int, id long, letter string, prob double")
    answers = spark.createDataFrame([(1, "A"), (2, "A")], "id long, answer string")
    assert one(metrics.log_loss(probs, answers, ["model_id"])).log_loss == pytest.approx(-math.log(1e-15) / 2)


def test_best_variant_prefers_the_smaller_on_ties(spark):
    rows = [(v, 1, c, p) for v in (2, 1) for c, p in (("A", 0.7), ("B", 0.3))] + [(3, 1, "A", 0.6)]
    df = spark.createDataFrame(rows, "variant int, id long, letter string, prob double")
    assert {r.variant for r in metrics.best_context_variant(df).collect()} == {1}


def test_grid_has_every_vector_once(spark):
    grid = blend.with_weight_grid(spark.range(1), 4, 20).collect()
    vectors = {(r.w0, r.w1, r.w2, r.w3) for r in grid}
    assert len(grid) == len(vectors) == math.comb(23, 3)
    assert all(sum(v) == 20 and min(v) >= 0 for v in vectors)


def test_gradient_matches_a_finite_difference(spark):
    import random

    random.seed(1)
    rows = [(m, i, c, random.uniform(0.05, 0.4)) for m in (0, 1) for i in range(6) for c in "ABCDE"]
    answers = {i: "ABCDE"[i % 5] for i in range(6)}
    probs = spark.createDataFrame(rows, "model_id int, id long, letter string, prob double")
    right = spark.createDataFrame(list(answers.items()), "id long, answer string")

    def loss(w):
        cells = {}
        for m, i, c, p in rows:
            cells[i, c] = cells.get((i, c), 0) + w[m] * p
        return sum(-math.log(p) if answers[i] == c else -math.log(1 - p) for (i, c), p in cells.items()) / len(cells)

    got = {r.model_id: r.gradient for r in blend.blend_gradient(probs, right, {0: 0.7, 1: 0.3}).collect()}
    h = 1e-6
    assert got[0] == pytest.approx((loss([0.7 + h, 0.3]) - loss([0.7 - h, 0.3])) / (2 * h), rel=1e-5)
    assert got[1] == pytest.approx((loss([0.7, 0.3 + h]) - loss([0.7, 0.3 - h])) / (2 * h), rel=1e-5)


def test_mean_nll_skips_ignored_labels(spark):
    df = spark.createDataFrame(
        [([1, 2, -100, 4], [-1.0, -50.0, -3.0, -9.0]), ([5], [-1.0])], "labels array<int>, logprobs array<double>"
    )
    assert one(metrics.mean_nll(df)).mean_nll == 2.0


def test_wrong_row_count_fails(spark):
    df = spark.range(3)
    assert questions.checked_rows(df, 3).count() == 3
    with pytest.raises(Exception, match="expected 4 rows, found 3"):
        questions.checked_rows(df, 4).collect()
    with pytest.raises(Exception, match="expected 4 rows, found 0"):
        questions.checked_rows(df.filter("id > 5"), 4).collect()


def test_attach_is_one_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    good = spark.createDataFrame([(2, "q"), (1, "p")], "id long, y string")
    assert sorted(tuple(r) for r in questions.attach_by_id(left, good).collect()) == [(1, "a", "p"), (2, "b", "q")]
    for rows, message in (([(1, "p")], "no partner"), ([(1, "p"), (2, "q"), (3, "r")], "no partner"), ([(1, "p"), (2, "q"), (2, "r")], "duplicate id")):
        with pytest.raises(Exception, match=message):
            questions.attach_by_id(left, spark.createDataFrame(rows, "id long, y string")).collect()


def test_merged_sets_may_have_gaps_in_their_ids(spark):
    base = spark.range(3)
    gaps = spark.createDataFrame([(0,), (5,)], "id long")
    empty = spark.range(0)
    merged = questions.merge_question_sets(base, [gaps, empty, gaps])
    assert sorted(r.id for r in merged.collect()) == [0, 1, 2, 3, 8, 9, 14]
    assert [r.id for r in questions.shift_ids(empty, base).orderBy("id").collect()] == [0, 1, 2]


def test_registry_and_versions(spark):
    assert registry_frame(spark).count() == len(EXTRA_SETS) == 7
    with pytest.raises(ValueError):
        select_context_version(spark.range(1).withColumn("context_version", F.lit(1)), 5)


@pytest.mark.parametrize("test_size, n_valid", [(0, 0), (1, 101), (0.2, 21), (0.5, 51)])
def test_split_sizes(spark, test_size, n_valid):
    split = questions.seeded_split(spark.range(101), test_size)
    assert split.filter("split = 'valid'").count() == n_valid and split.count() == 101


@pytest.mark.parametrize("n_rows, n", [(10, 3), (3, 5), (12, 4), (1, 1)])
def test_shares(spark, n_rows, n):
    got = [r.share for r in questions.split_n(spark.range(n_rows), n).orderBy("id").collect()]
    sizes = [n_rows // n + (i < n_rows % n) for i in range(n)]
    assert got == [i + 1 for i, size in enumerate(sizes) for _ in range(size)]


def test_reports_count_every_answered_question(spark):
    from askframe.operators import metrics

    answers = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, answer string")
    rows = [("m", 1, "A", 1, 0.5), ("m", 2, "A", 1, 0.5), ("w", 2, "C", 1, 1.0)]
    ranked = spark.createDataFrame(rows, "model_id string, id long, letter string, rank int, prob double")
    got = {r.model_id: r for r in metrics.hits_report(ranked, answers, ["model_id"]).collect()}
    assert (got["m"].top1, got["m"].total, got["w"].top1, got["w"].total) == (1, 3, 0, 3)
    loss = {r.model_id: r.log_loss for r in metrics.log_loss(ranked, answers, ["model_id"]).collect()}
    floor = -math.log(1e-15)
    assert loss["m"] == pytest.approx((math.log(2) + 2 * floor) / 3) and loss["w"] == pytest.approx(floor)
    # Without keys there is one row, also for an empty table and without answers.
    mine = ranked.filter("model_id = 'm'")
    report = one(metrics.hits_report(mine, answers, []))
    assert (report.top1, report.total, report.map3_pct) == (1, 3, pytest.approx(100 / 3, abs=1e-6))
    assert one(metrics.log_loss(mine, answers, [])).log_loss == pytest.approx(loss["m"])
    none = ranked.filter("false")
    assert (one(metrics.hits_report(none, answers, [])).top1, one(metrics.hits_report(none, answers, [])).total) == (0, 3)
    assert one(metrics.log_loss(none, answers, [])).log_loss == pytest.approx(floor)
    assert one(metrics.hits_report(mine, answers.filter("false"), [])).map3_pct is None
    assert one(metrics.log_loss(mine, answers.filter("false"), [])).log_loss is None
    assert metrics.hits_report(none, answers, ["model_id"]).count() == 0
    rows = [("A", 0.5), ("B", 0.2), ("C", 0.1), ("D", 0.1), ("E", 0.1)]
    probs = spark.createDataFrame([(i, c, p) for i in (1, 2) for c, p in rows], "id long, letter string, prob double")
    from askframe.plans.answers import answer_report

    assert one(answer_report(probs, answers)).map3_pct == pytest.approx(50.0)


def test_a_state_saved_at_step_zero_has_an_epoch_of_no_number(spark):
    logs = spark.createDataFrame([("r", 0, 1.0, 0.5, 3.0, 0), ("s", 5, 1.0, 0.5, 3.0, 10)], "run_id string, step long, loss double, eval_loss double, epoch double, global_step long")
    curve = {(r.run_id, r.type): r.epoch for r in runs.learning_curve(logs).collect()}
    assert math.isnan(curve["r", "loss"]) and math.isnan(curve["r", "eval_loss"]) and curve["s", "loss"] == 1.5
    points = {(r.run_id, r.save_point): r.epoch for r in runs.saved_points(logs).collect()}
    assert math.isnan(points["r", "latest"]) and points["s", "best"] == 1.5
