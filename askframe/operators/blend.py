"""Blending models: weighted averages, gradients and weight search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askframe.cluster import spread, stored, with_row_index, with_running_total
from askframe.fixed_values import LETTERS
from askframe.operators.metrics import PROB_FLOOR, wide_models

# A block of blended values holds 4,096 x 64 x 5 numbers; so many vectors travel at a time.
BLOCK_VECTORS, BLOCK_QUESTIONS, MANY_VECTORS = 4_096, 64, 200_000


def blend(probs: DataFrame, weights: DataFrame, normalised: bool = True) -> DataFrame:
    """Weighted probability per ``(id, letter)``: divided by the weights' sum, or the plain sum.

    The few ``(model_id, weight)`` rows travel as one map, so no probability
    row is shuffled on the handful of model keys.  Models without a weight are
    left out.
    """
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("model_id", "weight")))).scalar()
    joined = probs.withColumn("weight", F.try_element_at(table, F.col("model_id"))).filter(F.col("weight").isNotNull())
    weighted = F.sum(F.col("weight") * F.col("prob"))
    value = weighted / F.sum("weight") if normalised else weighted
    return joined.groupBy("id", "letter").agg(value.alias("prob"))


def blend_gradient(probs: DataFrame, answers: DataFrame, weights: dict) -> DataFrame:
    """Derivative of the mean binary log-loss by each model's weight."""
    models = list(weights)
    cells = wide_models(probs, models).join(answers.select("id", "answer"), "id")
    clipped = [F.least(F.greatest(F.col(f"p{i}"), F.lit(PROB_FLOOR)), F.lit(1 - PROB_FLOOR)) for i in range(len(models))]
    cells = cells.select(
        (F.col("letter") == F.col("answer")).cast("double").alias("a"), *[c.alias(f"b{i}") for i, c in enumerate(clipped)]
    )
    p = F.lit(0.0)
    for i, m in enumerate(models):
        p = p + F.lit(float(weights[m])) * F.col(f"b{i}")
    cells = cells.withColumn("p", p)
    slope = (F.col("a") - F.col("p")) / (F.col("p") * (1 - F.col("p")))
    one_row = cells.agg(*[(-F.avg(F.col(f"b{i}") * slope)).alias(f"g{i}") for i in range(len(models))])
    return one_row.select(
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"g{i}").alias("gradient")) for i, m in enumerate(models)])
        )
    )


def weight_columns(n_models: int) -> list[str]:
    return [f"w{i}" for i in range(n_models)]


def with_weight_grid(df: DataFrame, n_models: int, steps: int) -> DataFrame:
    """Every weight vector of whole parts adding up to ``steps``, for each row of ``df``.

    Each axis runs only over what the axes before it leave, so no vector with a
    wrong sum is ever made and none is lost to rounding.
    """
    left: Column = F.lit(steps)
    for i in range(n_models - 1):
        df = df.withColumn(f"w{i}", F.explode(F.sequence(F.lit(0), left)))
        left = left - F.col(f"w{i}")
    return df.withColumn(f"w{n_models - 1}", left)


def question_rows(probs: DataFrame, answers: DataFrame, models: list) -> DataFrame:
    """One row per question: answer letter and probabilities ``p_<model>_<letter>``."""
    picks = [
        F.max(F.when((F.col("model_id") == m) & (F.col("letter") == c), F.col("prob"))).alias(f"p_{i}_{c}")
        for i, m in enumerate(models)
        for c in LETTERS
    ]
    rows = spread(probs, "id").groupBy("id").agg(*picks)
    return rows.join(answers.select("id", "answer"), "id")


def grid_vectors(n_models: int, steps: int) -> Iterator[np.ndarray]:
    """The vectors of ``with_weight_grid`` as matrices, the last three axes at a time."""

    def parts(left: int, axes: int) -> np.ndarray:
        if axes == 1:
            return np.array([[left]])
        return np.concatenate([np.insert(parts(left - w, axes - 1), 0, w, axis=1) for w in range(left + 1)])

    def walk(head: list[int], left: int, axes: int) -> Iterator[np.ndarray]:
        if axes <= 3:
            tail = parts(left, axes)
            yield np.hstack([np.tile(np.array(head, np.int64), (len(tail), 1)), tail])
        else:
            for w in range(left + 1):
                yield from walk([*head, w], left - w, axes - 1)

    yield from walk([], steps, n_models)


def rank_counts(vectors: np.ndarray, p: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """For each weight vector the questions whose right letter stands first, second and third.

    ``p`` is questions x letters x models.  Blended values are compared as
    whole billionths, so equal options tie the same way everywhere.
    """
    out = np.zeros((len(vectors), 3), np.int64)
    letters = np.arange(p.shape[1])
    for v in range(0, len(vectors), BLOCK_VECTORS):
        w = vectors[v : v + BLOCK_VECTORS].astype(np.float64)
        for q in range(0, len(p), BLOCK_QUESTIONS):
            block, answer = p[q : q + BLOCK_QUESTIONS], right[q : q + BLOCK_QUESTIONS]
            # Sums run over the models in turn, the same in every engine.
            total = np.zeros((len(w), *block.shape[:2]))
            for m in range(p.shape[2]):
                total += w[:, m, None, None] * block[None, :, :, m]
            value = np.floor(total * (1e9 / steps) + 0.5)
            own = np.take_along_axis(value, np.broadcast_to(answer[None, :, None], (len(w), len(block), 1)), axis=2)
            ahead = (value > own) | ((value == own) & (letters < answer[:, None])[None])
            rank = ahead.sum(axis=2)
            for r in range(3):
                out[v : v + BLOCK_VECTORS, r] += (rank == r).sum(axis=1)
    return out


def _tables(batches: Iterator[pa.RecordBatch], n_models: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Probabilities and right letters of a task's questions that have all of them, and the number of all its questions."""
    p, right, n = [], [], 0
    for batch in batches:
        n += batch.num_rows
        values = [batch.column(f"p_{i}_{c}").to_numpy(zero_copy_only=False).astype(np.float64) for c in LETTERS for i in range(n_models)]
        p.append(np.stack(values, axis=1).reshape(batch.num_rows, len(LETTERS), n_models))
        right.append(np.array([LETTERS.index(a) if a in LETTERS else -1 for a in batch.column("answer").to_pylist()], np.int64))
    if not p:
        return np.empty((0, len(LETTERS), n_models)), np.empty(0, np.int64), 0
    p, right = np.concatenate(p), np.concatenate(right)
    whole = ~np.isnan(p).any(axis=(1, 2)) & (right >= 0)
    return p[whole], right[whole], n


def _vector_scores(rows: DataFrame, n_models: int, steps: int, vectors: np.ndarray | None = None) -> DataFrame:
    """Hits of each weight vector, of the grid or of ``vectors``, as one row a vector and task.

    Questions and vectors meet only in blocks of numbers inside a task.
    """
    cols = weight_columns(n_models)
    shared = None if vectors is None else rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, right, n = _tables(batches, n_models)
        if not n:
            return
        for w in grid_vectors(n_models, steps) if shared is None else [shared.value]:
            hits = rank_counts(w, p, right, steps)
            columns = [pa.array(w[:, i].astype(np.int32)) for i in range(n_models)]
            columns += [pa.array(hits[:, r]) for r in range(3)] + [pa.array(np.full(len(w), n, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*cols, "n1", "n2", "n3", "n"])

    schema = ", ".join(f"{c} int" for c in cols) + ", n1 long, n2 long, n3 long, n long"
    picks = [f"p_{i}_{c}" for c in LETTERS for i in range(n_models)]
    return rows.select("answer", *picks).mapInArrow(run, schema)


def _map3(hits: DataFrame, n_models: int) -> DataFrame:
    cols = weight_columns(n_models)
    total = hits.groupBy(*cols).agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n")])
    return total.select(*cols, ((F.col("n1") + F.col("n2") / 2 + F.col("n3") / 3) / F.col("n")).alias("map3"))


def grid_scores(probs: DataFrame, answers: DataFrame, models: list, steps: int = 100) -> DataFrame:
    """MAP@3 of every weight vector on the grid; weights are in ``1/steps`` parts."""
    return _map3(_vector_scores(question_rows(probs, answers, models), len(models), steps), len(models))


def score_weights(probs: DataFrame, answers: DataFrame, models: list, vectors: DataFrame, steps: int) -> DataFrame:
    """MAP@3 of given weight vectors ``w0..`` in ``1/steps`` parts, each once.

    The vectors go to the tasks in blocks of about ``MANY_VECTORS``.
    """
    cols = weight_columns(len(models))
    given = stored(vectors.select(*[F.col(c).cast("int").alias(c) for c in cols]).distinct(), "weights")
    rows, blocks, found = question_rows(probs, answers, models), max(1, -(-given.count() // MANY_VECTORS)), None
    if blocks > 1:
        rows = stored(rows, "question-rows")
    for b in range(blocks):
        table = given.filter(F.pmod(F.xxhash64(*cols), F.lit(blocks)) == b).toArrow()
        block = np.stack([table.column(c).to_numpy() for c in cols], axis=1).astype(np.int64)
        part = _vector_scores(rows, len(models), steps, block)
        found = part if found is None else found.union(part)
    return _map3(found, len(models))


def _crossings(p: np.ndarray, right: np.ndarray, w: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where moving from ``w`` towards one model changes a question's rank: ``(t, change of gain)``, and the gains just after 0.

    Gains are in sixths: 6, 3 and 2 for ranks 1 to 3.
    """
    rows = np.arange(len(p))
    start = p @ w
    start, end = start - start[rows, right][:, None], p[:, :, axis] - p[rows, right, axis][:, None]
    first = np.arange(p.shape[1])[None] < right[:, None]
    # Before and after its crossing an option is ahead by its sign there; level all the way, by its letter.
    before = np.where(start == 0, np.where(end == 0, first, end > 0), start > 0)
    after = np.where(end == 0, np.where(start == 0, first, start > 0), end > 0)
    before[rows, right] = after[rows, right] = False
    crosses = (before != after) & (start * end < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where(crosses, start / (start - end), np.inf)
    gain = np.array([6, 3, 2, 0, 0])

    def ahead(t: np.ndarray, later: bool) -> np.ndarray:
        passed = (at <= t[:, None]) if later else (at < t[:, None])
        return np.where(passed, after, before).sum(axis=1)

    ts, changes = [], []
    for c in range(p.shape[1]):
        # Crossings at the same point of one question count once, together.
        new = crosses[:, c] & ~(at[:, :c] == at[:, c, None]).any(axis=1)
        t = np.where(new, at[:, c], 0.0)
        ts.append(t[new])
        changes.append((gain[ahead(t, True)] - gain[ahead(t, False)])[new])
    return np.concatenate(ts), np.concatenate(changes), gain[before.sum(axis=1)]


def line_scores(probs: DataFrame, answers: DataFrame, models: list, weights: list[float], axis: int) -> DataFrame:
    """``(t_low, t_high, map3)``: MAP@3 of ``(1 - t) * weights + t * axis`` for all t between 0 and 1.

    Along the way MAP@3 changes only where an option passes the right one, so
    it is constant between the returned bounds and nothing lies between grid
    points unseen.  Tasks hand on one row a distinct change; the changes are
    summed up in their order over range partitions.
    """
    w = np.array(weights, np.float64) / sum(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, right, n = _tables(batches, len(models))
        t, change, base = _crossings(p, right, w, axis)
        # The row at 0 carries the gains there, and the number of questions.
        columns = [np.r_[0.0, t], np.r_[base.sum(), change].astype(np.int64), np.r_[n, np.zeros(len(t), np.int64)].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "gain", "n"])

    picks = [f"p_{i}_{c}" for c in LETTERS for i in range(len(models))]
    rows = question_rows(probs, answers, models).select("answer", *picks).mapInArrow(run, "t double, gain long, n long")
    # Crossings closer than rounding can tell apart are one.
    events = stored(rows.groupBy(F.round("t", 12).alias("t")).agg(F.sum("gain").alias("gain"), F.sum("n").alias("n")), "crossings")
    n = events.agg(F.sum("n")).scalar()
    summed = with_running_total(events.select("t", "gain"), [F.col("t")], F.col("gain"), "total")
    # Every stretch ends where the next begins; the next one is looked up by its number.
    placed = with_row_index(summed, [F.col("t")], "i")
    ends = placed.select((F.col("i") - 1).alias("i"), F.col("t").alias("t_high"))
    found = placed.join(ends, "i", "left").select(F.col("t").alias("t_low"), F.coalesce("t_high", F.lit(1.0)).alias("t_high"), F.try_divide(F.col("total") / 6, n).alias("map3"))
    return found.filter(F.col("t_low") < F.col("t_high"))


def line_search(probs: DataFrame, answers: DataFrame, models: list, weights: list[float], axis: int) -> tuple[list[float], float]:
    """The middle of the best stretch towards one model, and its MAP@3; equal ones go by the shorter way."""
    best = line_scores(probs, answers, models, weights, axis).orderBy(F.desc("map3"), "t_low").first()
    if best is None or best["map3"] is None:
        return list(weights), float("nan")
    t, total = (best["t_low"] + best["t_high"]) / 2, sum(weights)
    return [(1 - t) * x / total + t * (i == axis) for i, x in enumerate(weights)], best["map3"]


def ascend(probs: DataFrame, answers: DataFrame, models: list, weights: list[float], rounds: int = 2) -> tuple[list[float], float]:
    """Exact line searches towards each model in turn, kept where they gain, until a round gains nothing."""
    probs, answers = stored(probs.select("model_id", "id", "letter", "prob"), "probs"), stored(answers.select("id", "answer"), "answers")
    best = -1.0
    for _ in range(rounds):
        before = best
        for axis in range(len(models)):
            found, score = line_search(probs, answers, models, weights, axis)
            if score > best:
                weights, best = found, score
        if best == before:
            break
    return weights, best


def top_weights(scores: DataFrame, n_models: int, n: int = 3) -> DataFrame:
    """Best ``n`` weight vectors; equal scores go by the weights themselves."""
    return scores.orderBy(F.desc("map3"), *weight_columns(n_models)).limit(n)


def refine_weights(
    probs: DataFrame, answers: DataFrame, models: list, start: DataFrame, steps: int = 20, factor: int = 5
) -> DataFrame:
    """Search a finer grid of ``1/(steps*factor)`` parts one coarse step around each start vector."""
    m = len(models)
    fine = steps * factor
    around = start.select(*[(F.col(c) * factor).alias(c) for c in weight_columns(m)])
    left: Column = F.lit(fine)
    for i in range(m - 1):
        low = F.greatest(F.col(f"w{i}") - factor, F.lit(0))
        high = F.least(F.col(f"w{i}") + factor, F.lit(fine))
        around = around.withColumn(f"_v{i}", F.explode(F.sequence(low, high)))
        left = left - F.col(f"_v{i}")
    vectors = (
        around.withColumn(f"_v{m - 1}", left)
        .filter(F.col(f"_v{m - 1}") >= 0)
        .select(*[F.col(f"_v{i}").alias(f"w{i}") for i in range(m)])
        .distinct()
    )
    return score_weights(probs, answers, models, vectors, fine)


def round_weights(probs: DataFrame, answers: DataFrame, models: list, weights: DataFrame, places: int = 3) -> DataFrame:
    """Score weights (fractions ``w0..``) after rounding them to ``places`` decimals."""
    scale = 10**places
    cols = weight_columns(len(models))
    whole = weights.select(*[F.round(F.col(c) * scale).cast("int").alias(c) for c in cols])
    return score_weights(probs, answers, models, whole, scale)
