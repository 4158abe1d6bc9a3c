"""Weight search on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe.catalog import base
from askframe.catalog.answers import WEIGHTS_SQL, accuracy_weights
from askframe.catalog.base import MODELS, query
from askframe.operators import blend

def grid_sql(steps: int) -> str:
    return f"""
    parts as (select unnest(range({steps} + 1)) as w),
    grid as (select a.w as w0, b.w as w1, c.w as w2, {steps} - a.w - b.w - c.w as w3
             from parts a, parts b, parts c where a.w + b.w + c.w <= {steps})"""


GRID_SQL = grid_sql(20)


def scores_sql(grid: str, steps: int, out: str) -> str:
    values = ", ".join(
        f"floor((w0 * p0_{c} + w1 * p1_{c} + w2 * p2_{c} + w3 * p3_{c}) * (1e9::double / {steps}) + 0.5::double) as v_{c}" for c in "ABCDE"
    )
    picks = ", ".join(f"max(prob) filter (model_id = {m} and letter = '{c}') as p{m}_{c}" for m in MODELS for c in "ABCDE")
    right = "case answer " + " ".join(f"when '{c}' then v_{c}" for c in "ABCDE") + " end"
    rank = " + ".join(f"(v_{c} > r or (v_{c} = r and '{c}' < answer))::int" for c in "ABCDE")
    return f"""
      {out}_q as (select id, {picks} from probs group by id),
      {out}_v as (select w0, w1, w2, w3, answer, {values} from {grid} cross join {out}_q join answers using (id)),
      {out}_r as (select *, {right} as r from {out}_v),
      {out}_k as (select w0, w1, w2, w3, 1 + {rank} as k from {out}_r),
      {out} as (select w0, w1, w2, w3, (sum((k = 1)::int) + sum((k = 2)::int) / 2::double + sum((k = 3)::int) / 3::double) / count(*) as map3
               from {out}_k group by all)"""


AS_INT = ", ".join(f"cast(w{i} as int) as w{i}" for i in range(4))


@query(
    WEIGHTS_SQL + "," + GRID_SQL
    + """, acc as (select max(weight) filter (model_id = 0) as a0, max(weight) filter (model_id = 1) as a1,
            max(weight) filter (model_id = 2) as a2, max(weight) filter (model_id = 3) as a3 from weights)
         select """ + AS_INT + ", round((w0 * a0 + w1 * a1 + w2 * a2 + w3 * a3) / 20::double, 9) as mean_accuracy from grid cross join acc",
    "probs answers",
)
def weight_grid(spark, sf):
    """Every weight vector, with the weighted mean of the models' accuracies."""
    weights = accuracy_weights(spark, sf)
    acc = weights.agg(*[F.max(F.when(F.col("model_id") == m, F.col("weight"))).alias(f"a{m}") for m in MODELS])
    grid = blend.with_weight_grid(acc, len(MODELS), 20)
    total = sum((F.col(f"w{m}") * F.col(f"a{m}") for m in MODELS[1:]), F.col("w0") * F.col("a0"))
    return grid.select(*blend.weight_columns(4), F.round(total / 20.0, 9).alias("mean_accuracy"))


@query(GRID_SQL + "," + scores_sql("grid", 20, "scores") + f" select {AS_INT}, round(map3, 9) as map3 from scores", "probs answers")
def grid_scores(spark, sf):
    scores = blend.grid_scores(base.probs(spark, sf), base.answers(spark, sf), MODELS, 20)
    return scores.withColumn("map3", F.round("map3", 9))


@query(grid_sql(100) + "," + scores_sql("grid", 100, "scores") + f" select {AS_INT}, round(map3, 9) as map3 from scores", "probs answers")
def grid_scores_percent(spark, sf):
    """All 176,851 vectors of whole percents over four models."""
    scores = blend.grid_scores(base.probs(spark, sf), base.answers(spark, sf), MODELS, 100)
    return scores.withColumn("map3", F.round("map3", 9))


TOP_SQL = GRID_SQL + "," + scores_sql("grid", 20, "scores") + ", best as (select * from scores order by map3 desc, w0, w1, w2, w3 limit 3)"


@query(TOP_SQL + f" select {AS_INT}, round(map3, 9) as map3 from best", "probs answers")
def top_weights(spark, sf):
    scores = blend.grid_scores(base.probs(spark, sf), base.answers(spark, sf), MODELS, 20)
    return blend.top_weights(scores, 4).withColumn("map3", F.round("map3", 9))


FINE_SQL = """, shifts as (select unnest(range(-5, 6)) as s),
    near as (select w0 * 5 + a.s as w0, w1 * 5 + b.s as w1, w2 * 5 + c.s as w2 from best, shifts a, shifts b, shifts c),
    fine as (select distinct w0, w1, w2, 100 - w0 - w1 - w2 as w3 from near
             where w0 between 0 and 100 and w1 between 0 and 100 and w2 between 0 and 100 and w0 + w1 + w2 <= 100), """


@query(TOP_SQL + FINE_SQL + scores_sql("fine", 100, "refined") + f" select {AS_INT}, round(map3, 9) as map3 from refined", "probs answers")
def refine_weights(spark, sf):
    p, a = base.probs(spark, sf), base.answers(spark, sf)
    start = blend.top_weights(blend.grid_scores(p, a, MODELS, 20), 4)
    return blend.refine_weights(p, a, MODELS, start).withColumn("map3", F.round("map3", 9))


@query(
    WEIGHTS_SQL
    + """, shares as (select model_id, round(weight / (select sum(weight) from weights) * 1000) as w from weights),
         rounded as (select """
    + ", ".join(f"max(w) filter (model_id = {m}) as w{m}" for m in MODELS)
    + " from shares), "
    + scores_sql("rounded", 1000, "scores")
    + f" select {AS_INT}, round(map3, 9) as map3 from scores",
    "probs answers",
)
def round_weights(spark, sf):
    weights = accuracy_weights(spark, sf)
    share = [F.max(F.when(F.col("model_id") == m, F.col("weight"))) / F.sum("weight") for m in MODELS]
    row = weights.agg(*[s.alias(f"w{m}") for m, s in zip(MODELS, share)])
    scored = blend.round_weights(base.probs(spark, sf), base.answers(spark, sf), MODELS, row)
    return scored.withColumn("map3", F.round("map3", 9))


@query(
    """qs as (select id, answer, letter, max(prob) filter (model_id = 0) as p0, max(prob) filter (model_id = 1) as p1,
         max(prob) filter (model_id = 2) as p2, max(prob) filter (model_id = 3) as p3 from probs join answers using (id) group by all),
       lines as (select id, letter, answer, 0.4::double * p0 + 0.3::double * p1 + 0.2::double * p2 + 0.1::double * p3 as a, p2 as b from qs),
       rel as (select l.id, l.letter, l.answer, l.a - r.a as da, l.b - r.b as db from lines l join lines r on r.id = l.id and r.letter = r.answer
         where l.letter <> l.answer),
       cuts as (select 0::double as t union select round(da / (da - db), 12) from rel where da * db < 0),
       spans as (select t as t_low, coalesce(lead(t) over (order by t), 1::double) as t_high from cuts),
       mids as (select *, (t_low + t_high) / 2 as t from spans where t_low < t_high),
       ranks as (select t_low, t_high, id, 1 + sum(((1 - t) * da + t * db > 0)::int) as k from mids cross join rel group by all)
       select round(t_low, 9) as t_low, round(t_high, 9) as t_high,
         round(avg(case k when 1 then 1::double when 2 then 1 / 2::double when 3 then 1 / 3::double else 0 end), 9) as map3
       from ranks group by t_low, t_high""",
    "probs answers",
)
def line_scores(spark, sf):
    """MAP@3 along the whole way from a blend to one model."""
    found = blend.line_scores(base.probs(spark, sf), base.answers(spark, sf), MODELS, [4, 3, 2, 1], 2)
    return found.select(*[F.round(c, 9).alias(c) for c in ("t_low", "t_high", "map3")])
