"""Scoring and metrics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe.catalog import base
from askframe.catalog.base import MODELS, query, table
from askframe.functions.text import words
from askframe.operators import metrics, questions as ops, scoring
from askframe.operators.blend import blend as blend_models, blend_gradient as gradient_of
from askframe.plans.answers import answer_probabilities, answer_report

RANKED = "ranked as (select *, row_number() over (partition by model_id, id order by prob desc, letter)::int as rank from probs)"

SCORED_SQL = """
    long as (select id, context, prompt, 'A' as letter, A as answer_text from context_questions
      union all select id, context, prompt, 'B', B from context_questions union all select id, context, prompt, 'C', C from context_questions
      union all select id, context, prompt, 'D', D from context_questions union all select id, context, prompt, 'E', E from context_questions),
    logits as (select id, letter, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(context || ' ' || prompt, '[ \\n]+'), lambda x: x <> '')),
        list_distinct(list_filter(regexp_split_to_array(answer_text, '[ \\n]+'), lambda x: x <> '')))) / 10::double as yes_logit, 1.0::double as no_logit from long)"""

PROB_SQL = """
    yes as (select id, letter, 1.0::double / (1.0::double + exp(no_logit - yes_logit)) as y from logits),
    scored as (select id, letter, exp(y) / sum(exp(y)) over (partition by id) as prob from yes)"""


def scored_options(spark, sf):
    long = ops.unpivot_options(base.context_questions(spark, sf), with_context=True)
    return scoring.score_options(long.withColumn("text", F.concat_ws(" ", "context", "prompt")))


@query(SCORED_SQL + " select id, letter, yes_logit, no_logit from logits", "context_questions")
def score_options(spark, sf):
    return scored_options(spark, sf).select("id", "letter", "yes_logit", "no_logit")


@query(SCORED_SQL + "," + PROB_SQL + " select id, letter, round(y, 9) as yes_prob from yes", "context_questions")
def yes_probability(spark, sf):
    p = scoring.yes_probability(F.col("yes_logit"), F.col("no_logit"))
    return scored_options(spark, sf).select("id", "letter", F.round(p, 9).alias("yes_prob"))


@query(SCORED_SQL + "," + PROB_SQL + " select id, letter, round(prob, 9) as prob from scored", "context_questions")
def softmax_over_options(spark, sf):
    p = scoring.option_probabilities(scored_options(spark, sf), ["id"])
    return p.withColumn("prob", F.round("prob", 9))


@query("select model_id, id, letter, row_number() over (partition by model_id, id order by prob desc, letter)::int as rank from probs", "probs")
def rank_letters(spark, sf):
    return scoring.rank_letters(base.probs(spark, sf), ["model_id", "id"]).drop("prob")


TIED_SQL = "tied as (select model_id, id, letter, round(prob, 1) as prob from probs)"


@query(TIED_SQL + " select model_id, id, letter, row_number() over (partition by model_id, id order by prob desc, letter desc)::int as rank from tied", "probs")
def rank_letters_last_on_ties(spark, sf):
    tied = base.probs(spark, sf).withColumn("prob", F.round("prob", 1))
    return scoring.rank_letters(tied, ["model_id", "id"], "last").drop("prob")


@query("select model_id, id, string_agg(letter, ' ' order by prob desc, letter) as prediction from probs group by all", "probs")
def prediction_string(spark, sf):
    return scoring.prediction_string(base.probs(spark, sf), ["model_id", "id"])


@query(
    RANKED + """ select model_id, round(avg(case when rank <= 3 then 1.0::double / rank else 0 end), 9) as map_at_k
       from ranked r join answers a on a.id = r.id and a.answer = r.letter group by model_id""",
    "probs answers",
)
def map_at_3(spark, sf):
    pairs = scoring.predictions(base.probs(spark, sf), ["model_id", "id"]).join(base.answers(spark, sf), "id")
    scored = metrics.map_at_k(pairs.withColumn("actual", F.array("answer")), ["model_id"], 3)
    return scored.withColumn("map_at_k", F.round("map_at_k", 9))


AP_WORDS_SQL = r"""
    pred as (select item_id, p, list_distinct(list_filter(p, lambda w: length(w) % 2 = 0)) as a
             from (select item_id, regexp_extract_all(text, '[^ \n]+') as p from benchmark)),
    places as (select item_id, a, unnest(p) as w, unnest(range(1, len(p) + 1)) as i from pred),
    firsts as (select item_id, any_value(a) as a, w, min(i) as i from places group by item_id, w),
    hit as (select item_id, a, i, row_number() over (partition by item_id order by i) as n from firsts where list_contains(a, w) and i <= 10)
    select p.item_id, coalesce(round(sum(h.n / h.i::double) / least(len(any_value(p.a)), 10), 9), 0) as ap
    from pred p left join hit h on h.item_id = p.item_id group by p.item_id"""


@query(AP_WORDS_SQL)
def map_at_10_rows(spark, sf):
    """Several right items and repeated predictions: all words of a text against those of even length."""
    w = words(F.col("text"))
    even = F.array_distinct(F.filter(w, lambda x: F.length(x) % 2 == 0))
    rows = table(spark, sf, "benchmark").select("item_id", w.alias("predicted"), even.alias("actual"))
    scored = metrics.map_at_k(rows, [], 10, reduction=None)
    return scored.select("item_id", F.round("ap", 9).alias("ap"))


REPORT_SQL = """sum((rank = 1)::int)::bigint as top1, sum((rank = 2)::int)::bigint as top2, sum((rank = 3)::int)::bigint as top3, count(*) as total,
    round(100.0::double * sum((rank = 1)::int) / count(*), 6) as accuracy_pct,
    round(100.0::double * (sum((rank = 1)::int) + sum((rank = 2)::int) / 2::double + sum((rank = 3)::int) / 3::double) / count(*), 6) as map3_pct"""


@query(
    # The prompt holds the whole option, so the words they share are the option's own.
    f"""long as (unpivot context_questions on A, B, C, D, E into name letter value answer_text),
    logits as (select id, letter, len(list_distinct(regexp_extract_all(answer_text, '{base.WORD_SQL}'))) / 10::double as yes_logit,
           1.0::double as no_logit from long),"""
    + PROB_SQL
    + f""", ranked as (select id, letter, row_number() over (partition by id order by prob desc, letter) as rank from scored)
         select {REPORT_SQL} from ranked r join context_questions a on a.id = r.id and a.answer = r.letter""",
    "context_questions",
)
def answered_questions(spark, sf):
    """Prompt, score and judge in one flow."""
    asked = base.context_questions(spark, sf)
    return answer_report(answer_probabilities(asked, word_limit=200), asked.select("id", "answer"))


@query(RANKED + f" select model_id, {REPORT_SQL} from ranked r join answers a on a.id = r.id and a.answer = r.letter group by model_id", "probs answers")
def hits_report(spark, sf):
    return answer_report(base.probs(spark, sf), base.answers(spark, sf), ["model_id"])


@query(
    RANKED + f""", subsets as (select *, 'all' as subset from ranked union all
         select *, 'first_n' from ranked where id in (select id from answers order by id limit 20))
       select model_id, subset, {REPORT_SQL} from subsets r join answers a on a.id = r.id and a.answer = r.letter group by model_id, subset""",
    "probs answers",
)
def report_first_and_all(spark, sf):
    flagged = ops.first_n_flag(base.probs(spark, sf), 20)
    ranked = scoring.rank_letters(flagged, ["model_id", "id"])
    return metrics.report_first_and_all(ranked, base.answers(spark, sf), ["model_id"])


@query(
    """select model_id, round(avg(-ln(least(greatest(prob, 1e-15), 1 - 1e-15))), 9) as log_loss
       from probs p join answers a on a.id = p.id and a.answer = p.letter group by model_id""",
    "probs answers",
)
def log_loss(spark, sf):
    loss = metrics.log_loss(base.probs(spark, sf), base.answers(spark, sf), ["model_id"])
    return loss.withColumn("log_loss", F.round("log_loss", 9))


@query(
    "select a.model_id as model_a, b.model_id as model_b, round(corr(a.prob, b.prob), 9) as corr from probs a join probs b "
    "on a.id = b.id and a.letter = b.letter group by all",
    "probs",
)
def model_correlation(spark, sf):
    return metrics.model_correlation(base.probs(spark, sf), MODELS).withColumn("corr", F.round("corr", 9))


WEIGHTS_SQL = RANKED + """,
    weights as (select model_id, avg((rank = 1)::int) as weight from ranked r join answers a on a.id = r.id and a.answer = r.letter group by model_id)"""


def accuracy_weights(spark, sf):
    report = answer_report(base.probs(spark, sf), base.answers(spark, sf), ["model_id"])
    return report.select("model_id", (F.col("top1") / F.col("total")).alias("weight"))


@query(WEIGHTS_SQL + " select id, letter, round(sum(weight * prob) / sum(weight), 9) as prob from probs join weights using (model_id) group by all", "probs answers")
def blend(spark, sf):
    return blend_models(base.probs(spark, sf), accuracy_weights(spark, sf)).withColumn("prob", F.round("prob", 9))


@query(WEIGHTS_SQL + " select id, letter, round(sum(weight * prob), 9) as prob from probs join weights using (model_id) group by all", "probs answers")
def blend_plain_sum(spark, sf):
    return blend_models(base.probs(spark, sf), accuracy_weights(spark, sf), False).withColumn("prob", F.round("prob", 9))


@query(
    """b as (select *, case model_id when 0 then 0.4::double when 1 then 0.3::double when 2 then 0.2::double else 0.1::double end as w from probs),
       p as (select id, letter, sum(w * prob) as p from b group by all)
       select model_id, round(-avg(b.prob * ((letter = answer)::int - p) / (p * (1 - p))), 9) as gradient
       from b join p using (id, letter) join answers using (id) group by model_id""",
    "probs answers",
)
def blend_gradient(spark, sf):
    weights = {0: 0.4, 1: 0.3, 2: 0.2, 3: 0.1}
    return gradient_of(base.probs(spark, sf), base.answers(spark, sf), weights).withColumn("gradient", F.round("gradient", 9))


@query(
    r"""toks as (select item_id, regexp_extract_all(text, '[^ \n]+') as t from benchmark),
        rows as (select item_id, unnest(t) as w, unnest(range(1, len(t) + 1)) as i from toks),
        shifted as (select item_id, i, length(w) as len_now, lead(case when length(w) < 3 then -100 else length(w) end) over (partition by item_id order by i) as label from rows),
        seqs as (select item_id, avg(len_now / 10::double) filter (label <> -100) as nll from shifted group by item_id)
        select round(avg(nll), 9) as mean_nll from seqs"""
)
def mean_nll(spark, sf):
    """Words as tokens: short words are ignored labels, the log-probability is minus a tenth of the length."""
    w = words(F.col("text"))
    length = F.transform(w, F.length)
    seqs = table(spark, sf, "benchmark").select(
        F.transform(length, lambda n: F.when(n < 3, -100).otherwise(n)).alias("labels"),
        F.transform(length, lambda n: -n / F.lit(10.0)).alias("logprobs"),
    )
    return metrics.mean_nll(seqs).withColumn("mean_nll", F.round("mean_nll", 9))


@query(
    """peaks as (select id, model_id, max(prob) as peak from probs group by all),
       best as (select id, model_id from peaks qualify row_number() over (partition by id order by peak desc, model_id) = 1)
       select id, model_id as variant, letter, round(prob, 9) as prob from probs join best using (id, model_id)""",
    "probs",
)
def best_context_variant(spark, sf):
    runs = base.probs(spark, sf).withColumnRenamed("model_id", "variant")
    return metrics.best_context_variant(runs).withColumn("prob", F.round("prob", 9))
