"""Registration of queries, and the input views both engines derive from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.cluster import parallel_scan
from askframe.fixed_values import LETTERS
from askframe.functions.letters import ALPHABET

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

MODELS = [0, 1, 2, 3]


def query(sql: str | None = None, views: str = ""):
    """Register a query under its function's name, with SQL over the named views."""

    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = with_views(views, sql)
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def with_views(views: str, sql: str) -> str:
    """Put the named views, and those they use, in front of ``sql`` as common table expressions.

    ``sql`` may go on with expressions of its own before its ``select``.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _USES.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    ctes = ", ".join(f"{name} as ({VIEWS[name]})" for name in ordered)
    own = not sql.strip().lower().startswith("select")
    if not ctes:
        return f"with {sql}" if own else sql
    return f"with {ctes}, {sql}" if own else f"with {ctes} {sql}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- views -----------------------------------------------------------------

WORD_SQL = r"[^\s\p{Z}\x0B\x85\x1C-\x1F]+"
TOKEN_SQL = r"""[\p{L}\p{N}_](?:[\p{L}\p{N}_/.\-]*[\p{L}\p{N}_])?|[!/?"'']"""


def words_sql(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '{WORD_SQL}'))"


VIEWS = {
    "questions": """
        select item_id as id, rtrim(substr(text, 1, length(text) - length(regexp_extract(text, '([^ ]+ ){0,7}[^ ]+$', 0))), ' ') as prompt,
          max(case when k = 0 then opt end) as A, max(case when k = 1 then opt end) as B,
          max(case when k = 2 then opt end) as C, max(case when k = 3 then opt end) as D,
          max(case when k = 4 then opt end) as E,
          substr('ABCDE', cast(item_id % 5 as int) + 1, 1) as answer,
          'T' || cast(item_id % 7 as varchar) as page_title
        from (select b.item_id, b.text, k.k, o.opt
              from benchmark b cross join (select count(*) as n from benchmark) n
              cross join (values (0), (1), (2), (3), (4)) as k(k)
              join (select item_id, regexp_extract(text, '([^ ]+ ){0,7}[^ ]+$', 0) as opt from benchmark) o
                on o.item_id = (b.item_id + (k.k - b.item_id % 5 + 5) % 5) % n.n)
        group by item_id, text""",
    "answers": "select item_id as id, substr('ABCDE', cast(item_id % 5 as int) + 1, 1) as answer from benchmark",
    "probs": """
        select m as model_id, id, substr('ABCDE', cast(k as int) + 1, 1) as letter,
          cast(raw as double) / sum(raw) over (partition by m, id) as prob
        from (select b.item_id as id, m.m, k.k,
                (b.item_id * 31 + m.m * 17 + k.k * 7) % 101 + 1
                  + case when k.k = b.item_id % 5 then 30 else 0 end as raw
              from benchmark b cross join (values (0), (1), (2), (3)) as m(m)
              cross join (values (0), (1), (2), (3), (4)) as k(k))""",
    "paragraphs": """
        select doc_id as article_id, 'T' || cast(doc_id // 4 as varchar) as title, source as section,
          text, lang as file, n_chars as views from documents""",
    "contexts": """
        select doc_id // 3 as id, cast(doc_id % 3 + 1 as int) as rank, text from documents""",
    "context_questions": """
        select d.doc_id as id, q.prompt, d.text as context, q.A, q.B, q.C, q.D, q.E, q.answer
        from documents d join questions q on q.id = d.doc_id % (select count(*) from benchmark)""",
    "options": """
        select id, prompt, answer, 'A' as letter, A as answer_text from questions
        union all select id, prompt, answer, 'B', B from questions
        union all select id, prompt, answer, 'C', C from questions
        union all select id, prompt, answer, 'D', D from questions
        union all select id, prompt, answer, 'E', E from questions""",
    "turn_vectors": """
        select c.conv_id, 'C' || cast(c.conv_id as varchar) as title, c.turn as paragraph_id, e.embedding as emb
        from conversations c join embeddings e on e.vec_id = c.conv_id""",
    "vector_docs": """
        select vec_id as article_id, 'T' || cast(vec_id as varchar) as title, embedding as emb,
          cast(label as int) as cluster_id from embeddings""",
    "seed_titles": "select 'T' || cast(doc_id as varchar) as title from labels where quality = 1",
    "known_titles": "select 'T' || cast(doc_id as varchar) as title from labels where toxic = 1",
    "polls": "select distinct date_trunc('hour', ts) as snapshot_ts, user_id as ref from events",
    "run_logs": """
        select cast(user_id as varchar) as run_id, event_id as step, value as loss,
          case when event_id % 5 = 0 then value * 0.9::double end as eval_loss,
          case when event_id % 5 = 0 then (value % 10::double) / 10::double end as eval_map
        from events""",
    "run_facts": "select run_id, 3.0::double as epoch, max(step) as global_step from run_logs group by run_id",
}

_USES = {
    "context_questions": ["questions"],
    "options": ["questions"],
    "run_facts": ["run_logs"],
}


def millionths(vector: str):
    """Vector entries as whole millionths, so that both engines print them alike."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1e6 + 0.5).cast("string"))


def letter_of(index):
    return F.substring(F.lit(ALPHABET), index.cast("int") + 1, F.lit(1))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    n = b.agg(F.count("*")).scalar()
    tails = b.select(F.col("item_id").alias("tail_id"), F.regexp_extract("text", "([^ ]+ ){0,7}[^ ]+$", 0).alias("opt"))
    tail = F.length(F.regexp_extract("text", "([^ ]+ ){0,7}[^ ]+$", 0))
    prompt = F.rtrim(F.substring(F.col("text"), F.lit(1), F.length("text") - tail), F.lit(" "))
    slots = b.select("item_id", prompt.alias("prompt"), F.posexplode(F.array(*map(F.lit, LETTERS))).alias("k", "letter"))
    slots = slots.withColumn("tail_id", (F.col("item_id") + (F.col("k") - F.col("item_id") % 5 + 5) % 5) % n)
    wide = (
        slots.join(tails, "tail_id")
        .groupBy("item_id")
        .agg(F.any_value("prompt").alias("prompt"), *[F.max(F.when(F.col("letter") == c, F.col("opt"))).alias(c) for c in LETTERS])
    )
    return wide.select(
        F.col("item_id").alias("id"),
        "prompt",
        *LETTERS,
        letter_of(F.col("item_id") % 5).alias("answer"),
        F.concat(F.lit("T"), (F.col("item_id") % 7).cast("string")).alias("page_title"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), letter_of(F.col("item_id") % 5).alias("answer"))


def probs(spark: SparkSession, sf: str) -> DataFrame:
    def raw(k):
        bump = F.when(k == F.col("id") % 5, 30).otherwise(0)
        return (F.col("id") * 31 + F.col("model_id") * 17 + k * 7) % 101 + 1 + bump

    rows = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.explode(F.array(*map(F.lit, MODELS))).alias("model_id")
    )
    total = sum((raw(F.lit(k)) for k in range(1, 5)), raw(F.lit(0)))
    entries = F.array(
        *[F.struct(F.lit(c).alias("letter"), (raw(F.lit(i)).cast("double") / total).alias("prob")) for i, c in enumerate(LETTERS)]
    )
    return rows.select("model_id", "id", F.inline(entries))


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", "lang", "n_chars")
    return parallel_scan(docs, "doc_id").select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.lit("T"), F.floor(F.col("doc_id") / 4).cast("string")).alias("title"),
        F.col("source").alias("section"),
        "text",
        F.col("lang").alias("file"),
        F.col("n_chars").alias("views"),
    )


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is one of the three contexts of a group."""
    group = F.floor(F.col("doc_id") / 3).cast("long")
    return table(spark, sf, "documents").select(group.alias("id"), (F.col("doc_id") % 3 + 1).cast("int").alias("rank"), "text")


def context_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the question that its id falls to; the rows are named by the document."""
    n = table(spark, sf, "benchmark").agg(F.count("*")).scalar()
    asked = questions(spark, sf).withColumnRenamed("id", "item_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("context"), (F.col("doc_id") % n).alias("item_id"))
    return docs.join(asked, "item_id").select("id", "prompt", "context", *LETTERS, "answer")


def turn_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("emb"))
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("paragraph_id"))
    return turns.join(vectors, "conv_id").withColumn("title", F.concat(F.lit("C"), F.col("conv_id").cast("string")))


def vector_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("article_id"),
        F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("title"),
        F.col("embedding").alias("emb"),
        F.col("label").cast("int").alias("cluster_id"),
    )


def _labelled_titles(spark: SparkSession, sf: str, flag: str) -> DataFrame:
    marked = table(spark, sf, "labels").filter(F.col(flag) == 1)
    return marked.select(F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"))


def seed_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled_titles(spark, sf, "quality")


def known_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled_titles(spark, sf, "toxic")


def run_logs(spark: SparkSession, sf: str) -> DataFrame:
    evaluated = F.col("event_id") % 5 == 0
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
        F.when(evaluated, F.col("value") * 0.9).alias("eval_loss"),
        F.when(evaluated, (F.col("value") % 10.0) / 10.0).alias("eval_map"),
    )


def run_logs_with_facts(spark: SparkSession, sf: str) -> DataFrame:
    logs = run_logs(spark, sf)
    facts = logs.groupBy("run_id").agg(F.lit(3.0).alias("epoch"), F.max("step").alias("global_step"))
    return logs.join(facts, "run_id")
