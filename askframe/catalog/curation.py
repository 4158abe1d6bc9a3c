"""Sources, sinks and question-set curation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe.catalog import base
from askframe.catalog.base import query, table, words_sql
from askframe.cluster import scratch_path, with_row_index
from askframe.fixed_values import LETTERS
from askframe.functions.letters import answer_text, index_to_letter, letter_to_index, letter_to_number, one_hot
from askframe.functions.text import bullets_from_columns, word_count
from askframe.functions.prompts import option_suffixes, shared_prefix
from askframe.operators import questions as ops, runs
from askframe.operators.scoring import wide_options
from askframe.sources import corpus, questions as sources, scores
from askframe.plans import question_sets
from askframe.sources import sinks
from askframe.sources.sinks import materialize, write_csv

QUESTION_COLUMNS = "id, prompt, A, B, C, D, E, answer"


def stored_questions(spark, sf):
    path = scratch_path(spark, "questions")
    write_csv(base.questions(spark, sf), path)
    return path


@query(f"select {QUESTION_COLUMNS} from questions", "questions")
def read_questions(spark, sf):
    return sources.read_questions(spark, stored_questions(spark, sf), "train")


@query("select id, prompt, A, B, C, D, E from questions", "questions")
def read_test_questions(spark, sf):
    return sources.read_questions(spark, stored_questions(spark, sf), "test")


@query(
    """c as (select id, string_agg('- ' || text, chr(10) order by rank) as context from contexts group by id)
       select c.id, prompt, context, A, B, C, D, E, answer from c join questions q on q.id = c.id % (select count(*) from benchmark)""",
    "questions contexts",
)
def read_questions_with_context(spark, sf):
    n = table(spark, sf, "benchmark").agg(F.count("*")).scalar()
    wide = ops.pivot_contexts(base.contexts(spark, sf), 3).withColumn("item_id", F.col("id") % n)
    path = scratch_path(spark, "context-questions")
    write_csv(wide.join(base.questions(spark, sf).withColumnRenamed("id", "item_id"), "item_id").drop("item_id"), path)
    return sources.read_questions(spark, path, "valid", with_context=True, top_n=3)


NUMBERED = """
    select row_number() over (order by prompt, A, B, C, D, E, answer) - 1 as id,
      prompt, A, B, C, D, E, answer from {source}"""


@query(NUMBERED.format(source="questions"), "questions")
def read_extra_questions(spark, sf):
    return sources.read_extra_questions(spark, stored_questions(spark, sf), order="content")


FILE_ORDER = """
    select row_number() over (order by page_title, id) - 1 as id, prompt, A, B, C, D, E, answer, page_title from questions"""


@query("placed as (" + FILE_ORDER + ") select id, prompt, A, B, C, D, E, answer from placed", "questions")
def read_extra_questions_in_file_order(spark, sf):
    """The rows' places in the files are the ids, and the number of rows is checked."""
    q = base.questions(spark, sf)
    path = scratch_path(spark, "extra-sets")
    # A file a set: the files' order is that of the sets, and rows stand in a file by their ids.
    named = q.withColumn("set_name", F.col("page_title"))
    write_csv(named.repartition("set_name").sortWithinPartitions("set_name", "id"), path, ["set_name"])
    return sources.read_extra_questions(spark, path, q.count(), order="file")


@query(
    "numbered as ("
    + NUMBERED.format(source="questions").replace("answer from", "answer, page_title from")
    + ") select id, prompt, A, B, C, D, E, answer from numbered qualify row_number() over (partition by page_title order by id) = 1",
    "questions",
)
def read_extra_first_of_page(spark, sf):
    path = stored_questions(spark, sf)
    return sources.read_extra_questions(spark, path, transform=sources.first_of_page, order="content")


@query(
    # A set is expected to hold a row for each document of its language, and is stored without the documents labelled toxic.
    """expected as (select lang as set_name, count(*) as expected_rows from documents group by lang
         union all select 'none', (select count(*) from benchmark)),
       found as (select lang as set_name, count(*) as found_rows from documents
         where doc_id not in (select doc_id from labels where toxic = 1) group by lang)
       select set_name, expected_rows, coalesce(found_rows, 0) as found_rows, coalesce(found_rows, 0) = expected_rows as matches
       from expected left join found using (set_name)"""
)
def dataset_registry(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("set_name"))
    registry = docs.groupBy("set_name").agg(F.count("*").alias("expected_rows"))
    absent = table(spark, sf, "benchmark").agg(F.lit("none").alias("set_name"), F.count("*").alias("expected_rows"))
    registry = registry.unionByName(absent)
    toxic = table(spark, sf, "labels").filter("toxic = 1")
    path = scratch_path(spark, "named-sets")
    write_csv(docs.join(toxic, "doc_id", "left_anti"), path, ["set_name"])
    return sources.registry_check(registry, sources.read_csv(spark, path))


@query("select id, prompt || ' v3' as prompt, answer from questions", "questions")
def select_context_version(spark, sf):
    versions = F.explode(F.array(*[F.lit(v) for v in (1, 2, 3, 4)]))
    q = base.questions(spark, sf).select("id", "prompt", "answer", versions.alias("context_version"))
    q = q.withColumn("prompt", F.concat("prompt", F.lit(" v"), F.col("context_version").cast("string")))
    path = scratch_path(spark, "versions")
    q.write.partitionBy("context_version").parquet(path)
    return sources.select_context_version(spark.read.parquet(path), 3)


@query(
    """select doc_id as article_id, 'document' as title, text from documents union all
       select page_id + (select max(doc_id) + 1 from documents), 'page', html from pages union all
       select item_id + (select max(doc_id) + 1 from documents) + (select max(page_id) + 1 from pages), 'question', text
       from benchmark"""
)
def scan_corpus(spark, sf):
    def part(name, key, text):
        return table(spark, sf, name).select(
            F.col(key).alias("article_id"), F.lit(name.removesuffix("s") if name != "benchmark" else "question").alias("title"), F.col(text).alias("text")
        )

    return corpus.scan_corpus([part("documents", "doc_id", "text"), part("pages", "page_id", "html"), part("benchmark", "item_id", "text")])


@query("select doc_id as id, lang as file from documents")
def scan_index(spark, sf):
    return corpus.scan_index(spark, f"{sf}/documents.parquet", "doc_id", "lang")


@query("select doc_id as id, text from documents where doc_id in (select doc_id from labels where quality = 1)")
def scan_fulltext(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("file"))
    path = scratch_path(spark, "fulltext")
    corpus.write_fulltext(docs, path)
    wanted = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return corpus.scan_fulltext(spark, path, docs.select("id", "file").join(wanted, "id"))


@query("select title, list_sum(list_transform(emb, lambda x: x::double)) as emb_sum from turn_vectors where paragraph_id = 0", "turn_vectors")
def scan_embeddings(spark, sf):
    first = corpus.scan_embeddings(base.turn_vectors(spark, sf))
    total = F.aggregate("emb", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return first.select("title", F.round(total, 9).alias("emb_sum"))


@query("select cast(model_id as varchar) as model_id, id, letter, round(prob, 9) as prob from probs", "probs")
def read_model_probs(spark, sf):
    path = scratch_path(spark, "probs")
    wide = wide_options(base.probs(spark, sf), ["model_id", "id"])
    write_csv(wide, path, ["model_id"])
    return scores.read_model_probs(spark, path).withColumn("prob", F.round("prob", 9))


RUN_STATE_SQL = """
    parts as (select run_id, step // 100 as part, max(step) as global_step, min(eval_loss) as best_metric,
        coalesce(arg_min(step, (eval_loss, step)) filter (eval_loss is not null), max(step)) as best_step
      from run_logs group by all)"""


def run_states(spark, sf):
    """Training states, one per run and hundred steps, so a state's history is bounded."""
    logs = base.run_logs(spark, sf).withColumn("part", F.floor(F.col("step") / 100))
    evaluated = F.when(F.col("eval_loss").isNotNull(), F.struct("eval_loss", "step"))
    best_step = F.coalesce(F.min_by("step", evaluated), F.max("step"))
    return logs.groupBy("run_id", "part").agg(
        F.concat(F.lit("runs/"), F.col("run_id"), F.lit("/checkpoint-"), best_step.cast("string")).alias("best_model_checkpoint"),
        F.min("eval_loss").alias("best_metric"),
        F.lit(3.0).alias("epoch"),
        F.max("step").alias("global_step"),
        F.collect_list(F.struct("step", "loss", "eval_loss", F.col("eval_map").alias("eval_MAP@3"))).alias("log_history"),
    )


@query(
    RUN_STATE_SQL
    + """ select l.run_id, p.best_step, p.best_metric, 3.0::double as epoch, p.global_step, l.step, l.loss, l.eval_loss, l.eval_map as "eval_MAP@3"
         from run_logs l join parts p on p.run_id = l.run_id and p.part = l.step // 100""",
    "run_logs",
)
def read_run_logs(spark, sf):
    path = scratch_path(spark, "run-states")
    run_states(spark, sf).drop("part").write.json(path)
    return scores.read_run_logs(spark, path, multi_line=False)


@query(
    RUN_STATE_SQL
    + """, e as (select l.run_id, round(l.step * 3.0::double / p.global_step, 9) as epoch, l.step, l.loss, l.eval_loss, l.eval_map
           from run_logs l join parts p on p.run_id = l.run_id and p.part = l.step // 100)
         select run_id, epoch, step, 'loss' as type, loss as value, 'loss' as facet from e
         union all select run_id, epoch, step, 'eval_loss', eval_loss, 'loss' from e
         union all select run_id, epoch, step, 'eval_MAP@3', eval_map, 'MAP@3' from e""",
    "run_logs",
)
def learning_curve_of_files(spark, sf):
    """A metric that only the files name becomes a part of the curve."""
    path = scratch_path(spark, "run-states")
    run_states(spark, sf).drop("part").write.json(path)
    curve = runs.learning_curve(scores.read_run_logs(spark, path, multi_line=False))
    return curve.withColumn("epoch", F.round("epoch", 9))


@query(f"select {QUESTION_COLUMNS}, page_title from questions", "questions")
def write_and_read_csv(spark, sf):
    return sources.read_csv(spark, stored_questions(spark, sf)).withColumn("id", F.col("id").cast("long"))


@query(
    "select id, string_agg(letter, ' ' order by p desc, letter) as prediction from "
    "(select id, letter, round(avg(prob), 9) as p from probs group by all) group by id",
    "probs",
)
def write_submission(spark, sf):
    mean = base.probs(spark, sf).groupBy("id", "letter").agg(F.round(F.avg("prob"), 9).alias("prob"))
    path = scratch_path(spark, "submission")
    sinks.write_submission(mean, path)
    return sources.read_csv(spark, path, "id long, prediction string")


BUNDLE_SQL = """
    placed as (select *, row_number() over (order by md5('42:' || cast(id as varchar)), id) - 1 as position from questions),
    parted as (select *, case when position < ceil((select count(*) from questions) * 0.2::double) then 'valid' else 'train' end as split from placed),
    numbered as (""" + NUMBERED.format(source="questions") + """),
    top as (select split, max(id) + 1 as first from parted group by split)
    select split, id, prompt, A, B, C, D, E, answer from parted
    union all select 'train', n.id + first, prompt, A, B, C, D, E, answer from numbered n join top on split = 'train'
    union all select 'valid', n.id + first, prompt, A, B, C, D, E, answer from numbered n join top on split = 'valid'
    union all select 'test', id, prompt, A, B, C, D, E, null from questions"""


@query(BUNDLE_SQL, "questions")
def question_bundle(spark, sf):
    extra = sources.read_extra_questions(spark, stored_questions(spark, sf), order="content")
    first = ops.canonical_columns(base.questions(spark, sf), "train")
    asked = ops.canonical_columns(base.questions(spark, sf), "test")
    return question_sets.question_bundle(first, [extra], [extra], test_size=0.2, seed=42, test=asked).drop("position")


@query("select lang, count(*) as n from documents group by lang")
def materialize_once(spark, sf):
    path = scratch_path(spark, "stored")

    def build():
        return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))

    materialize(spark, path, build)
    return materialize(spark, path, build)


@query("select d.doc_id, quality, toxic from documents d join labels l on l.doc_id = d.doc_id")
def drop_incomplete(spark, sf):
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return ops.drop_incomplete(labelled.withColumn("quality", F.col("quality").cast("int")).withColumn("toxic", F.col("toxic").cast("int")))


@query("select d.doc_id, coalesce(cast(quality as varchar), '') as quality from documents d left join labels l on l.doc_id = d.doc_id")
def fill_missing(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return ops.fill_missing(table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left"))


@query(
    """select id, case answer when 'A' then A when 'B' then B when 'C' then C when 'D' then D when 'E' then E end as answer_text
       from questions""",
    "questions",
)
def answer_texts(spark, sf):
    return base.questions(spark, sf).select("id", answer_text().alias("answer_text"))


@query(
    """select id, cast(instr('ABCDE', answer) - 1 as int) as answer_index, substr('ABCDE', instr('ABCDE', answer), 1) as letter,
       cast(instr('ABCDE', answer) as int) as answer_number from answers""",
    "answers",
)
def letter_index(spark, sf):
    index = letter_to_index(F.col("answer"))
    return base.answers(spark, sf).select(
        "id", index.alias("answer_index"), index_to_letter(index).alias("letter"), letter_to_number(F.col("answer")).alias("answer_number")
    )


@query("select id, letter, cast(letter = answer as int) as target from options", "options")
def one_hot_target(spark, sf):
    long = base.questions(spark, sf).unpivot(["id", "answer"], list(LETTERS), "letter", "text")
    return long.select("id", "letter", one_hot(F.col("letter"), F.col("answer")).alias("target"))


@query(f"select doc_id, cast({words_sql('text')} as int) as n_words from documents where {words_sql('text')} <= 200")
def filter_long_examples(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return ops.filter_long_examples(docs, 200).select("doc_id", word_count(F.col("text")).alias("n_words"))


@query("select conv_id, count(*) as n from conversations group by conv_id having count(*) > 1")
def unique_key_check(spark, sf):
    return ops.duplicate_ids(table(spark, sf, "conversations"), "conv_id")


@query("select doc_id + (select max(id) + 1 from questions) as id from documents", "questions")
def max_id_offset(spark, sf):
    extra = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return ops.shift_ids(base.answers(spark, sf), extra)


@query(
    "numbered as (" + NUMBERED.format(source="questions") + ") "
    + f"""select {QUESTION_COLUMNS} from questions
      union all select id + (select max(id) + 1 from questions), prompt, A, B, C, D, E, answer from numbered
      union all select id + (select max(id) + 1 from questions) + (select count(*) from numbered), prompt, A, B, C, D, E, answer from numbered""",
    "questions",
)
def merge_question_sets(spark, sf):
    first = ops.canonical_columns(base.questions(spark, sf), "train")
    extra = sources.read_extra_questions(spark, stored_questions(spark, sf), order="content")
    return ops.merge_question_sets(first, [extra, extra])


@query("select doc_id as id, row_number() over (order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1 as position from documents")
def seeded_shuffle(spark, sf):
    return ops.seeded_shuffle(table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query(
    """placed as (select doc_id as id, row_number() over (order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1 as position from documents)
       select id, case when position < ceil((select count(*) from documents) * 0.2::double) then 'valid' else 'train' end as split from placed"""
)
def seeded_split(spark, sf):
    return ops.seeded_split(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 0.2, 42)


@query(
    "select page_title, id, prompt from questions qualify row_number() over (partition by page_title order by id) = 1", "questions"
)
def head_per_group(spark, sf):
    return ops.head_per_group(base.questions(spark, sf), ["page_title"], [F.col("id")], 1).select("page_title", "id", "prompt")


@query("select doc_id as id, cast(ntile(7) over (order by doc_id) as int) as share from documents")
def split_n(spark, sf):
    return ops.split_n(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 7)


@query("select conv_id as id, count(*) as n_options from conversations group by conv_id having count(*) <> 5")
def groups_of_five(spark, sf):
    return ops.incomplete_groups(table(spark, sf, "conversations").select(F.col("conv_id").alias("id")))


@query("select doc_id as id, row_number() over (order by doc_id) <= 200 as in_first_n from documents")
def first_n_subset(spark, sf):
    return ops.first_n_flag(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 200)


@query("select id, prompt, letter, answer_text, case when letter = answer then 'yes' else 'no' end as yes_or_no from options", "options")
def unpivot_options(spark, sf):
    return ops.unpivot_options(base.questions(spark, sf).drop("page_title"))


PIVOT_SQL = """select id, max(case when rank = 1 then text end) as context_top1, max(case when rank = 2 then text end) as context_top2,
       max(case when rank = 3 then text end) as context_top3 from contexts group by id"""


@query("select q.id, q.prompt, a.answer as expected from questions q join answers a on a.id = q.id", "questions answers")
def attach_by_id(spark, sf):
    expected = base.answers(spark, sf).withColumnRenamed("answer", "expected")
    return ops.attach_by_id(base.questions(spark, sf).select("id", "prompt"), expected)


@query(PIVOT_SQL, "contexts")
def pivot_contexts(spark, sf):
    return ops.pivot_contexts(base.contexts(spark, sf), 3)


@query("select id, string_agg('- ' || text, chr(10) order by rank) as context from contexts group by id", "contexts")
def bullets_from_context_columns(spark, sf):
    wide = ops.pivot_contexts(base.contexts(spark, sf), 3)
    return wide.select("id", bullets_from_columns(3).alias("context"))


@query(
    f"""q as (select quantile_cont({words_sql('text')}, [0, 0.5, 0.75, 0.9, 0.95, 1]) as v from documents)
       select unnest([0::double, 0.5::double, 0.75::double, 0.9::double, 0.95::double, 1::double]) as quantile, unnest(v)::double as value from q"""
)
def length_quantiles(spark, sf):
    return ops.length_quantiles(table(spark, sf, "documents"), word_count(F.col("text")))


@query(
    f"""lens as (select {words_sql("'{head}' || context || chr(10) || chr(10) || 'Question:' || chr(10) || prompt || chr(10) || chr(10) || 'Proposed answer:'")}
           + greatest({', '.join(words_sql(c) for c in LETTERS)}) + 2 as n from context_questions)
       select max(n)::bigint as max_length, ceil(max(n) / 512.0)::bigint as n_batches from lens""".replace(
        "{head}",
        "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that "
        "appropriately completes the request. ### Instruction: Your task is to analyze the question and answer below. If the answer "
        "is correct, respond yes, if it is not correct respond no. As a potential aid to your answer, background context from "
        "Wikipedia articles is at your disposal, even if they might not always be pertinent. ### Input: Context: ",
    ),
    "context_questions",
)
def batch_plan(spark, sf):
    longest_suffix = F.array_max(F.transform(option_suffixes(), word_count))
    return ops.batch_plan(base.context_questions(spark, sf), word_count(shared_prefix()), longest_suffix)


@query("select lang as file, doc_id as id, row_number() over (order by lang, doc_id) - 1 as position from documents")
def multi_key_sort(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("file"), F.col("doc_id").alias("id"))
    return with_row_index(docs, [F.col("file"), F.col("id")], "position")


@query(
    """placed as (select lang as file, doc_id as id, (row_number() over (order by lang, doc_id) - 1) // 100 as chunk
                  from documents where doc_id in (select doc_id from labels))
       select file, chunk, string_agg(cast(id as varchar), ',' order by id) as ids, count(*) as n from placed group by file, chunk"""
)
def ids_per_file(spark, sf):
    hits = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi")
    ids = corpus.ids_per_file(hits.select(F.col("doc_id").alias("id"), F.col("lang").alias("file")), 100)
    return ids.select("file", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"))
