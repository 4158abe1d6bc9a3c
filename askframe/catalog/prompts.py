"""Prompt shaping on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from askframe.catalog import base
from askframe.catalog.base import query, table, words_sql
from askframe.fixed_values import LETTERS, NUMBERED_FAMILIES, PREFIX_TEXT, PROMPT_TEXTS
from askframe.functions.prompts import prompt_kind
from askframe.functions.text import budget_sentences as budget_sentences_of
from askframe.operators import prompts, sentences


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(template: str, values: dict[str, str]) -> str:
    """The template with its placeholders replaced one after the other."""
    sql = quoted(template)
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


BUDGET_PIECES_SQL = f"""list_transform(list_filter(flatten(list_transform(string_split(context, '. '), lambda s: string_split(s, chr(10) || '-'))),
    lambda s: regexp_matches(s, '{base.WORD_SQL}')), lambda s: case when ends_with(s, '.') then s else s || '.' end)"""


@query(f"select doc_id, array_to_string({BUDGET_PIECES_SQL}, '|') as sentences from (select doc_id, text as context from documents)")
def budget_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(budget_sentences_of(F.col("text")), "|").alias("sentences"))


def budget_sql(base_words: str, limit: int) -> str:
    return f"""
      pieces as (select id, unnest(s) as s, unnest(range(1, len(s) + 1)) as i, n from
                 (select id, {BUDGET_PIECES_SQL} as s, {base_words} as n from context_questions)),
      running as (select id, i, s, n + sum({words_sql('s')}) over (partition by id order by i) as total from pieces)
      select q.id, coalesce(string_agg(r.s, ' ' order by r.i), '') as context
      from context_questions q left join running r on r.id = q.id and r.total < {limit} group by q.id"""


ALL_WORDS = " + ".join(words_sql(c) for c in ("prompt", *LETTERS))
ANSWER_SQL = "case answer " + " ".join(f"when '{c}' then {c}" for c in LETTERS) + " end"


@query(budget_sql(ALL_WORDS, 150), "context_questions")
def context_word_budget(spark, sf):
    return sentences.context_word_budget(base.context_questions(spark, sf), 150, True).select("id", "context")


@query(budget_sql(f"{words_sql('prompt')} + {words_sql(ANSWER_SQL)}", 60), "context_questions")
def context_word_budget_answer(spark, sf):
    return sentences.context_word_budget(base.context_questions(spark, sf), 60, False).select("id", "context")


def template_sql(with_answer: bool) -> str:
    """All templates over all questions, by chained replacement."""
    parts = []
    for (family, number), template in PROMPT_TEXTS.items():
        kind = prompt_kind(family, number)
        head = f"'{family}' as family, {number}::int as prompt_id"
        values = {"prompt": "prompt", "context": "context"}
        if kind["yes_no_answer"]:
            for c in LETTERS:
                right = f"case when answer = '{c}' then 'yes' else 'no' end" if with_answer else "''"
                text = replaced(template, values | {"answer_text": c, "yes_or_no": right})
                parts.append(f"select {head}, id, '{c}' as letter, {text} as text from context_questions")
            continue
        if kind["text_answer"]:
            values["answer_text"] = ANSWER_SQL if with_answer else "''"
        else:
            values |= {c.lower(): c for c in LETTERS}
            number_sql = "cast(instr('ABCDE', answer) as varchar)"
            values["answer"] = (number_sql if family in NUMBERED_FAMILIES else "answer") if with_answer else "''"
        parts.append(f"select {head}, id, '-' as letter, {replaced(template, values)} as text from context_questions")
    return " union all ".join(parts)


def all_templates(spark, sf, with_answer: bool):
    found = prompts.render_all(base.context_questions(spark, sf), with_answer)
    return found.withColumn("letter", F.coalesce("letter", F.lit("-")))


@query(template_sql(True), "context_questions")
def render_prompt(spark, sf):
    return all_templates(spark, sf, True)


@query(template_sql(False), "context_questions")
def render_prompt_for_scoring(spark, sf):
    return all_templates(spark, sf, False)


ROTATION = list(PROMPT_TEXTS)


def rotated_questions(spark, sf):
    """Every question names one of the templates."""
    slot = F.pmod(F.col("id"), F.lit(len(ROTATION))).cast("int") + 1
    return (
        base.context_questions(spark, sf)
        .withColumn("family", F.element_at(F.array(*[F.lit(f) for f, _ in ROTATION]), slot))
        .withColumn("prompt_id", F.element_at(F.array(*[F.lit(n) for _, n in ROTATION]), slot))
    )


def rotation_sql(list_of: str) -> str:
    return f"[{list_of}][id % {len(ROTATION)} + 1]"


FAMILY_SQL = rotation_sql(", ".join(quoted(f) for f, _ in ROTATION))
NUMBER_SQL = rotation_sql(", ".join(str(n) for _, n in ROTATION))


@query(
    f"named as (select id, {FAMILY_SQL} as family, {NUMBER_SQL}::int as prompt_id from context_questions), "
    f"texts as ({template_sql(True)}) "
    "select n.id, n.family, n.prompt_id, t.letter, t.text from named n join texts t on t.id = n.id and t.family = n.family and t.prompt_id = n.prompt_id",
    "context_questions",
)
def render_by_template(spark, sf):
    found = prompts.render_by_template(rotated_questions(spark, sf), True)
    return found.select("id", "family", "prompt_id", F.coalesce("letter", F.lit("-")).alias("letter"), "text")


TEMPLATE_ROWS = ", ".join(f"({quoted(f)}, {n}::int, {quoted(text)})" for (f, n), text in PROMPT_TEXTS.items())


@query(
    f"""named as (select id, {FAMILY_SQL} as family, {NUMBER_SQL}::int as prompt_id from context_questions)
       select id, family, prompt_id, contains(template, '{{answer}}') as letter_answer,
         contains(template, '{{answer_text}}') and not contains(template, '{{yes_or_no}}') as text_answer,
         contains(template, '{{yes_or_no}}') as yes_no_answer, contains(template, '{{context}}') as with_context
       from named join (values {TEMPLATE_ROWS}) as k(family, prompt_id, template) using (family, prompt_id)""",
    "context_questions",
)
def prompt_kinds(spark, sf):
    kinds = prompts.with_prompt_kind(rotated_questions(spark, sf))
    return kinds.select("id", "family", "prompt_id", "letter_answer", "text_answer", "yes_no_answer", "with_context")


@query(
    f"select id, {replaced(PREFIX_TEXT, {'context': 'context', 'prompt': 'prompt'})} as prefix, "
    + " || '|' || ".join(f"{c} || chr(10) || chr(10) || '### Response:' || chr(10)" for c in LETTERS)
    + " as suffixes from context_questions",
    "context_questions",
)
def prefix_suffixes(spark, sf):
    df = prompts.prefix_suffixes(base.context_questions(spark, sf))
    return df.select("id", "prefix", F.array_join("suffixes", "|").alias("suffixes"))


PAIRS_SQL = " union all ".join(
    f"select id, '[CLS] ' || context as first, cast(instr('ABCDE', answer) - 1 as int) as label, '{c}' as letter, "
    f"' #### ' || prompt || ' [SEP] ' || {c} || ' [SEP]' as second from context_questions"
    for c in LETTERS
)


@query(PAIRS_SQL, "context_questions")
def pair_text(spark, sf):
    return prompts.pair_text(base.context_questions(spark, sf))


def truncated_sql(limit: int) -> str:
    return f"""pairs as ({PAIRS_SQL}),
      rooms as (select *, {limit} - {words_sql('second')} as room from pairs),
      marked as (select *, room > 0 and {words_sql('first')} > room as cut, room <= 0 as no_room from rooms)
      select id, letter, label, second, cut, no_room, case when cut then
        array_to_string(list_slice(regexp_extract_all(first, '{base.WORD_SQL}'), 1, room), ' ') else first end as first from marked"""


@query(truncated_sql(120), "context_questions")
def truncate_first_only(spark, sf):
    return prompts.truncate_first_only(prompts.pair_text(base.context_questions(spark, sf)), 120)


@query(truncated_sql(30), "context_questions")
def truncate_first_only_without_room(spark, sf):
    return prompts.truncate_first_only(prompts.pair_text(base.context_questions(spark, sf)), 30)
