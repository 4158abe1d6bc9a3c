"""Assemble training and validation questions from a base set and extra sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.operators.questions import (
    drop_incomplete,
    merge_question_sets,
    non_empty,
    seeded_shuffle,
    seeded_split,
    unique_ids,
)


def question_bundle(
    base: DataFrame,
    extras: list[DataFrame] | None = None,
    valid_extras: list[DataFrame] | None = None,
    test_size: float = 0.2,
    seed: int = 42,
    complete_only: bool = False,
    test: DataFrame | None = None,
) -> DataFrame:
    """One table with a ``split`` column: ``train``, ``valid`` and, where given, ``test`` questions.

    The base set is split exactly; each part takes its own extra sets, with ids
    moved past its own largest.  Training rows are shuffled when extras were
    added: ``position`` holds their place, and is null otherwise.  A training part
    without rows fails the job, unless all questions are asked for as ``valid``;
    test questions have no answer.
    """
    parted = seeded_split(base, test_size, seed)
    train = merge_question_sets(parted.filter("split = 'train'").drop("split"), extras or [])
    valid = merge_question_sets(parted.filter("split = 'valid'").drop("split"), valid_extras or [])
    if complete_only:
        train = drop_incomplete(train)
    train = unique_ids(train if test_size == 1 else non_empty(train, "the training part"))
    if extras:
        train = seeded_shuffle(train, seed)
    else:
        train = train.withColumn("position", F.lit(None).cast("long"))
    valid = valid.withColumn("position", F.lit(None).cast("long"))
    bundle = train.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("valid")))
    if test is not None:
        asked = test.drop("answer").withColumn("position", F.lit(None).cast("long")).withColumn("split", F.lit("test"))
        bundle = bundle.unionByName(asked, allowMissingColumns=True)
    return bundle
