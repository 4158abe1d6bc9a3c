"""Places of pattern matches inside a text, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A noncharacter that marks the ends of matches; texts that hold it get another one in its place first.
MARK, OTHER = "\uffff", "\ufffe"


def running(values: Column, step) -> Column:
    """Inclusive scan of an array by doubling: ``n log n`` work inside the row, no shuffle.

    ``step(earlier, value)`` must be associative.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def double(acc: Column, j: Column) -> Column:
        back = F.pow(F.lit(2.0), j).cast("int")
        return F.transform(acc, lambda x, i: F.when(i >= back, step(F.get(acc, i - back), x)).otherwise(x))

    return F.aggregate(rounds, values, double)


def matches(text: Column, pattern: Column | str) -> Column:
    """``array<struct<start int, end int, text string>>`` of leftmost matches, in code points, end exclusive.

    Matches are wrapped in marks and the text is split at them, so that odd
    pieces are matches; a scan over the pieces' lengths gives the places.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    wrapped = F.regexp_replace(F.translate(text, MARK, OTHER), pattern, F.lit(f"{MARK}$0{MARK}"))
    pieces = F.split(wrapped, MARK)

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x)), lambda a, b: a + b)
        return F.transform(F.array(ends), lambda e: F.filter(
            F.transform(p, lambda x, i: F.when(i % 2 == 1, F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("text")))),
            lambda s: s.isNotNull(),
        ))[0]

    return F.transform(F.array(pieces), placed)[0]
