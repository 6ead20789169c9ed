"""Column expressions shared by the DataFrame-only operators: match positions, running sums, word counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns computed once a row; existing ones are replaced in place, new ones come last.

    A generator of one row holds them, and no later filter or projection is pushed through it: plans
    stacked on the result refer to the values instead of repeating the expressions.
    """
    one = df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_bound"))
    names = [*df.columns, *[n for n in columns if n not in df.columns]]
    return one.select(*[F.col("_bound")[n].alias(n) if n in columns else F.col(f"`{n}`") for n in names])


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _running(values: Column, join: Callable[[Column, Column], Column] = _plus) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, start, lambda a, x: F.struct(join(a["sum"], x).alias("sum"), F.concat(a["out"], F.array(join(a["sum"], x))).alias("out")), lambda a: a["out"])


def _blocks(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")),
                       lambda b: _running(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), join))


def running_sum(values: Column) -> Column:
    """Running sums of an array<long>; blocks keep the cost near-linear for very long arrays."""
    short = F.size(values) <= _BLOCK
    joined = let(_blocks(values, _plus), lambda inner: let(_running(F.transform(inner, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(
        F.zip_with(inner, ends, lambda x, end: F.transform(x, lambda v: v + end - F.element_at(x, -1))))))
    return F.when(F.size(values) == 0, F.array().cast("array<long>")).when(short, _running(values)).otherwise(joined)


def highest_before(values: Column) -> Column:
    """For each entry of an array<long> of values from 0 on, the largest of the entries before it (0 for the first); blocks as above."""
    shifted = F.concat(F.array(F.lit(0).cast("long")), F.slice(values, F.lit(1), F.size(values) - 1))
    joined = lambda v: let(_blocks(v, F.greatest), lambda inner: let(_running(F.transform(inner, lambda x: F.element_at(x, -1)), F.greatest), lambda ends: F.flatten(
        F.transform(inner, lambda x, i: F.transform(x, lambda y: F.greatest(y, F.when(i > 0, F.get(ends, i - 1)).otherwise(0)))))))
    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(let(shifted, lambda v: F.when(F.size(v) <= _BLOCK, _running(v, F.greatest)).otherwise(joined(v))))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start long, end long, match string>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pattern must match one character at least. The text between matches gives the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(m: Column) -> Column:
        size = lambda i: F.length(F.element_at(m, i))
        steps = let(gaps, lambda g: F.transform(m, lambda x, i: (F.length(F.element_at(g, i + 1)) + F.when(i > 0, size(F.greatest(i, F.lit(1)))).otherwise(0)).cast("long")))
        return let(steps, lambda s: let(running_sum(s), lambda at: F.transform(m, lambda x, i: F.struct(
            F.element_at(at, i + 1).alias("start"), (F.element_at(at, i + 1) + F.length(x)).alias("end"), x.alias("match")))))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, empty).otherwise(place(m)))
