"""Arithmetic on array columns, and values named within an expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def named(df: DataFrame, values: Iterable[tuple[str, Column]]) -> DataFrame:
    """Columns worked out once a row, each from those before. Opening an array of one keeps the optimizer from writing
    them out wherever they are read, inside folds too, where they would be worked out for every element."""
    for name, value in values:
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def places(n: Column) -> Column:
    """0, 1, ..., n - 1; an empty array for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(empty("int"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def moved(a: Column, step: Column, b: Column) -> Column:
    """a + step b."""
    return let(step, lambda s: F.zip_with(a, b, lambda x, y: x + s * y))


def scaled(factor: Column, a: Column) -> Column:
    return let(factor, lambda s: F.transform(a, lambda x: s * x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_direction(df: DataFrame) -> DataFrame:
    """Adds ``d``: minus the inverse curvature times the gradient ``g``, curvature as told by past moves (oldest first).

    ``steps`` holds the moves of the point, ``turns`` those of the gradient, each an array of vectors. The two loops of
    limited-memory BFGS are two folds over the history. Without history d is the gradient turned back, at length one.
    """
    return named(df, _direction()).drop("bends", "first", "size", "second")


@lru_cache(1)
def _direction() -> list[tuple[str, Column]]:
    """Built once: making so many columns takes longer than planning them."""
    n = F.size("steps")
    bends = F.zip_with("steps", "turns", lambda s, y: dot(s, y))
    start = F.struct(F.col("g").alias("q"), empty("double").alias("used"))

    def down(acc: Column, i: Column) -> Column:
        used = F.array_append(acc["used"], F.try_divide(dot(F.get("steps", i), acc["q"]), F.get("bends", i)))
        return F.struct(acc["q"].alias("q"), used.alias("used"))

    def lower(acc: Column, i: Column) -> Column:
        return F.struct(F.zip_with(acc["q"], F.get("turns", i), lambda q, y: q - F.element_at(acc["used"], -1) * y).alias("q"), acc["used"])

    def higher(q: Column, i: Column) -> Column:
        share = F.array(F.get("first.used", n - 1 - i) - F.try_divide(dot(F.get("turns", i), q), F.get("bends", i)))
        return F.flatten(F.transform(share, lambda a: F.zip_with(q, F.get("steps", i), lambda x, s: x + a * s)))

    # each move is one element to take its share and one to go down by it
    twice = F.flatten(F.transform(F.reverse(places(n)), lambda i: F.array(i, -i - 1)))
    first = F.aggregate(twice, start, lambda acc, i: F.when(i >= 0, down(acc, i)).otherwise(lower(acc, -i - 1)))
    last = F.get("turns", n - 1)
    size = F.when(n > 0, F.try_divide(F.get("bends", n - 1), dot(last, last))).otherwise(
        F.try_divide(F.lit(1.0), F.greatest(norm(F.col("g")), F.lit(1e-12))))
    second = F.aggregate(places(n), F.transform("first.q", lambda x: F.col("size") * x), higher)
    return [("bends", bends), ("first", first), ("size", size), ("second", second), ("d", F.transform("second", lambda x: -x))]
