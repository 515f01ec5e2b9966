from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def any_of(values: Iterable[str], test: Callable[[str], Column]) -> Column:
    """Whether the test holds for one of a fixed list; false where it is null."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.coalesce(test(v), F.lit(False)) for v in values)), F.lit(False))


def has_any(x: Column | str, words: Iterable[str]) -> Column:
    return any_of(words, lambda w: F.contains(col(x), F.lit(w)))


def said(x: Column | str) -> Column:
    """Elements of an array joined by a comma and a space."""
    return F.array_join(col(x), ", ")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """What ``f`` makes of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once for each row: neither columns nor filters built on them work them out again."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
