"""Version ranges of advisories.

Dotted numeric versions compare natively, as arrays of ``WIDTH`` numbers padded with zeros. Other
forms (pre-releases, letters) go through ``compare``, an Arrow function over the public packaging
rules.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import blank_to_null, col

WIDTH = 6


def key(version: Column | str) -> Column:
    """Numbers of a dotted version, padded; blank counts as 0, other forms are null."""
    v = F.coalesce(blank_to_null(F.trim(col(version))), F.lit("0"))
    numbers = F.transform(F.split(v, r"\."), lambda x: x.try_cast("long"))
    padded = F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), WIDTH)), 1, WIDTH)
    return F.when(v.rlike(rf"^[0-9]{{1,9}}(\.[0-9]{{1,9}}){{0,{WIDTH - 1}}}$"), padded)


# A constraint is struct(op, low, low_in, high, high_in): ``op`` is null for a range. A group is an array of
# constraints that must all hold; of an array of groups one must.
_OP, _VERSION = r"(<=|>=|<|>|=)", r"([0-9][0-9A-Za-z._-]*)"


def _constraint(op: Column, low: Column, low_in: Column, high: Column, high_in: Column) -> Column:
    return F.struct(op.alias("op"), low.alias("low"), low_in.alias("low_in"), high.alias("high"), high_in.alias("high_in"))


def groups_from_title(title: Column | str) -> Column:
    """FN-31: one group of all ``a - b`` and ``<= x`` constraints of a title; no group if there are none."""
    none, yes = F.lit(None).cast("string"), F.lit(True)
    span = r"([0-9][0-9A-Za-z._]*)\s*[-\u2013\u2014]\s*([0-9][0-9A-Za-z._-]*)"
    ranges = F.transform(F.regexp_extract_all(col(title), F.lit(span), 0), lambda m: _constraint(none, F.regexp_extract(m, span, 1), yes, F.regexp_extract(m, span, 2), yes))

    def one(m: Column) -> Column:
        op, v = F.regexp_extract(m, _OP, 1), F.regexp_extract(m, _VERSION, 1)
        return _constraint(op, F.when(op.isin(">", ">=", "="), v), op != ">", F.when(op.isin("<", "<=", "="), v), op != "<")

    ops = F.transform(F.regexp_extract_all(col(title), F.lit(rf"{_OP}\s*{_VERSION}"), 0), one)
    both = F.concat(ranges, ops)
    return F.when(F.size(both) > 0, F.array(both)).otherwise(F.slice(F.array(both), 1, 0))


def groups(affected: Column | str) -> Column:
    """FN-31: a group for each range of an advisory's map; ``*`` and blanks are no bound."""
    bound = lambda x: F.when(F.coalesce(x, F.lit("")) != "*", blank_to_null(x))
    inside = lambda x: F.coalesce(x, F.lit(True))
    return F.transform(F.map_values(col(affected)), lambda r: F.array(_constraint(F.lit(None).cast("string"), bound(r["from_version"]), inside(r["from_inclusive"]), bound(r["to_version"]), inside(r["to_inclusive"]))))


def described(constraint_groups: Column | str) -> Column:
    """FN-32: ``a - b or < c``; ``all versions`` without groups."""
    star = lambda x: F.coalesce(x, F.lit("*"))
    one = lambda c: F.when(c["op"].isNull(), F.concat(star(c["low"]), F.lit(" - "), star(c["high"]))).otherwise(F.concat_ws(" ", c["op"], F.coalesce(c["low"], c["high"])))
    said = F.transform(col(constraint_groups), lambda g: F.array_join(F.transform(g, one), " and "))
    return F.when(F.coalesce(F.size(col(constraint_groups)), F.lit(0)) == 0, "all versions").otherwise(F.array_join(said, " or "))


def satisfies(version: Column | str, constraint_groups: Column | str) -> Column:
    """FN-34: some group holds the version; no groups hold every version. A blank version compares equal to any bound.

    Null where a form isn't numeric: those go through ``compare``.
    """
    blank = F.coalesce(F.trim(col(version)) == "", F.lit(True))
    v = key(version)
    low = lambda c: F.when(c["low"].isNull(), True).when(blank, c["low_in"]).when(c["low_in"], v >= key(c["low"])).otherwise(v > key(c["low"]))
    high = lambda c: F.when(c["high"].isNull(), True).when(blank, c["high_in"]).when(c["high_in"], v <= key(c["high"])).otherwise(v < key(c["high"]))
    held = F.exists(col(constraint_groups), lambda g: F.forall(g, lambda c: low(c) & high(c)))
    return F.when(F.coalesce(F.size(col(constraint_groups)), F.lit(0)) == 0, True).otherwise(held)


def _compared(a: str | None, b: str | None) -> int:
    import re

    from packaging.version import InvalidVersion, Version

    if not a or not b:
        return 0
    try:
        x, y = Version(a), Version(b)
        return (x > y) - (x < y)
    except InvalidVersion:
        pass
    tokens = [[int(t) if t.isdigit() else t.lower() for t in re.split("[._-]", v) if t] for v in (a, b)]
    width = max(map(len, tokens))
    for x, y in zip(*(t + [0] * (width - len(t)) for t in tokens), strict=True):
        if type(x) is not type(y):
            x, y = str(x), str(y)
        if x != y:
            return 1 if x > y else -1
    return 0


def compare(a: Column | str, b: Column | str) -> Column:
    """FN-33: -1, 0 or 1 for any two versions, 0 if one is blank, in Arrow batches. Public packaging rules first, else token by token."""
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_compared(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return run(col(a), col(b))


def order(version: Column | str) -> list[Column]:
    """TOP-05: sort columns that put numeric versions first, by number, and other forms after them, by text."""
    return [key(version).isNull().asc(), key(version).asc(), F.lower(col(version)).asc()]
