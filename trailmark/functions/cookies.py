"""FN-05: what a cookie string says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import blank_to_null, col


def segments(cookie: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(cookie), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def _key(segment: Column) -> Column:
    return F.trim(F.substring_index(segment, "=", 1))


def keys(cookie: Column | str, most: int = 3) -> Column:
    """The first distinct names that are not attributes, comma-joined; null if there are none."""
    named = F.transform(F.filter(segments(cookie), lambda x: x.contains("=")), _key)
    own = F.filter(named, lambda k: (k != "") & ~F.lower(k).isin(*K.COOKIE_ATTRIBUTES))
    return blank_to_null(F.array_join(F.slice(F.array_distinct(own), 1, most), ","))


def attribute(cookie: Column | str, name: str) -> Column:
    """Value of an attribute, the name itself for a flag, null if absent."""
    found = F.get(F.filter(segments(cookie), lambda x: F.lower(_key(x)) == name.lower()), F.lit(0))
    return F.when(found.contains("="), F.trim(F.regexp_replace(found, r"^[^=]*=", ""))).when(found.isNotNull(), F.lit(name.lower()))


def flags(cookie: Column | str) -> Column:
    own = F.transform(F.filter(segments(cookie), lambda x: ~x.contains("=")), F.lower)
    return blank_to_null(F.array_join(F.array_distinct(F.filter(own, lambda f: f.isin(*K.COOKIE_FLAGS))), ","))
