"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(values: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def tokens(c) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def money(c) -> Column:
    """An amount as text with two digits, rounded half up by whole cents."""
    cents = F.floor(F.abs(c) * 100 + 0.5).cast("long")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def token_set(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
