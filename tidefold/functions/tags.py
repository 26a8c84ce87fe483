"""Sets of tags as arrays: what add-wins objects keep of their additions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_tag(tags: Column, tag: Column) -> Column:
    return F.array_union(tags, F.array(tag))


def with_all(tags: Column, others: Column) -> Column:
    return F.array_union(tags, others)


def without(tags: Column, others: Column) -> Column:
    return F.array_except(tags, others)


def taken(tags: Column, others: Column) -> tuple[Column, Column]:
    """The tags that are left without the others, and those that went."""
    return F.array_except(tags, others), F.array_intersect(tags, others)
