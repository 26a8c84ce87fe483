"""Value-level functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(text: Column) -> Column:
    """A register's content as a number: an integer if it is one, else a float, else null."""
    return F.coalesce(text.try_cast("bigint").cast("double"), text.try_cast("double"))


def matches(value: Column, pattern: str) -> Column:
    """Equality for a pattern of letters and digits alone, else a regular expression for the whole value."""
    return value == pattern if re.fullmatch("[A-Za-z0-9]*", pattern) else value.rlike(f"^(?:{pattern})$")


def packed(ts: Column, replica: Column) -> Column:
    """48 bits of timestamp above 16 bits of replica, which orders as the pair does."""
    return F.shiftleft(ts.cast("bigint"), 16).bitwiseOR(replica.cast("bigint").bitwiseAND(F.lit(0xFFFF)))


def unpacked(value: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(value, 16), value.bitwiseAND(F.lit(0xFFFF)).cast("smallint")


def bounded(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def shown(state: Column) -> Column:
    """A state as text."""
    return F.to_json(state)


def partition_of(n: int, *key: Column) -> Column:
    """The partition, of n hash ranges, that an object's key falls in."""
    return F.shiftright(F.shiftrightunsigned(F.xxhash64(*key), 33) * F.lit(n).cast("long"), 31).cast("int")


#: SQL types of declared columns, and the kind of object each is kept in.
OBJECT_OF = {"COUNTER": "COUNTER", "BOUNDED COUNTER": "FATCOUNTER", "BOOLEAN": "FLAG_LWW"}
NATIVE_OF = {"COUNTER": T.LongType(), "BOUNDED COUNTER": T.LongType(), "BOOLEAN": T.BooleanType(), "INTEGER": T.LongType(), "DATE": T.DateType(), "DOUBLE": T.DoubleType()}


def object_type(sql_type: str) -> str:
    return OBJECT_OF.get(sql_type.upper(), "LWWREG")


def literal_op(sql_type: str, literal: str) -> tuple[str, object]:
    """The operation that sets a column of a declared type from a literal."""
    kind = object_type(sql_type)
    if kind in ("COUNTER", "FATCOUNTER"):
        return "inc", int(literal)
    if kind == "FLAG_LWW":
        return ("enable", True) if literal.strip().lower() == "true" else ("disable", False)
    return "set", literal
