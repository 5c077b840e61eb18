"""Scalar rules of names, years, types and messages, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELPER_PREFIX = "part_"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

# Column types of table definitions and what they are stored as.
TYPE_NAMES = {"VARCHAR": "string", "NVARCHAR": "string", "CHAR": "string", "NCHAR": "string", "CLOB": "string", "TEXT": "string", "DECIMAL": "decimal(38,18)", "NUMERIC": "decimal(38,18)", "INTEGER": "int", "BIGINT": "bigint", "TIMESTAMP": "timestamp_ntz", "DATE": "timestamp_ntz", "BOOLEAN": "boolean", "BLOB": "binary"}
# Spellings of delete actions, and the one-letter codes of catalogs.
ON_DELETE = {"cascade": "CASCADE", "set null": "SET NULL", "setnull": "SET NULL", "restrict": "RESTRICT", "no action": "NO ACTION", "noaction": "NO ACTION"}
DELETE_CODES = {"c": "CASCADE", "n": "SET NULL", "r": "RESTRICT", "d": "SET DEFAULT", "a": "NO ACTION"}


def mapped(c: Column, values: dict[str, str], otherwise: str | None) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in values.items():
        out = out.when(c == k, v)
    return out.otherwise(otherwise)


def stored_type(c: Column) -> Column:
    """The stored type of a definition's type; unknown types are kept as text."""
    return mapped(F.upper(F.trim(c)), TYPE_NAMES, "string")


def on_delete(c: Column) -> Column:
    """The action of a definition; blank, null and unknown ones do nothing."""
    return F.coalesce(mapped(F.lower(F.trim(c)), ON_DELETE, "NO ACTION"), F.lit("NO ACTION"))


def delete_code(c: Column) -> Column:
    return F.coalesce(mapped(c, DELETE_CODES, "NO ACTION"), F.lit("NO ACTION"))


def sanitized(c: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and _ replaced by _; null is 'unknown'."""
    return F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), F.lit("unknown"))


def lenient_int(c: Column) -> Column:
    """Blank or null is 0, a comma counts as a point, fractions are rounded half up; anything else raises."""
    t = F.replace(F.trim(c), F.lit(","), F.lit("."))
    number = F.expr("1").cast("int")  # keeps the type of both branches
    number = F.coalesce(t.try_cast("int"), F.floor(t.try_cast("double") + 0.5).cast("int"), F.raise_error(F.concat(F.lit("not a number: "), c)).cast("int"))
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(0)).otherwise(number)


def yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "y", "yes", "1"), F.lit(False))


def brief(c: Column, most: int = 100) -> Column:
    """A message on one line, of bounded length."""
    return F.substring(F.regexp_replace(c, r"[\r\n]+", " "), 1, most)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def helper_name(field: str, key: str) -> str:
    """Of the column on a child that holds its parent's partition value."""
    return f"{HELPER_PREFIX}{field}__{key}".lower()


def helper_column(field: Column, key: Column) -> Column:
    return F.lower(F.concat(F.lit(HELPER_PREFIX), field, F.lit("__"), key))


def is_helper(name: str) -> bool:
    """The prefix counts literally: '_' is no wildcard."""
    return name.lower().startswith(HELPER_PREFIX)


def partition_name(table: Column, year: Column) -> Column:
    return F.concat(table, F.lit("_y"), year.cast("string"))


def trigger_names(table: Column, key: Column) -> tuple[Column, Column]:
    """Names of the fill rule of a child's key and of its function."""
    stem = F.concat(sanitized(table), F.lit("_"), sanitized(key))
    return F.concat(stem, F.lit("_trg")), F.concat(stem, F.lit("_fill"))


def checked_name(name: str) -> str:
    """An identifier, quoted; raises for anything else."""
    if not NAME.fullmatch(name or ""):
        raise ValueError(f"not an identifier: {name!r}")
    return f"`{name}`"


def is_name(c: Column) -> Column:
    """Whether it is an identifier; null is none."""
    return F.coalesce(c.rlike(f"^{NAME.pattern}$"), F.lit(False))


def is_partition_key(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
