"""Checks of keys, and what deleting or changing parents does to children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearfold.operators.propagate import Keys, sync


class IntegrityError(ValueError):
    pass


def null_key_flag(df: DataFrame, column: str) -> DataFrame:
    """One row (has_null): 'Y' or 'N'; 'N' for an empty table."""
    return df.agg(F.when(F.coalesce(F.bool_or(F.col(column).isNull()), F.lit(False)), "Y").otherwise("N").alias("has_null"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their rows counted; empty if the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def primary_key_violations(df: DataFrame, keys: list[str], partition: str | None = None) -> DataFrame:
    """(rule, n) of the key alone, of key and partition value, and of nulls in the key: rows are counted once, by both, and rolled up."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    pairs = df.groupBy(*keys, *([partition] if partition else [])).agg(F.count(F.lit(1)).alias("__n"))
    each = pairs.groupBy(*keys).agg(F.sum("__n").alias("__rows"), F.count_if(F.col("__n") > 1).alias("__pairs"))
    total = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rule = lambda name, c: F.struct(F.lit(name).alias("rule"), c.alias("n"))
    out = [rule("key", F.count_if(F.col("__rows") > 1)), *([rule("key and partition", total(F.sum("__pairs")))] if partition else []), rule("null", total(F.sum(F.when(null, F.col("__rows")))))]
    return each.agg(F.array(*out).alias("rules")).select(F.inline("rules"))


def orphans(child: DataFrame, parent: DataFrame, keys: Keys) -> DataFrame:
    """The child's rows without a parent; a null in any key column passes. Empty if the key holds."""
    p = parent.select(*[F.col(x).alias(f"__k{i}") for i, (_, x) in enumerate(keys)])
    cond = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(keys)))
    return child.dropna(subset=[c for c, _ in keys]).join(p, cond, "left_anti")


def _of(child: DataFrame, gone: DataFrame, keys: Keys, how: str) -> DataFrame:
    g = gone.select(*[F.col(x).alias(f"__k{i}") for i, (_, x) in enumerate(keys)])
    cond = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(keys)))
    return child.join(g, cond, how)


def on_delete_cascade(child: DataFrame, gone: DataFrame, keys: Keys) -> DataFrame:
    """The child without rows of parents that are gone."""
    return _of(child, gone, keys, "left_anti")


def on_delete_set_null(child: DataFrame, gone: DataFrame, keys: Keys, also: list[str] | None = None) -> DataFrame:
    """The child with its key columns (and also, such as the helper) null where the parent is gone."""
    g = gone.select(*[F.col(x).alias(f"__k{i}") for i, (_, x) in enumerate(keys)]).distinct().withColumn("__gone", F.lit(True))
    cond = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__k{i}") for i, (c, _) in enumerate(keys)))
    j = child.join(g, cond, "left")
    hit = {c for c, _ in keys} | set(also or ())
    return j.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c in hit else F.col(c) for c in child.columns])


def on_delete_restrict(child: DataFrame, gone: DataFrame, keys: Keys) -> DataFrame:
    """One row (n_blocking): children that forbid the deletion."""
    return _of(child, gone, keys, "left_semi").agg(F.count(F.lit(1)).alias("n_blocking"))


def restrict(child: DataFrame, gone: DataFrame, keys: Keys) -> None:
    n = on_delete_restrict(child, gone, keys).first()[0]
    if n:
        raise IntegrityError(f"{n} rows still refer to what is to be deleted")


#: An update of the parent's partition value reaches its children as sync does.
on_update_cascade = sync


def config_guard(cases: DataFrame) -> DataFrame:
    """cases with verdict: accept or reject. event is new or delete; has_null and partitioned may be null, which says that the question failed."""
    new = F.when(F.col("has_unique"), "reject").when(F.col("has_null").isNull() | (F.col("has_null") == "Y"), "reject").otherwise("accept")
    gone = F.when(F.coalesce("partitioned", F.lit(True)), "reject").otherwise("accept")
    return cases.withColumn("verdict", F.when(F.col("event") == "new", new).when(F.col("event") == "delete", gone).otherwise("accept"))


def check_new_config(df: DataFrame, column: str, has_unique: bool) -> None:
    """Raises where a table cannot be partitioned by the column."""
    if has_unique:
        raise IntegrityError("the table has a unique constraint")
    if null_key_flag(df, column).first()[0] == "Y":
        raise IntegrityError("the column has null values")


def check_config_delete(partitioned: bool) -> None:
    if partitioned:
        raise IntegrityError("the table is already partitioned")
