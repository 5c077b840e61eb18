"""Copies of a parent's partition value on the rows of its children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = list[tuple[str, str]]  # (child's column, parent's column), all of which have to match


def _parent(parent: DataFrame, keys: Keys, field: str) -> DataFrame:
    """One row for each key, by one shuffle on the key that the join needs as well. A key that occurs twice raises."""
    own = parent.select(*[F.col(p).alias(f"__k{i}") for i, (_, p) in enumerate(keys)], F.col(field).alias("__value")).dropna(subset=[f"__k{i}" for i in range(len(keys))])
    one = own.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.max("__value").alias("__value"), F.count(F.lit(1)).alias("__n"))
    text = F.concat(F.lit(f"the parent's key {[p for _, p in keys]} is not unique: "), F.concat_ws(", ", *[F.col(f"__k{i}").cast("string") for i in range(len(keys))]))
    return one.where(F.when(F.col("__n") > 1, F.raise_error(text).cast("boolean")).otherwise(True)).drop("__n").withColumn("__there", F.lit(True))


def _match(keys: Keys) -> Column:
    out = F.lit(True)
    for i, (c, _) in enumerate(keys):
        out = out & (F.col(c) == F.col(f"__k{i}"))
    return out


def assert_unique(parent: DataFrame, keys: Keys) -> None:
    """Raises if the parent's key repeats: the join would multiply the child's rows."""
    cols = [p for _, p in keys]
    whole = parent.dropna(subset=cols)
    if not whole.groupBy(*cols).count().where("count > 1").isEmpty():
        raise ValueError(f"the parent's key {cols} is not unique")


def add_helper(child: DataFrame, helper: str, kind) -> DataFrame:
    """The child with an empty helper column of the parent's type; one that is there stays."""
    return child if helper in child.columns else child.withColumn(helper, F.lit(None).cast(kind))


def sync(child: DataFrame, parent: DataFrame, keys: Keys, field: str, helper: str) -> DataFrame:
    """Helpers of matched rows become the parent's value where they differ from it; others stay."""
    child = add_helper(child, helper, parent.schema[field].dataType)
    j = child.join(_parent(parent, keys, field), _match(keys), "left")
    new = F.when(F.col("__there") & ~F.col(helper).eqNullSafe(F.col("__value")), F.col("__value")).otherwise(F.col(helper))
    return j.withColumn(helper, new).select(*child.columns)


def fill(child: DataFrame, parent: DataFrame, keys: Keys, field: str, helper: str) -> DataFrame:
    """Only helpers that are null get the parent's value."""
    child = add_helper(child, helper, parent.schema[field].dataType)
    j = child.join(_parent(parent, keys, field), _match(keys), "left")
    return j.withColumn(helper, F.coalesce(helper, "__value")).select(*child.columns)


def estimate(child: DataFrame, parent: DataFrame, keys: Keys, field: str, helper: str) -> DataFrame:
    """One row (n): how many rows sync would change. A helper that isn't there yet counts as null."""
    child = add_helper(child, helper, parent.schema[field].dataType)
    j = child.join(_parent(parent, keys, field), _match(keys)).where(~F.col(helper).eqNullSafe(F.col("__value")))
    return j.agg(F.count(F.lit(1)).alias("n"))


def validate(child: DataFrame, keys: Keys, helper: str) -> DataFrame:
    """One row (total, n_null, n_populated, success) over rows whose key is not null in any column."""
    whole = F.lit(True)
    for c, _ in keys:
        whole = whole & F.col(c).isNotNull()
    a = child.agg(F.count_if(whole).alias("total"), F.count_if(whole & F.col(helper).isNull()).alias("n_null"))
    return a.select("total", "n_null", (F.col("total") - F.col("n_null")).alias("n_populated"), (F.col("n_null") == 0).alias("success"))
