"""Which snapshots stay, and small metadata tables that are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT, DAYS = 5, 7


def to_delete(backups: DataFrame, as_of: Column, table: str = "table_name", created: str = "created_at", name: str = "backup_name", kept: int = KEPT, days: int = DAYS) -> DataFrame:
    """Snapshots beyond the newest of their table, or older than the days; one of exactly that age stays.

    Equal times go by name, the higher first. Names of tables count in any case. Every table is
    ranked in one pass, by one shuffle on its name.
    """
    w = Window.partitionBy(F.lower(F.col(table).cast("string"))).orderBy(F.desc(created), F.desc(name))
    ranked = backups.withColumn("__rank", F.row_number().over(w))
    return ranked.where((F.col("__rank") > kept) | (F.col(created) < as_of - F.make_interval(days=F.lit(days)))).drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, a null key included; where both have it, the new one. A key that is twice among the new ones raises."""
    names = new.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    names = names.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"new rows repeat {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")).otherwise(True))
    names = names.select(F.col(key).alias("__key"))
    kept = old.join(names, F.col(key).eqNullSafe(F.col("__key")), "left_anti").select(*old.columns)
    # new rows pass the same check, whatever becomes of the old ones
    return kept.union(new.join(names, F.col(key).eqNullSafe(F.col("__key")), "left_semi").select(*old.columns))


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti").select(*df.columns)
