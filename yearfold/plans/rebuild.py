"""Plans as rows: what would be done, in order, without doing it."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yearfold.functions.scalars import helper_column, on_delete, stored_type, trigger_names

STEPS = ("check field", "sync related tables", "record dependent views", "record foreign keys", "record triggers", "record primary key", "stage by year", "verify", "publish")


def partition_plan(spark: SparkSession, table: str, field: str, related: list[str]) -> DataFrame:
    """(step, action, target): the dry run of partitioning a table."""
    rows, n = [], 0
    for action in STEPS:
        for target in related if action == STEPS[1] else [f"{table}.{field}" if action == STEPS[0] else table]:
            n += 1
            rows.append((n, action, target))
    return spark.createDataFrame(rows, "step int, action string, target string")


def skip_decision(incomplete: Column, first_run: Column, unchanged: Column) -> Column:
    """Whether a table needs nothing: its settings are incomplete, or it was done before and has not changed."""
    return incomplete | (~first_run & unchanged)


def constraint_plan(keys: DataFrame, parent: str, pk: str, partition: str, partitioned: bool) -> DataFrame:
    """(step, action, target, columns, on_update, on_delete) to rebuild the parent's key and those of its children.

    keys: (table_name, key_name, column_name, on_delete), each key once. A partitioned parent's
    key holds the partition value too, and its children refer to both through their helpers.
    """
    spark = keys.sparkSession
    own = f"{pk}, {partition}" if partitioned else pk
    head = spark.createDataFrame([(1, "drop primary key", parent, pk), (2, "add primary key", parent, own)], "step int, action string, target string, columns string")
    head = head.select("*", F.lit(None).cast("string").alias("on_update"), F.lit(None).cast("string").alias("on_delete"))
    k = keys.dropDuplicates(["table_name", "key_name"])
    target = F.concat("table_name", F.lit("."), "key_name")
    helper = helper_column(F.lit(partition), F.col("key_name"))
    cols = F.concat(F.col("column_name"), F.lit(", "), helper) if partitioned else F.col("column_name")
    update = F.lit("CASCADE" if partitioned else "NO ACTION")
    steps = [(3, "drop foreign key", F.col("column_name"))] + ([(4, "add helper", helper), (5, "fill helper", helper)] if partitioned else []) + [(6, "add foreign key", cols)]
    out = [k.select(F.lit(n).alias("step"), F.lit(a).alias("action"), target.alias("target"), c.alias("columns"), (update if n == 6 else F.lit(None).cast("string")).alias("on_update"), (on_delete(F.col("on_delete")) if n == 6 else F.lit(None).cast("string")).alias("on_delete")) for n, a, c in steps]
    return reduce(DataFrame.union, [head, *out])


def alter_plan(diff: DataFrame, definitions: DataFrame, drop_columns: bool = False) -> DataFrame:
    """(column_name, action, type): added columns with their stored type; removed ones only go where that is asked for."""
    d = definitions.select(F.lower("column_name").alias("column_name"), "type", "required")
    add = diff.where("change = 'added'").join(d, "column_name").select("column_name", F.when(F.lower("required") == "true", "add not null").otherwise("add").alias("action"), stored_type(F.col("type")).alias("type"))
    gone = diff.where("change = 'removed'").select("column_name", F.lit("drop" if drop_columns else "keep").alias("action"), F.lit(None).cast("string").alias("type"))
    return add.union(gone)


def exclude_names(primary_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """(kind, name) in upper case of all that partitioning adds: keys, helpers, fill rules and their functions."""
    trg, fn = trigger_names(F.col("table_name"), F.col("key_name"))
    parts = [
        primary_keys.select(F.lit("primary key").alias("kind"), F.upper("name").alias("name")),
        keys.select(F.lit("foreign key").alias("kind"), F.upper("key_name").alias("name")),
        keys.select(F.lit("column").alias("kind"), F.upper(helper_column(F.col("field"), F.col("key_name"))).alias("name")),
        keys.select(F.lit("trigger").alias("kind"), F.upper(trg).alias("name")),
        keys.select(F.lit("function").alias("kind"), F.upper(fn).alias("name")),
    ]
    return reduce(DataFrame.union, parts).distinct()


def exclude_xml(names: DataFrame) -> str:
    """The same as a filter file's text; the names of a schema are few."""
    from xml.sax.saxutils import quoteattr

    tags = {"column": "excludedColumn", "trigger": "excludedTrigger", "function": "excludedFunction"}
    rows = sorted((r.kind, r.name) for r in names.collect())
    body = "".join(f"  <{tags.get(k, 'excludedConstraint')} name={quoteattr(n)}/>\n" for k, n in rows)
    return f'<?xml version="1.0"?>\n<vector>\n{body}</vector>\n'


def write_exclude_filter(names: DataFrame, path: str) -> None:
    """The filter's file, on the driver's machine, where builds read it."""
    Path(path).write_text(exclude_xml(names), encoding="utf-8")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """(status, n_tables, n_rows) of a run's outcomes."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").alias("n_rows"))
