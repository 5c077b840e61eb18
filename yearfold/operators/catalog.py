"""Metadata as DataFrames: configured tables, constraints and column definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearfold.functions.scalars import HELPER_PREFIX, is_helper, mapped

# The one-letter kinds of relations in catalogs, and the schemas of the system.
RELATION_KINDS = {"r": "table", "p": "partitioned table", "v": "view", "m": "materialized view", "i": "index", "S": "sequence", "f": "foreign table", "t": "toast table", "c": "composite type"}
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")


def config_resolution(config: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, field, pk_column): names in lower case; of several fields the first in order, of key columns all."""
    c = config.select("table_id", "column_id").distinct().join(tables.select("table_id", F.lower("table_name").alias("table_name")), "table_id")
    f = c.join(columns.select("table_id", "column_id", F.lower("column_name").alias("field")), ["table_id", "column_id"])
    k = columns.where("is_key = 'Y'").select("table_id", F.lower("column_name").alias("pk_column"))
    one = f.groupBy("table_id", "table_name").agg(F.min("field").alias("field"))
    return one.join(k, "table_id").select("table_name", "field", "pk_column")


def fields_by_table(config: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, fields): all configured fields of a table, sorted."""
    c = config.join(tables, "table_id").join(columns.select("table_id", "column_id", "column_name"), ["table_id", "column_id"])
    return c.groupBy(F.lower("table_name").alias("table_name")).agg(F.array_sort(F.collect_set(F.lower("column_name"))).alias("fields"))


def configured_tables(tables: DataFrame, config: DataFrame) -> DataFrame:
    return tables.join(config, "table_id", "left_semi").select(F.lower("table_name").alias("table_name"))


def related_tables(usage: DataFrame, parent: str, children_of: DataFrame | None = None) -> DataFrame:
    """(table_schema, table_name, constraint_name, fk_columns, referenced_columns) of keys that refer to the parent.

    usage has a row per column of a key, with its place; columns are paired by that place.
    children_of (child, parent) leads partitions to the table they belong to; then equal rows are one.
    """
    u = usage.where(F.lower("referenced_table") == parent.lower())
    if children_of is not None:
        u = u.join(children_of, F.col("table_name") == F.col("child"), "left").withColumn("table_name", F.coalesce("parent", "table_name"))
    u = u.select("table_schema", "table_name", "constraint_name", "ordinal", "column_name", "referenced_column").distinct()
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "referenced_column")))
    g = u.groupBy("table_schema", "table_name", "constraint_name").agg(pairs.alias("p"))
    return g.select("table_schema", "table_name", "constraint_name", F.transform("p", lambda s: s["column_name"]).alias("fk_columns"), F.transform("p", lambda s: s["referenced_column"]).alias("referenced_columns")).orderBy("table_schema", "table_name", "constraint_name")


def column_names(numbers: DataFrame, columns: DataFrame, array: str = "numbers") -> DataFrame:
    """(id, names): names of column numbers in the order given; numbers without a column are left out."""
    at = numbers.select("id", F.posexplode(array).alias("pos", "number")).join(columns, "number")
    g = at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("p"))
    return g.select("id", F.transform("p", lambda s: s["name"]).alias("names"))


def helper_like(c: Column) -> Column:
    return F.startswith(F.lower(c), F.lit(HELPER_PREFIX))


def compound_keys(usage: DataFrame, is_helper_column) -> DataFrame:
    """(constraint_name, table_name, columns, referenced): two-column keys with a helper column, not can_defer; names joined in order."""
    g = usage.where(~F.col("can_defer")).groupBy("constraint_name", "table_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "referenced_column"))).alias("p"))
    named = g.where(F.size("p") == 2).where(F.exists("p", lambda s: is_helper_column(s["column_name"])))
    return named.select("constraint_name", "table_name", F.array_join(F.transform("p", lambda s: s["column_name"]), ", ").alias("columns"), F.array_join(F.transform("p", lambda s: s["referenced_column"]), ", ").alias("referenced"))


def foreign_keys(keys: DataFrame, table: str, direction: str) -> DataFrame:
    """Keys 'on' a table (its own) or 'to' it (of others)."""
    if direction not in ("on", "to"):
        raise ValueError(f"direction: {direction!r}")
    return keys.where(F.lower("table_name" if direction == "on" else "referenced_table") == table.lower())


def dependent_views(views: DataFrame, table: str) -> DataFrame:
    return views.where(F.lower("table_name") == table.lower()).select("view_schema", "view_name", "definition").distinct()


def partition_parent(tables: DataFrame, inherits: DataFrame) -> DataFrame:
    """(table_name, parent): itself where it is no partition."""
    return tables.select("table_name").join(inherits, F.col("table_name") == F.col("child"), "left").select("table_name", F.coalesce("parent", "table_name").alias("parent"))


def first_definitions(defs: DataFrame) -> DataFrame:
    """One definition for each column of each table: the first by file and place."""
    w = Window.partitionBy("table_name", F.lower("column_name")).orderBy("file_order", "place")
    return defs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def column_diff(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """(column_name, change): 'added' if only wanted, 'removed' if only there, by name in any case."""
    w, a = (d.select(F.lower("column_name").alias("column_name")).distinct() for d in (wanted, actual))
    return w.join(a, "column_name", "left_anti").withColumn("change", F.lit("added")).union(a.join(w, "column_name", "left_anti").withColumn("change", F.lit("removed")))


def changed_tables(tables: DataFrame, wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, changed) of each table: whether the names of its defined and actual columns differ, in any case. No definition counts as a change."""
    names = lambda df, side: df.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct().withColumn(side, F.lit(True))
    both = names(wanted, "w").join(names(actual, "a"), ["t", "c"], "full").groupBy("t").agg(F.bool_and(F.col("w").isNotNull() & F.col("a").isNotNull()).alias("same"))
    return tables.join(both, F.lower("table_name") == F.col("t"), "left").select("table_name", (~F.coalesce("same", F.lit(False))).alias("changed"))


def is_changed(wanted: DataFrame, actual: DataFrame) -> bool:
    """No definition at all counts as a change."""
    return wanted.isEmpty() or not column_diff(wanted, actual).isEmpty()


def keys_to(definitions: DataFrame, target: str) -> DataFrame:
    """(table_name, key_name) of definitions whose keys refer to the target, each key once."""
    f = definitions.select("table_name", F.explode("keys").alias("k"))
    return f.where(F.lower("k.target") == target.lower()).select("table_name", F.col("k.name").alias("key_name")).dropDuplicates(["table_name", "key_name"])


def column_metadata(df: DataFrame, schema: str, table: str, column: str | None = None) -> DataFrame:
    """(table_schema, table_name, ordinal, column_name, data_type, is_nullable) of a dataset's columns, or of one of them, by name in any case."""
    rows = [(schema, table, i, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO") for i, f in enumerate(df.schema, 1) if column is None or f.name.lower() == column.lower()]
    return df.sparkSession.createDataFrame(rows, "table_schema string, table_name string, ordinal int, column_name string, data_type string, is_nullable string")


def own_columns(metadata: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_name, ordinal, column_name, is_key) without helpers; is_key tells the columns of the primary key."""
    k = keys.where("kind = 'p'").select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct().withColumn("is_key", F.lit(True))
    m = metadata.where(~helper_like(F.col("column_name")))
    j = m.join(k, (F.lower("table_name") == F.col("t")) & (F.lower("column_name") == F.col("c")), "left")
    return j.select("table_name", "ordinal", "column_name", F.coalesce("is_key", F.lit(False)).alias("is_key"))


def user_relations(relations: DataFrame) -> DataFrame:
    """Relations outside the schemas of the system, with a label of their kind; unknown kinds keep their letter."""
    label = F.coalesce(mapped(F.col("kind"), RELATION_KINDS, None), F.col("kind"))
    return relations.where(~F.col("table_schema").isin(*SYSTEM_SCHEMAS)).withColumn("label", label)


def existing(wanted: DataFrame, there: DataFrame, on: list[str]) -> DataFrame:
    """wanted with found: whether a row of `there` has the same names, in any case. Nulls are never found."""
    names = there.select(*[F.lower(c).alias(f"__{c}") for c in on]).distinct().withColumn("__found", F.lit(True))
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.lower(c) == F.col(f"__{c}"))
    return wanted.join(names, cond, "left").select(*wanted.columns, F.coalesce("__found", F.lit(False)).alias("found"))


def table_triggers(triggers: DataFrame, table: str) -> DataFrame:
    """(trigger_name, definition) of the table's own triggers, without those of the system."""
    return triggers.where((F.lower("table_name") == table.lower()) & ~F.col("is_internal")).select("trigger_name", "definition")


def constraint_definitions(keys: DataFrame) -> DataFrame:
    """(table_name, constraint_name, definition) in words, columns in the order of their places."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "referenced_column"))).alias("p")
    g = keys.groupBy("table_name", "constraint_name", "kind", "referenced_table", "on_delete").agg(pairs)
    names = lambda c: F.array_join(F.transform("p", lambda s: s[c]), ", ")
    foreign = F.concat(F.lit("FOREIGN KEY ("), names("column_name"), F.lit(") REFERENCES "), F.col("referenced_table"), F.lit(" ("), names("referenced_column"), F.lit(")"), F.when(F.col("on_delete") != "NO ACTION", F.concat(F.lit(" ON DELETE "), F.col("on_delete"))).otherwise(""))
    plain = F.concat(F.when(F.col("kind") == "p", "PRIMARY KEY (").otherwise("UNIQUE ("), names("column_name"), F.lit(")"))
    return g.select("table_name", "constraint_name", F.when(F.col("kind") == "f", foreign).otherwise(plain).alias("definition"))


def without_helpers(columns: list[str]) -> list[str]:
    return [c for c in columns if not is_helper(c)]
