"""Partitioning a table together with the tables that refer to it: all of it is published, or nothing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearfold.functions.scalars import helper_name
from yearfold.operators import catalog, integrity, propagate
from yearfold.sources import definitions, storage
from yearfold.sources.registry import Registry
from yearfold.sources.storage import Outcome, PartitionError

DETAIL = "table_name string, constraint_name string, status string, n_updated long, n_null long, message string"


@dataclass(frozen=True)
class Child:
    table: str
    constraint: str
    path: str
    keys: tuple[tuple[str, str], ...]  # (own column, parent's column)


@dataclass(frozen=True)
class Detail:
    table_name: str
    constraint_name: str
    status: str  # SUCCESS, FAILURE, or ESTIMATE in a dry run
    n_updated: int = 0
    n_null: int = 0
    message: str = ""

    def row(self) -> tuple:
        return (self.table_name, self.constraint_name, self.status, self.n_updated, self.n_null, self.message)


def children_of(registry: Registry, table: str) -> list[Child]:
    """The tables whose live foreign keys refer to the table, partitions led to their parents; those without a known dataset raise."""
    usage = registry.get("keys").where("kind = 'f' AND live").where(~catalog.helper_like(F.col("column_name")))
    return [Child(r.table_name, r.constraint_name, registry.table(r.table_name).path, tuple(zip(r.fk_columns, r.referenced_columns, strict=True))) for r in catalog.related_tables(usage, table).collect()]


def prerequisites(registry: Registry, table: str, field: str) -> list[str]:
    """Warnings about the table; raises if the field is missing, of another type or null somewhere."""
    df = registry.read(table)
    storage.check_field(df, field)
    if not df.where(F.col(field).isNull()).isEmpty():
        raise PartitionError(f"{field} has null values")
    return [] if registry.has_primary_key(table) else [f"{table} has no primary key"]


def _helped(child: DataFrame, parent: DataFrame, c: Child, field: str) -> DataFrame:
    return propagate.sync(child, parent, list(c.keys), field, helper_name(field, c.constraint))


def _stage(spark: SparkSession, c: Child, df: DataFrame, parent: DataFrame, field: str, staged: str) -> Detail:
    helper = helper_name(field, c.constraint)
    n = propagate.estimate(df, parent, list(c.keys), field, helper).first().n
    new = _helped(df, parent, c, field)
    new.write.parquet(staged)
    written = spark.read.schema(new.schema).parquet(staged)
    if storage.digest(written.drop(helper))[0] != df.count():
        raise PartitionError("rows were lost or gained")
    v = propagate.validate(written, list(c.keys), helper).first()
    return Detail(c.table, c.constraint, "SUCCESS" if v.success else "FAILURE", n if v.success else 0, v.n_null, "" if v.success else f"{v.n_null} of {v.total} helpers stay null")


def partition_related(spark: SparkSession, path: str, field: str, children: list[Child], dry_run: bool = False) -> tuple[Outcome, list[Detail]]:
    """Partitions the dataset by year of the field after adding, filling and checking a helper on each child.

    Everything is staged first. If a child fails, or the parent's key repeats, nothing is published
    and the outcome says why; the other children's details are kept. Several keys of one child are
    handled in turn on one staged copy. A dry run only counts what would change.
    """
    if storage.is_partitioned(spark, path):
        return Outcome(path, "SKIPPED", "already partitioned"), []
    parent, details, staged, current = spark.read.parquet(path), [], [], {}
    try:
        storage.check_field(parent, field)
        for c in children:
            df = spark.read.parquet(current.get(c.path, c.path))
            try:
                if dry_run:
                    n = propagate.estimate(df, parent, list(c.keys), field, helper_name(field, c.constraint)).first().n
                    details.append(Detail(c.table, c.constraint, "ESTIMATE", n))
                    continue
                new = storage.staging(c.path)
                staged.append(new)
                detail = _stage(spark, c, df, parent, field, new)
                current[c.path] = new
            except Exception as e:
                detail = Detail(c.table, c.constraint, "FAILURE", message=_brief(e))
            details.append(detail)
        failed = [d for d in details if d.status == "FAILURE"]
        if failed:
            raise PartitionError(f"{len(failed)} of {len(children)} related tables failed: " + "; ".join(f"{d.table_name}: {d.message}" for d in failed))
        if dry_run:
            return Outcome(path, "SKIPPED", "dry run"), details
        own = storage.staging(path)
        staged.append(own)
        # a table that refers to itself has its helper by now
        n = storage.stage_partitioned(spark.read.parquet(current.pop(path, path)), field, own)
        storage.publish_all(spark, [*((new, old) for old, new in current.items()), (own, path)])
        return Outcome(path, "SUCCESS", "", n), details
    except Exception as e:
        details = [replace(d, status="FAILURE", n_updated=0, message=d.message or "not published") for d in details]
        return Outcome(path, "FAILURE", _brief(e)), details
    finally:
        for s in staged:
            storage.remove(spark, s)


def _brief(e: Exception) -> str:
    text = " ".join(str(e).split())
    at = text.find("the parent's key")  # Spark wraps the errors that plans raise
    return text[max(0, at) :][:150]


def details_frame(spark: SparkSession, details: list[Detail]) -> DataFrame:
    return spark.createDataFrame([d.row() for d in details], DETAIL)


def related_totals(details: DataFrame) -> DataFrame:
    """One row (n_tables, n_success, n_failed, n_updated) of the related tables of a run."""
    ok = F.col("status") == "SUCCESS"
    return details.agg(F.count(F.lit(1)).alias("n_tables"), F.count_if(ok).alias("n_success"), F.count_if(F.col("status") == "FAILURE").alias("n_failed"), F.coalesce(F.sum(F.when(ok, F.col("n_updated"))), F.lit(0)).alias("n_updated"))


def partition(registry: Registry, table: str, field: str, dry_run: bool = False) -> tuple[Outcome, list[Detail]]:
    """A table of the registry with those that refer to it. Its views, keys and triggers are marked as dropped; their definitions stay."""
    row = registry.table(table)
    if storage.is_partitioned(registry.spark, row.path):
        return Outcome(table, "SKIPPED", "already partitioned"), []
    warnings = prerequisites(registry, table, field)
    outcome, details = partition_related(registry.spark, row.path, field, children_of(registry, table), dry_run)
    if outcome.status == "SUCCESS":
        registry.set_live(table, False)
        known = registry.get("tables")
        own = F.lower("table_name") == table.lower()
        registry.put("tables", known.withColumn("kind", F.when(own, "p").otherwise(F.col("kind"))).withColumn("field", F.when(own, field).otherwise(F.col("field"))))
    return replace(outcome, table=table, message="; ".join(filter(None, [outcome.message, *warnings]))), details


def unpartition(registry: Registry, table: str) -> Outcome:
    """The table plain again, without its helpers; keys that hold a helper go, the others, its views and triggers live again, and its setting goes."""
    row = registry.table(table)
    outcome = replace(storage.unpartition_table(registry.spark, row.path), table=table)
    if outcome.status == "SUCCESS":
        registry.set_live(table, True)
        keys = registry.get("keys")
        with_helper = keys.where(catalog.helper_like(F.col("column_name"))).select("table_name", "constraint_name").distinct()
        mine = with_helper.where(F.lower("table_name") == table.lower())
        registry.put("keys", keys.join(mine, ["table_name", "constraint_name"], "left_anti"))
        own = F.lower("table_name") == table.lower()
        known = registry.get("tables")
        registry.put("tables", known.withColumn("kind", F.when(own, "r").otherwise(F.col("kind"))).withColumn("field", F.when(own, F.lit(None).cast("string")).otherwise(F.col("field"))))
        registry.remove_config(table)
    return outcome


def add_config(registry: Registry, table: str, field: str) -> None:
    """Configures the table to be partitioned by the field; raises where it has a unique constraint or null keys."""
    storage.check_field(registry.read(table), field)
    integrity.check_new_config(registry.read(table), field, registry.has_unique(table))
    registry.add("config", [(table, field)])


def remove_config(registry: Registry, table: str) -> None:
    """Takes the setting back; raises while the table is partitioned."""
    integrity.check_config_delete(registry.is_partitioned(table))
    registry.remove_config(table)


def forced(registry: Registry, files: list[str], table: str, now: dt.datetime) -> bool:
    """Whether definitions that changed since the table was processed refer to it. Then now is noted, so that the same files do not force it again."""
    last = registry.last_processed(table)
    since = last.replace(tzinfo=dt.timezone.utc).timestamp() if last else 0.0
    found = definitions.newer_references(files, table, since)
    if found:
        registry.set_processed(table, now)
    return found
