"""What is known of a set of datasets: tables, keys, views, triggers, settings and snapshots, as small datasets in one folder."""

from __future__ import annotations

import datetime as dt
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearfold.functions.scalars import checked_name
from yearfold.operators import catalog, retention
from yearfold.sources import storage

SCHEMAS = {
    "tables": "table_schema string, table_name string, kind string, path string, field string",
    "keys": "table_schema string, table_name string, constraint_name string, kind string, ordinal int, column_name string, referenced_table string, referenced_column string, on_delete string, can_defer boolean, live boolean",
    "views": "view_schema string, view_name string, table_name string, definition string, live boolean",
    "triggers": "table_schema string, table_name string, trigger_name string, definition string, is_internal boolean, live boolean",
    "config": "table_name string, field string",
    "backups": "backup_name string, table_name string, created_at timestamp_ntz",
    "processed": "table_name string, last_processed timestamp_ntz",
}


class KeyContext(Protocol):
    """What rebuilding keys asks about tables."""

    def is_partitioned(self, table: str) -> bool: ...

    def has_column(self, table: str, column: str) -> bool: ...

    def has_primary_key(self, table: str) -> bool: ...


class Registry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def ensure(self) -> None:
        """Creates what is not there yet."""
        for name, schema in SCHEMAS.items():
            if not storage.exists(self.spark, f"{self.folder}/{name}"):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")

    def get(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def put(self, name: str, df: DataFrame) -> None:
        """df, which may read the old rows, takes their place."""
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        path = f"{self.folder}/{name}"
        staged = storage.staging(path)
        df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).coalesce(1).write.parquet(staged)
        storage.publish(self.spark, staged, path)

    def add(self, name: str, rows: list[tuple]) -> None:
        self.put(name, self.get(name).union(self.spark.createDataFrame(rows, SCHEMAS[name])))

    def table(self, name: str):
        """The table's row; raises where it is not known."""
        row = self.get("tables").where(F.lower("table_name") == name.lower()).first()
        if row is None:
            raise storage.PartitionError(f"no table {name}")
        return row

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.table(name).path)

    def table_exists(self, name: str) -> bool:
        return not self.get("tables").where(F.lower("table_name") == name.lower()).isEmpty()

    def has_column(self, table: str, column: str) -> bool:
        return self.table_exists(table) and column.lower() in [c.lower() for c in self.read(table).columns]

    def is_partitioned(self, table: str) -> bool:
        return self.table_exists(table) and storage.is_partitioned(self.spark, self.table(table).path)

    def has_primary_key(self, table: str) -> bool:
        return self._has_key(table, "p")

    def has_unique(self, table: str) -> bool:
        return self._has_key(table, "u")

    def _has_key(self, table: str, kind: str) -> bool:
        return not self.get("keys").where((F.lower("table_name") == table.lower()) & (F.col("kind") == kind) & F.col("live")).isEmpty()

    def ensure_schema(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {checked_name(name)}")

    def set_live(self, table: str, live: bool) -> DataFrame:
        """(kind, name) of the views on the table, the keys on and to it and its own triggers, which are dropped or restored; definitions stay."""
        t = table.lower()
        found = [
            ("views", F.lower("table_name") == t, "view", "view_name"),
            ("keys", (F.lower("table_name") == t) | (F.lower("referenced_table") == t), "key", "constraint_name"),
            ("triggers", (F.lower("table_name") == t) & ~F.col("is_internal"), "trigger", "trigger_name"),
        ]
        out = None
        for name, of, kind, column in found:
            hit = self.get(name).where(of & (F.col("live") != live)).select(F.lit(kind).alias("kind"), F.col(column).alias("name")).distinct()
            out = hit if out is None else out.union(hit)
        rows = out.collect()  # names of one table's dependents
        for name, of, _, _ in found:
            self.put(name, self.get(name).withColumn("live", F.when(F.coalesce(of, F.lit(False)), F.lit(live)).otherwise(F.col("live"))))
        return self.spark.createDataFrame(rows, "kind string, name string")

    def make_deferrable(self) -> int:
        """Compound keys with a helper become deferrable; the number of those that were not. A second run changes nothing."""
        keys = self.get("keys")
        late = catalog.compound_keys(keys.where("kind = 'f' AND live"), lambda c: catalog.helper_like(c)).select("constraint_name", "table_name")
        n = late.count()
        if n:
            marked = keys.join(F.broadcast(late.withColumn("late", F.lit(True))), ["constraint_name", "table_name"], "left")
            self.put("keys", marked.withColumn("can_defer", F.col("can_defer") | F.coalesce("late", F.lit(False))))
        return n

    def remove_config(self, table: str) -> None:
        self.put("config", self.get("config").where(F.lower("table_name") != table.lower()))

    def set_processed(self, table: str, now: dt.datetime) -> None:
        self.put("processed", retention.upsert(self.get("processed"), self.spark.createDataFrame([(table.lower(), now)], SCHEMAS["processed"]), "table_name"))

    def last_processed(self, table: str) -> dt.datetime | None:
        row = self.get("processed").where(F.lower("table_name") == table.lower()).first()
        return row.last_processed if row else None

    def snapshot(self, table: str, now: dt.datetime) -> str:
        """A copy of the table for later, and its row; the name holds the table and the milliseconds of now."""
        name = f"{table.lower()}_backup_{int(now.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)}"
        self.read(table).write.parquet(f"{self.folder}/snapshots/{name}")
        self.add("backups", [(name, table, now)])
        return name

    def sweep(self, now: dt.datetime, table: str | None = None) -> list[str]:
        """Removes snapshots that are too many or too old, of all tables or one; their names. Rows go after the folders, so that a sweep cut short can be repeated."""
        rows = self.get("backups")
        if table is not None:
            rows = rows.where(F.lower("table_name") == table.lower())
        gone = sorted(r.backup_name for r in retention.to_delete(rows, F.lit(now).cast("timestamp_ntz")).collect())
        for name in gone:
            storage.remove(self.spark, f"{self.folder}/snapshots/{name}")
        if gone:
            self.put("backups", retention.delete(self.get("backups"), self.spark.createDataFrame([(n,) for n in gone], "backup_name string"), "backup_name"))
        return gone

    def guarded(self, table: str, now: dt.datetime, action) -> None:
        """Runs the action after a snapshot; its failure is raised with the snapshot's name. Without a snapshot nothing runs."""
        name = self.snapshot(table, now)
        try:
            action()
        except Exception as e:
            raise storage.PartitionError(f"{table}: {e}; the state before is in {name}") from e
