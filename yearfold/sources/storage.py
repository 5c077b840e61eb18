"""Partitioned datasets: staged and verified writes, pruned reads, and the way back."""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearfold.functions.scalars import is_helper, is_partition_key
from yearfold.operators.layout import YEAR, in_range, with_year


class PartitionError(RuntimeError):
    pass


def work_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder of spark.checkpoint.dir; where the session has none, a local one if the master is local, too.

    What lies on this machine goes when the program ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise PartitionError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        top = tempfile.gettempdir()
    path = f"{top}/work-{uuid.uuid4().hex}"
    if "://" not in path or path.startswith("file:"):
        atexit.register(shutil.rmtree, path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    return path


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise PartitionError(f"could not move {old} to {new}")


def _hash(columns: list[str]):
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)]).cast("decimal(38,0)")).alias("h")


def digest(df: DataFrame) -> tuple[int, int | None]:
    """Rows and an order-free hash, in one pass."""
    return tuple(df.agg(F.count(F.lit(1)).alias("n"), _hash(df.columns)).first())


def digest_by_year(dated: DataFrame) -> dict[int | None, tuple[int, int]]:
    """Rows and an order-free hash of each year, in one pass: a row for each year comes to the driver."""
    g = dated.groupBy(YEAR).agg(F.count(F.lit(1)).alias("n"), _hash([c for c in dated.columns if c != YEAR]))
    return {r[YEAR]: (r.n, r.h) for r in g.collect()}


def publish_all(spark: SparkSession, staged: list[tuple[str, str]]) -> None:
    """Each staged folder takes the place of its path. What was there is kept until all are in place, and comes back if one fails."""
    mark, done = uuid.uuid4().hex, []
    try:
        for new, path in staged:
            old = f"{path}.old-{mark}"
            had = exists(spark, path)
            if had:
                rename(spark, path, old)
            done.append((path, old if had else None))
            rename(spark, new, path)
    except Exception:
        for path, old in reversed(done):
            remove(spark, path)
            if old:
                rename(spark, old, path)
        raise
    for _, old in done:
        if old:
            remove(spark, old)


def publish(spark: SparkSession, staged: str, path: str) -> None:
    publish_all(spark, [(staged, path)])


def staging(path: str) -> str:
    return f"{path}.staged-{uuid.uuid4().hex}"


def is_partitioned(spark: SparkSession, path: str) -> bool:
    return bool(partitions(spark, path))


def partitions(spark: SparkSession, path: str) -> list[int]:
    """The years of a partitioned dataset, in order, from the names of its folders; none where it is plain or absent."""
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    years = [n.partition("=")[2] for n in names if n.startswith(f"{YEAR}=")]
    return sorted(int(y) for y in years if y.lstrip("-").isdigit())


@dataclass
class Outcome:
    table: str
    status: str  # SUCCESS, SKIPPED or FAILURE
    message: str = ""
    n_rows: int = 0
    seconds: float = 0.0


def check_field(df: DataFrame, field: str) -> None:
    if field not in df.columns:
        raise PartitionError(f"no column {field}")
    if not is_partition_key(df.schema[field].dataType):
        raise PartitionError(f"{field} is {df.schema[field].dataType.simpleString()}, not a date or timestamp")


def stage_partitioned(df: DataFrame, field: str, staged: str, verify: bool = True) -> int:
    """Writes df by year of the field, and compares what was written; the number of rows. Null keys raise before anything is written.

    One pass over df finds nulls, rows and hashes of all years, one writes, and one reads what was
    written. Spark splits or merges the years' rows as their sizes need (rebalance).
    """
    check_field(df, field)
    dated = with_year(df, field)
    want = digest_by_year(dated)
    if None in want:
        raise PartitionError(f"{field} has null values")
    dated.hint("rebalance", YEAR).write.partitionBy(YEAR).parquet(staged)
    if verify and digest_by_year(df.sparkSession.read.schema(dated.schema).parquet(staged)) != want:
        raise PartitionError("what was written differs from what was read")
    return sum(n for n, _ in want.values())


def write_partitioned(df: DataFrame, field: str, path: str, verify: bool = True) -> Outcome:
    """df by year of the field, staged beside path, compared with df and put in place. A failure changes nothing."""
    spark, staged = df.sparkSession, staging(path)
    try:
        n = stage_partitioned(df, field, staged, verify)
        publish(spark, staged, path)
    except Exception:
        remove(spark, staged)
        raise
    return Outcome(path, "SUCCESS", "", n)


def partition_table(spark: SparkSession, path: str, field: str) -> Outcome:
    """A plain dataset becomes one by year in its place; one that is partitioned already stays as it is."""
    if is_partitioned(spark, path):
        return Outcome(path, "SKIPPED", "already partitioned")
    return write_partitioned(spark.read.parquet(path), field, path)


def read_range(spark: SparkSession, path: str, field: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Rows of start <= field < end; only the years that can hold them are read."""
    df = spark.read.parquet(path)
    return df.where(in_range(field, start, end)).drop(YEAR)


def plain(df: DataFrame) -> DataFrame:
    """Without helper columns and the year, in the order of the columns that are left."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != YEAR and not is_helper(c)])


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> int:
    """df, which may read path, staged, verified and put in its place; the number of rows."""
    staged = staging(path)
    try:
        df.write.parquet(staged)
        want, got = digest(df), digest(spark.read.schema(df.schema).parquet(staged))
        if want != got:
            raise PartitionError("what was written differs from what was read")
        publish(spark, staged, path)
    except Exception:
        remove(spark, staged)
        raise
    return got[0]


def unpartition_table(spark: SparkSession, path: str) -> Outcome:
    """The plain dataset again, staged and verified like the way there."""
    if not is_partitioned(spark, path):
        return Outcome(path, "SKIPPED", "not partitioned")
    return Outcome(path, "SUCCESS", "", rewrite(spark, plain(spark.read.parquet(path)), path))


def drop_column(spark: SparkSession, path: str, column: str) -> bool:
    """The dataset without the column; False, and no change, where it has none or is partitioned by it."""
    df = spark.read.parquet(path)
    if column not in df.columns or column == YEAR:
        return False
    if not is_partitioned(spark, path):
        rewrite(spark, df.drop(column), path)
        return True
    staged = staging(path)
    try:
        df.drop(column).hint("rebalance", YEAR).write.partitionBy(YEAR).parquet(staged)
        publish(spark, staged, path)
    except Exception:
        remove(spark, staged)
        raise
    return True


def run_all(tables: list[tuple[str, str]], action) -> list[Outcome]:
    """action(path, field) for each table, with its seconds; one that fails does not stop the others."""
    out = []
    for path, field in tables:
        began = time.monotonic()
        try:
            done = action(path, field)
        except Exception as e:
            done = Outcome(path, "FAILURE", " ".join(str(e).split())[:150])
        done.seconds = time.monotonic() - began
        out.append(done)
    return out
