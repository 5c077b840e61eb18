"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_ARROW_BATCH = 512
BROADCAST_BYTES, LOOKUP_BYTES = 32 << 20, 8 << 20
HOT_ROWS, HOT_KEYS = 1 << 17, 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Sees to a checkpoint folder and to small Arrow batches.

    The folder is the one the cluster names in spark.checkpoint.dir; only where the session
    has none and the master is local (tests on one machine) is a temporary one made. Batches are
    bounded because one document can be very long.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_ARROW_BATCH or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ROWS_PER_ARROW_BATCH))


def private(df: DataFrame) -> str:
    """A prefix that no column of df has, in any case, for columns of an operator's own."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p


def text_bytes(df: DataFrame, col: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column: two numbers, from one scan of that column."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(col)))).first()
    return int(row[0]), int(row[1] or 0)


def let(value: str, name: str, body: str) -> str:
    """SQL for the body, with the value worked out once under the name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """rows joined (left or inner) with found, which is unique by `on`; both come from checkpoints or files.

    found is broadcast if its measured size allows. Else keys that very many rows share are told
    from the others by counting, HOT_KEYS at most; what found has of them is broadcast, the other
    rows are joined by shuffle, and rows with a null key, which match nothing, take no part in it.
    """
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in found.columns]
    size = found.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    if size <= LOOKUP_BYTES:
        return rows.join(F.broadcast(found), on, how)
    null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on))
    named = rows.where(~null)
    limit = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = F.broadcast(named.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(*on).checkpoint())
    out = named.join(hot, on, "left_anti").join(found, on, how)
    out = out.union(named.join(hot, on, "left_semi").join(F.broadcast(found.join(hot, on, "left_semi")), on, how).select(*out.columns))
    if how == "left":
        more = [c for c in found.columns if c not in on]
        out = out.union(rows.where(null).select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more]).select(*out.columns))
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_text(col) -> F.Column:
    return F.sha2(F.encode(col, "UTF-8"), 256)
