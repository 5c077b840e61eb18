"""Helper columns of streamed rows, filled as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from yearfold.operators.propagate import Keys, fill


def enrich(stream: DataFrame, parent: DataFrame, keys: Keys, field: str, helper: str) -> DataFrame:
    """Rows with a null helper get the parent's value, by a stream-static join; without a parent it stays null."""
    return fill(stream, parent, keys, field, helper)


def start(stream: DataFrame, read_parent, keys: Keys, field: str, helper: str, path: str, checkpoint: str, **trigger):
    """A query that fills and appends each micro-batch; read_parent() gives the parent as it is then.

    A batch that runs again after a failure is written to its own folder again, in place of the first try.
    """

    def one(batch: DataFrame, number: int) -> None:
        fill(batch, read_parent(), keys, field, helper).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
