"""Validation of a stream of rows: the rules are expressions without state, so they run as they are."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.validation import is_valid


def validated(df: DataFrame, text: str, schema: Any) -> DataFrame:
    """df with `valid`; for streaming and batch DataFrames alike."""
    return df.withColumn("valid", is_valid(F.col(text), schema))


def split_stream(df: DataFrame, text: str, schema: Any, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Write valid rows of a stream to one Parquet folder and the others to another; each batch is scored once.

    A batch has a folder of its own in both, batch=<id>, which a repeated batch writes again in
    full: after a failure no row stands twice. Readers see the id as a column.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = validated(batch, text, schema).persist()
        try:
            for fits, folder in (("valid", good), ("valid is not true", bad)):
                rows.where(fits).drop("valid").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            rows.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
