"""An addition: keep a table of parsed documents in step with a folder that files arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.markdown import parse


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = True):
    """A streaming query that appends each new JSON-lines document (path, text), parsed, to a Parquet folder."""
    rows = spark.readStream.schema("path string, text string").json(folder)

    def add(batch: DataFrame, number: int) -> None:
        parse(batch).write.mode("append").parquet(table)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
