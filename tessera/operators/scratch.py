"""Scratch tables in the folder that driver and executors share, and Arrow batches of bounded bytes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Where intermediate tables go if a session on a single machine names no shared folder (tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/tessera"
#: Bytes of text that a Python step holds at once.
SLICE_BYTES = 1 << 20

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a default is set only where they are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        spark.conf.set("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        found = LOCAL_CHECKPOINTS
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _forget() -> None:
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                drop(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
            return


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch table and, if its rows are in buckets, its name."""
    spark.sql(f"DROP TABLE IF EXISTS {named(path)}")
    delete(spark, path)


def named(path: str) -> str:
    """The name in the session's catalog of a table in buckets."""
    return "spark_catalog.default.tessera_" + path.rpartition("/")[2].replace("-", "_")


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts lineage, survives lost executors.

    ``by`` deals the rows into as many buckets by that column as a shuffle has parts, so joins by it do not
    move them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    if by:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(parts, by).option("path", path).saveAsTable(named(path))
        return spark.table(named(path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Drop a table made by materialize() that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        mine = [x for x in _scratch if x[1].split(":", 1)[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")]
        for x in mine:
            drop(spark, path)
            _scratch.remove(x)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text; a longer row is alone."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
