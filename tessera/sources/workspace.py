"""Sources and sinks: a folder of documents, CSV, catalogs and a blob store."""

from __future__ import annotations

import posixpath
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.text import glob_regex, has_tags, kind

INCLUDE, PRUNE = ("**/*.md", "**/*.markdown", "**/*.db", "**/*.duckdb"), (".git", "node_modules", ".tessera")
RESERVED = "tessera_index"


def matches(path, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = ()):
    any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    return ~any_of(exclude) & any_of(include)


def normalise(root: str, path: str) -> str:
    """A path inside root, relative to it."""
    out = posixpath.normpath(posixpath.relpath(posixpath.join(root, path), root))
    if out == "." or out.startswith("../") or out == "..":
        raise ValueError(f"{path} is not a document inside {root}")
    return out


def walk(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, kind, size, mtime) of a folder's documents; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = r"^(?:\w+:)?/+" + root.split(":", 1)[-1].strip("/").replace(".", r"\.") + "/"
    rows = files.select(
        F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), prefix, "").alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
    )
    pruned = F.col("path").rlike("(^|/)(" + "|".join(p.replace(".", r"\.") for p in PRUNE) + ")/")
    return rows.filter(~pruned & matches(F.col("path"), include, exclude)).withColumn("kind", kind("path"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, sha256) of the Markdown files; invalid bytes become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.m*").load(root)
    prefix = r"^(?:\w+:)?/+" + root.split(":", 1)[-1].strip("/").replace(".", r"\.") + "/"
    return files.select(
        F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), prefix, "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"),
    ).filter(kind("path") == "md")


def import_csv(spark: SparkSession, csv: str, database: str, table: str) -> int:
    """Create or replace a table from a CSV file; its rows."""
    guard(database)
    rows = spark.read.csv(csv, header=True, inferSchema=True)
    rows.write.mode("overwrite").saveAsTable(f"{database}.{table}")
    return spark.table(f"{database}.{table}").count()


def export_csv(spark: SparkSession, database: str, table: str, to: str, single: bool = False) -> None:
    """A table as CSV with a header: part files in a folder, or one file (written by one task, for tables that a reader opens)."""
    rows = spark.table(f"{database}.{table}")
    if not single:
        rows.write.mode("overwrite").option("header", True).csv(to)
        return
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{to}.parts")
    Path, jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    files = Path(to).getFileSystem(jvm)
    part = next(f.getPath() for f in files.listStatus(Path(f"{to}.parts")) if f.getPath().getName().startswith("part-"))
    files.delete(Path(to), True)
    files.rename(part, Path(to))
    files.delete(Path(f"{to}.parts"), True)


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON document for each row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def ls(files: DataFrame, glob: str | None = None, of_kind: str | None = None, tags: list[str] = (), sort: str = "path") -> DataFrame:
    """Files that fit a glob, a kind and all of the tags; by path, newest first (mtime) or largest first (size)."""
    if glob:
        files = files.filter(F.col("path").rlike(glob_regex(glob)))
    if of_kind:
        files = files.filter(F.col("kind") == of_kind)
    if tags:
        files = files.filter(has_tags("tags", list(tags)))
    return files.orderBy(*([F.desc(sort)] if sort != "path" else []), "path")


def create_database(spark: SparkSession, name: str) -> None:
    guard(name)
    if spark.catalog.databaseExists(name):
        raise ValueError(f"{name} exists")
    spark.sql(f"CREATE DATABASE `{name}`")


def guard(name: str) -> None:
    if name == RESERVED:
        raise ValueError(f"{name} is the index itself")


def catalog(spark: SparkSession, database: str) -> DataFrame:
    """(table_name, row_count, columns) of a database's tables and views, by name."""
    rows = [
        (t.name, spark.table(f"{database}.{t.name}").count(), [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name, database)])
        for t in spark.catalog.listTables(database)
        if not t.isTemporary  # views of the session belong to no database
    ]
    return spark.createDataFrame(rows, "table_name string, row_count long, columns array<struct<name:string,type:string>>").orderBy("table_name")


def _zip(values: pd.Series) -> pd.Series:
    return values.map(lambda x: zlib.compress(x))


def _unzip(values: pd.Series) -> pd.Series:
    return values.map(lambda x: zlib.decompress(x))


def blobs(texts: DataFrame) -> DataFrame:
    """(sha, blob): each distinct text once, compressed."""
    rows = texts.select(F.sha2("text", 256).alias("sha"), F.encode("text", "utf-8").alias("raw")).dropDuplicates(["sha"])
    return rows.select("sha", F.pandas_udf(_zip, BinaryType())("raw").alias("blob"))


def blob_texts(stored: DataFrame) -> DataFrame:
    return stored.select("sha", F.decode(F.pandas_udf(_unzip, BinaryType())("blob"), "utf-8").alias("text"))
