"""The index of a workspace: derived tables, and how they follow the documents.

Tables are DataFrames of immutable snapshots.  A change replaces the rows of the paths that it names (an
anti-join and a union on each table) and resolves links as one set, so the order of changes is of no
account.  ``save`` writes a new version beside the old one and then moves one pointer.

Each table parses only what is its own; what reads a table several times takes it from ``held``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import kind
from . import graph, history, markdown
from .scratch import materialize

FILES = "path string, kind string, size long, mtime long, sha256 string, title string, about string, tags array<string>, frontmatter string"
KEYS = {"files": "path", "headings": "path", "links": "src", "chunks": "path"}


@dataclass(frozen=True)
class Index:
    files: DataFrame
    headings: DataFrame
    links: DataFrame
    chunks: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in KEYS}


def aliases(files: DataFrame) -> DataFrame:
    """(path, aliases) from front matter: a list or a single text under aliases or alias."""
    value = F.coalesce(F.get_json_object("frontmatter", "$.aliases"), F.get_json_object("frontmatter", "$.alias"))
    many = F.from_json(value, "array<string>")
    return files.select("path", F.when(value.startswith("["), many).when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>")).alias("aliases"))


def build(docs: DataFrame, mtime: str | None = None, model: str = "hash", **sizes) -> Index:
    """Index of documents (path, text[, mtime]); null texts are empty; paths are taken as unique."""
    given = docs.select("path", "text", *([mtime] if mtime else []))
    part = lambda docs, name: markdown.parse(docs, parts=(name,), **sizes)
    files = part(given, "files").select("path", kind("path").alias("kind"), "size", "sha256", "title", "about", "tags", "frontmatter")
    if mtime:
        files = files.join(given.select("path", F.col(mtime).alias("mtime")), "path")
    else:
        files = files.withColumn("mtime", F.lit(0).cast("long"))
    files = files.select(*[c.split()[0] for c in FILES.split(", ")])
    # texts without the word have no alias
    known = aliases(part(given.filter(F.contains("text", F.lit("alias"))), "files"))
    links = graph.resolve_links(markdown.link_rows(part(given, "links")), known, given.select("path"))
    return Index(files, markdown.heading_rows(part(given, "headings")), links, markdown.chunk_rows(part(given, "chunks"), model))


def held(index: Index, **columns: list[str]) -> Index:
    """The index with the tables named written once in the shared folder, of which those columns are kept (none named: all).

    Whatever reads them several times then does not parse the documents as often.
    """
    return replace(index, **{k: materialize(getattr(index, k).select(*(c or ["*"])), k) for k, c in columns.items()})


def without(index: Index, paths: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of some paths (path)."""
    return {k: t.join(paths.select(F.col("path").alias(KEYS[k])), KEYS[k], "left_anti") for k, t in index.tables().items()}


def resolve_again(links: DataFrame, files: DataFrame, everything: bool = False) -> DataFrame:
    """links with those resolved that have no target yet (or all of them), in one pass over them."""
    columns = links.columns
    given = links.drop("resolved").withColumnRenamed("target_path", "_had") if not everything else links.drop("target_path", "resolved")
    done = graph.resolve_links(given, aliases(files))
    if not everything:
        target = F.coalesce("_had", "target_path")
        done = done.withColumns({"target_path": target, "resolved": target.isNotNull()})
    return done.select(*columns)


def remove(index: Index, paths: DataFrame) -> Index:
    """The index without some paths; links to them lose their target, and look for another one."""
    left = without(index, paths)
    gone = paths.select(F.col("path").alias("target_path"), F.lit(True).alias("_gone"))
    links = left["links"].join(gone, "target_path", "left")
    links = links.withColumns({"resolved": F.col("resolved") & F.col("_gone").isNull(), "target_path": F.when(F.col("_gone").isNull(), F.col("target_path"))})
    links = links.select(*index.links.columns)
    return replace(Index(**left), links=resolve_again(links, left["files"]))


def upsert(index: Index, fresh: Index) -> Index:
    """The index with the rows of fresh in place of those of the same paths; open links are tried again."""
    left = without(index, fresh.files.select("path"))
    merged = {k: left[k].unionByName(t) for k, t in fresh.tables().items()}
    files = merged["files"]
    # a link of the fresh documents was resolved among themselves only
    old, new = left["links"], fresh.links
    merged["links"] = resolve_again(old, files).unionByName(resolve_again(new, files, everything=True))
    return Index(**merged)


def plan_sync(index: Index, listing: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, status) of a folder's listing (path, size, mtime): changed, new, removed, touched or unchanged.

    contents (path, text) count only where size or mtime differ.
    """
    known = index.files.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("sha256").alias("_sha"))
    both = listing.select("path", "size", "mtime").join(known, "path", "full")
    now = contents.select("path", F.struct(F.sha2("text", 256).alias("sha")).alias("_now"))  # no text is moved, and each table is read once
    same = F.expr("(size <=> _size and mtime <=> _mtime) or _now is null")
    status = F.when(F.col("_size").isNull(), "new").when(F.col("size").isNull(), "removed").when(same, "unchanged")
    status = status.when(F.col("_now.sha") == F.col("_sha"), "touched").otherwise("changed")
    return both.join(now, "path", "left").select("path", status.alias("status"))


def sync(index: Index, listing: DataFrame, contents: DataFrame, prune: bool = True, **sizes) -> tuple[Index, DataFrame]:
    """The index brought up to a folder's state, and the plan; touched files get new stats only.

    The plan and what is to be parsed are written once, as each table needs them.
    """
    plan = materialize(plan_sync(index, listing, contents), "plan")
    work = contents.select("path", "text").join(plan.filter("status in ('changed', 'new')"), "path", "left_semi").join(listing.select("path", "mtime"), "path")
    work = materialize(work, "work")
    out = upsert(index, held(build(work, "mtime", **sizes), files=[]))
    stats = listing.join(plan.filter("status = 'touched'"), "path", "left_semi").select("path", F.col("mtime").alias("_mtime"))
    files = out.files.join(stats, "path", "left").withColumn("mtime", F.coalesce("_mtime", "mtime")).select(*out.files.columns)
    out = replace(out, files=files)
    return (remove(out, plan.filter("status = 'removed'").select("path")) if prune else out), plan


def dirty(index: Index, embeddings: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return index.chunks.join(embeddings.select("embed_sha").distinct(), "embed_sha", "left_anti")


def duplicate_headings(index: Index) -> DataFrame:
    return index.headings.groupBy("path", "heading_path").agg(F.count("*").alias("n")).filter("n > 1")


def save(index: Index, folder: str) -> str:
    """Write all tables as a new version, then point to it; a version half written is never read."""
    spark = index.files.sparkSession
    number = int(current(spark, folder) or 0) + 1
    for name, table in index.tables().items():
        table.write.mode("overwrite").parquet(f"{folder}/v{number}/{name}")
    spark.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return f"{folder}/v{number}"


def current(spark: SparkSession, folder: str) -> int | None:
    """The newest version that was written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("version long").parquet(f"{folder}/versions").agg(F.max("version")).first()[0]


def load(spark: SparkSession, folder: str) -> Index:
    number = current(spark, folder)
    if number is None:
        raise FileNotFoundError(f"{folder} holds no index")
    return Index(**{k: spark.read.parquet(f"{folder}/v{number}/{k}") for k in KEYS})


def log_changes(versions: DataFrame, files: DataFrame, command: str, at) -> DataFrame:
    """versions with the present state of files, where it differs from each path's newest version."""
    top = versions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    fresh = files.select("path", F.col("sha256").alias("sha"), "size", F.lit(command).alias("command"), F.lit(at).alias("created_at"))
    fresh = fresh.crossJoin(F.broadcast(top))  # one row
    # numbers grow with time and need not be dense: a hash keeps them apart without a global sort
    fresh = fresh.withColumn("seq", F.col("_top") + 1 + F.monotonically_increasing_id()).drop("_top")
    return history.snapshot(versions, fresh.select(*versions.columns))
