"""Version logs, change detection and embedding caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(versions: DataFrame, key: str = "path", seq: str = "seq") -> DataFrame:
    """The newest row of each key, by one partial aggregate."""
    columns = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_v")).select(key, "_v.*")


def consecutive_dedupe(versions: DataFrame, value: str = "sha", key: str = "path", seq: str = "seq") -> DataFrame:
    """Rows whose value differs from the one just before; repeats that are not adjacent stay."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(seq))
    first = F.row_number().over(Window.partitionBy(key).orderBy(seq)) == 1
    return versions.withColumn("_new", first | ~before.eqNullSafe(F.col(value))).filter("_new").drop("_new")


def keep_last(versions: DataFrame, n: int = 50, key: str = "path", seq: str = "seq") -> DataFrame:
    return versions.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).filter(F.col("_r") <= n).drop("_r")


def log(versions: DataFrame, path: str | None = None, n: int = 20, key: str = "path", seq: str = "seq") -> DataFrame:
    return (versions if path is None else versions.filter(F.col(key) == path)).orderBy(F.desc(seq)).limit(n)


def restore_target(versions: DataFrame, path: str, prefix: str) -> str:
    """The one sha of a path that starts with the prefix."""
    found = [r[0] for r in versions.filter((F.col("path") == path) & F.col("sha").startswith(prefix)).select("sha").distinct().limit(6).collect()]
    if len(found) != 1:
        raise LookupError(f"{'ambiguous' if found else 'no'} version {prefix} of {path}: {', '.join(sorted(found))}")
    return found[0]


def rekey(versions: DataFrame, old: str, new: str) -> DataFrame:
    return versions.withColumn("path", F.when(F.col("path") == old, new).otherwise(F.col("path")))


def snapshot(versions: DataFrame, fresh: DataFrame) -> DataFrame:
    """versions and the fresh rows (path, sha, ...) that differ from their path's newest one."""
    now = latest(versions).select("path", F.col("sha").alias("_sha"))
    kept = fresh.join(now, "path", "left").filter(~F.col("sha").eqNullSafe(F.col("_sha"))).drop("_sha")
    return versions.unionByName(kept)


def collect_garbage(versions: DataFrame, blobs: DataFrame, embeddings: DataFrame, chunks: DataFrame, keep: int = 50):
    """Versions, blobs and embeddings that stay: the last ``keep``, and what is still referred to."""
    kept = keep_last(versions, keep)
    return kept, blobs.join(kept.select("sha").distinct(), "sha", "left_semi"), embeddings.join(chunks.select("embed_sha"), "embed_sha", "left_semi")


def sync_diff(registry: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    """(key, status) by stat and, only where that differs, by hash.

    registry and disk have key, size, mtime and sha; disk's sha is only looked at where size or mtime
    differ.  A row whose sha is equal is ``unchanged`` (touched).
    """
    r, d = registry.alias("r"), disk.alias("d")
    same = (F.col("r.size") == F.col("d.size")) & (F.col("r.mtime") == F.col("d.mtime"))
    status = F.when(F.col(f"r.{key}").isNull(), "new").when(F.col(f"d.{key}").isNull(), "removed").when(
        same | (F.col("r.sha") == F.col("d.sha")), "unchanged"
    ).otherwise("changed")
    return r.join(d, F.col(f"r.{key}") == F.col(f"d.{key}"), "full").select(F.coalesce(f"r.{key}", f"d.{key}").alias(key), status.alias("status"))


def embed_input(text: Column, heading: Column | None = None, prefix: str = "") -> Column:
    """What an embedder is given: heading path and body, never the file's path."""
    body = F.btrim(text, F.lit(" \t\n\r"))
    if heading is None:
        return F.concat(F.lit(prefix), body)
    head = F.replace(heading, F.lit("/"), F.lit(" > "))
    return F.when(head == "", F.concat(F.lit(prefix), body)).otherwise(F.concat(F.lit(prefix), head, F.lit("\n\n"), body))


def embed_sha(text: Column, heading: Column | None = None, model: str = "hash", prefix: str = "") -> Column:
    """Hash of the model and the exact embedder input."""
    return F.sha2(F.concat(F.lit(model + "\n"), embed_input(text, heading, prefix)), 256)


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row for each embed_sha that has no vector yet: what the embedder must be given."""
    return chunks.join(embeddings.select("embed_sha"), "embed_sha", "left_anti").dropDuplicates(["embed_sha"])
