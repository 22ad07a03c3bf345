"""The link graph: resolution, degrees, backlinks and health."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Extensions of documents that links may spell out.
FILE = re.compile(r"\.(md|markdown|db)$")


def basename(path: Column | str) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def resolve_links(edges: DataFrame, files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """edges (src, target, ...) with target_path: null if nothing or several things fit.

    In order: the path beside the source, the path from the root (``.md`` added if there is no known
    extension), a basename that only one file has, the first file with that alias.  Each step is an
    equi-join; files are (path, aliases array<string>).  ``every`` has the paths of all files if files has
    not: those without an alias may be left out of it.
    """
    clean = F.regexp_replace("target", r"^[./]+|[./]+$", "")
    named = F.when(F.lower(clean).rlike(r"\.(md|markdown|db|duckdb)$"), clean).otherwise(F.concat(clean, F.lit(".md")))
    folder = F.regexp_extract("src", r"^(.*/)[^/]*$", 1)
    rows = edges.withColumns({"_name": named, "_clean": clean, "_near": F.concat(folder, named)})
    every = files if every is None else every
    paths = every.select(F.col("path").alias("_p"))
    single = every.groupBy(basename("path").alias("_b")).agg(F.count("*").alias("_n"), F.min("path").alias("_single")).filter("_n = 1").drop("_n")
    alias = files.select("path", F.explode("aliases").alias("_alias")).groupBy("_alias").agg(F.min("path").alias("_by_alias"))
    alias = alias.filter("_alias is not null")
    rows = rows.join(paths.withColumnRenamed("_p", "_p1"), F.col("_near") == F.col("_p1"), "left")
    rows = rows.join(paths.withColumnRenamed("_p", "_p2"), F.col("_name") == F.col("_p2"), "left")
    rows = rows.withColumn("_base", basename("_name")).join(single, F.col("_base") == F.col("_b"), "left")
    rows = rows.join(alias, F.col("target") == F.col("_alias"), "left")
    found = F.coalesce("_p1", "_p2", "_single", "_by_alias")
    return rows.withColumn("target_path", found).select(*edges.columns, "target_path", found.isNotNull().alias("resolved"))


def backlinks(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter((F.col("target_path") == path) & (F.col("src") != path)).orderBy("src", "line")


def degrees(files: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """(path, out_links, back_links): all links out; links in, but those from the document itself; ``more`` columns of files stay."""
    ends = edges.select(F.expr("""inline(array(struct(src as path, 1L as out_links, 0L as back_links),
        struct(if(src != target_path, target_path, null) as path, 0L as out_links, 1L as back_links)))"""))  # edges are read once
    ends = ends.filter("path is not null").groupBy("path").agg(F.sum("out_links").alias("out_links"), F.sum("back_links").alias("back_links"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return files.select("path", *more).join(ends, "path", "left").select("path", *more, zero("out_links"), zero("back_links"))


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that nothing links to; here a document's link to itself counts."""
    return files.select("path").join(edges.select(F.col("target_path").alias("path")), "path", "left_anti")


def rewrite_links(text: str, raws: list[tuple[int, str]], new: str) -> str:
    """Point the links (line, raw) of a text to another path; extension, anchor and shown text stay as they were spelt."""
    from .markdown import links

    lines = text.split("\n")
    for number, raw in raws:
        if not 0 < number <= len(lines) or not (found := links(raw)):
            continue
        link = found[0]
        spelt = new if FILE.search(link["target"].lower()) or not new.lower().endswith(".md") else new[:-3]
        spelt += f"#{link['anchor']}" if link["anchor"] else ""
        if link["kind"] == "wiki":
            to = f"[[{spelt}|{link['alias']}]]" if link["alias"] else f"[[{spelt}]]"
        else:
            to = f"[{link['alias'] or ''}]({spelt})"
        lines[number - 1] = lines[number - 1].replace(raw, to, 1)
    return "\n".join(lines)


class Linked(Exception):
    """Documents link to what was to be removed."""


def refuse_linked(edges: DataFrame, path: str, force: bool = False, shown: int = 5) -> None:
    """Raise Linked, with up to ``shown`` sources, if other documents link to a path."""
    sources = [] if force else [r["src"] for r in backlinks(edges, path).select("src").distinct().orderBy("src").limit(shown + 1).collect()]
    if sources:
        more = " and more" if len(sources) > shown else ""
        raise Linked(f"{path} is linked from {', '.join(sources[:shown])}{more}")


def doctor(files: DataFrame, edges: DataFrame, headings: DataFrame, chunks: DataFrame, embeddings: DataFrame, dim: int = 384) -> DataFrame:
    """(category, item): broken and ambiguous links, orphans, duplicate headings, dirty chunks, and
    embeddings that nothing needs or whose dimension is wrong."""
    item = lambda df, name, *c: df.select(F.lit(name).alias("category"), F.concat_ws(":", *c).alias("item"))
    names = files.groupBy(F.lower(basename("path")).alias("b")).agg(F.count("*").alias("n"))
    broken = edges.filter("target_path is null").withColumn("b", F.lower(basename("target")))
    broken = broken.withColumn("b", F.when(F.col("b").rlike(r"\.(md|markdown)$"), F.col("b")).otherwise(F.concat("b", F.lit(".md")))).join(names, "b", "left")
    parts = [
        broken.select(F.when(F.col("n") > 1, "ambiguous").otherwise("broken").alias("category"), F.concat_ws(":", "src", "line", "target").alias("item")),
        item(orphans(files, edges), "orphans", "path"),
        item(headings.groupBy("path", "heading_path").count().filter("count > 1"), "duplicate_headings", "path", "heading_path"),
        item(chunks.join(embeddings, "embed_sha", "left_anti"), "dirty", "chunk_id"),
        item(embeddings.join(chunks, "embed_sha", "left_anti"), "orphan_embeddings", "embed_sha"),
        item(embeddings.filter(F.size("vec") != dim), "dim_mismatch", "embed_sha"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
