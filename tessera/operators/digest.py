"""Orientation: the map of a workspace, summaries of documents and tables, and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_parts, under
from .graph import basename, degrees

DOT = " · "
#: Shares into which report() deals the findings of a category.
SHARES = 200


def in_order(value: str, by: str, level: str | None = None):
    """Values of a group joined by DOT in the order of another column."""
    pairs = F.array_sort(F.collect_list(F.struct(by, value)))
    return F.array_join(F.transform(pairs, lambda x: x[value]), DOT)


def heading_summary(headings: DataFrame, level: int = 2) -> DataFrame:
    """(path, headings): a document's headings of one level, in order."""
    rows = headings.filter(F.col("level") == level)
    return rows.groupBy("path").agg(in_order("text", "line_start").alias("headings"))


def table_summary(tables: DataFrame) -> DataFrame:
    """(path, tables): a database's tables (db_path, table_name, row_count) by name, with their rows."""
    named = tables.withColumn("_shown", F.concat("table_name", F.lit(" ("), F.format_number("row_count", 0), F.lit(")")))
    return named.groupBy(F.col("db_path").alias("path")).agg(in_order("_shown", "table_name").alias("tables"))


def map_rows(files: DataFrame, links: DataFrame, headings: DataFrame, tables: DataFrame | None = None, depth: int = 1, folder: str | None = None) -> DataFrame:
    """(folder, path, bullet, detail) of each file: what the map says about it.

    The bullet has the name, what the file is about, its tags and its links out and back; the detail
    has its second-level headings.  A database's bullet has its tables.
    """
    shown = files if folder is None else files.filter(under("path", folder))
    rows = degrees(shown, links, "kind", "about", "tags").join(heading_summary(headings), "path", "left")
    rows = rows.join(table_summary(tables), "path", "left") if tables is not None else rows.withColumn("tables", F.lit(None).cast("string"))
    part = lambda test, *c: F.when(test, F.concat(*c)).otherwise(F.lit(""))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`#"), t, F.lit("`"))), " ")
    about = part(F.length("about") > 0, F.lit(" — "), F.col("about"))
    out = F.concat(
        about, part(F.size("tags") > 0, F.lit(" "), tags),
        part((F.col("out_links") > 0) | (F.col("back_links") > 0), F.lit(" → "), F.col("out_links").cast("string"), F.lit(" out, "), F.col("back_links").cast("string"), F.lit(" back")),
    )
    said = F.when(F.col("kind") != "db", out).otherwise(F.when(F.col("tables").isNull(), about).otherwise(F.concat(F.lit(" — "), "tables")))
    bullet = F.concat(F.lit("- **"), basename("path"), F.lit("**"), said)
    return rows.select(path_parts("path", depth).alias("folder"), "path", bullet.alias("bullet"), F.when(F.col("kind") != "db", F.col("headings")).alias("detail"))


def map_text(rows: DataFrame, files: DataFrame, links: DataFrame, updated: str) -> str:
    """The map as Markdown; its counts are of the whole workspace, also where rows are of one folder."""
    counts = files.agg(F.count("*")).first()[0], *links.agg(F.count("*"), F.count_if(~F.col("resolved"))).first()
    lines = ["# Workspace map", f"{counts[0]} files{DOT}{counts[1]} links{DOT}{counts[2]} broken{DOT}updated {updated}"]
    last = None
    for r in rows.orderBy("folder", "path").toLocalIterator():  # one line each, for a reader
        if r["folder"] != last:
            lines += ["", f"## {r['folder']}"]
            last = r["folder"]
        lines += [r["bullet"]] + ([f"  {r['detail']}"] if r["detail"] else [])
    return "\n".join(lines) + "\n"


def report(findings: DataFrame, cap: int | None = 10) -> DataFrame:
    """(category, item, total): up to ``cap`` findings of each category of a health check, and how many there are."""
    every = Window.partitionBy("category")
    if cap is None:
        return findings.withColumn("total", F.count("*").over(every))
    # one category may have most findings: each share of them counts its own and keeps its first ones
    share = Window.partitionBy("category", "_share")
    rows = findings.withColumn("_share", F.pmod(F.xxhash64("item"), F.lit(SHARES)))
    rows = rows.withColumns({"_n": F.count("*").over(share), "_r": F.row_number().over(share.orderBy("item"))}).filter(F.col("_r") <= max(cap, 1))
    total = F.sum(F.when(F.col("_r") == 1, F.col("_n")).otherwise(0)).over(every)
    ranked = rows.withColumns({"total": total, "_r": F.row_number().over(every.orderBy("item"))})
    return ranked.filter(F.col("_r") <= cap).drop("_r", "_n", "_share")


def plural(n, word: str):
    """A count with its word: 1 file, 2 files."""
    n = F.col(n) if isinstance(n, str) else n
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))
