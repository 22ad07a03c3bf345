"""The SQL surface: statements with a bounded result, and joins that Spark SQL has no word for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AUTO_LIMIT = 100


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    total: int | None  # all rows, if some were left out


def run_sql(spark: SparkSession, statement: str, limit: int = AUTO_LIMIT) -> Result:
    """Run a statement; of a longer result the first ``limit`` rows and its size.

    A longer result is counted in a second run, which Catalyst plans without its columns and order.
    What the statement returns decides, not its first word; a statement's own LIMIT counts as is.
    """
    df = spark.sql(statement)
    if not df.columns:
        return Result([], [], None)
    rows = df.limit(limit + 1).collect()
    return Result(df.columns, [tuple(r) for r in rows[:limit]], df.count() if len(rows) > limit else None)


def render(result: Result) -> str:
    shown = "\n".join(" | ".join("" if v is None else str(v) for v in row) for row in result.rows)
    return shown if result.total is None else f"{shown}\n({len(result.rows)} of {result.total} rows)"


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """left with the last ``value`` of right at or before its time, for equal ``by``.

    Union and one window in place of a range join: linear in the input, whatever the distances.
    """
    marks = right.select(F.col(by), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_v"))
    rows = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(marks.schema["_v"].dataType)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    before = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(before)).filter("_side = 1")
    return found.withColumn(f"asof_{value}", F.col("_v.v")).drop("_t", "_side", "_v")


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high: spans are filed under each bucket of ``width`` that they touch."""
    filed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(filed, "_b").filter(
        (F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))
    ).drop("_b")
