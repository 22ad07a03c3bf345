"""What the corpus operators share: Arrow batches, rolling hashes and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import SLICE_BYTES, arrow_schema, delete, materialize, release, shared_dir, slices  # noqa: F401 - others take them from here

#: Parts of like size into which join_spread() deals the rows of frequent keys.
HOT_PARTS = 10_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, most: int = SLICE_BYTES
) -> DataFrame:
    """mapInArrow over runs of rows.

    ``make`` runs once in each task and returns the function from a dict of column lists to a dict
    of output lists (or arrays).
    """
    names = [x.split()[0] for x in schema.replace("\n", " ").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, most=most):
                out = step(part.to_pydict())
                yield pa.RecordBatch.from_pydict({k: out[k] for k in names}, schema=kinds)

    kinds = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def join_spread(many: DataFrame, few: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join with a written table that says in ``size`` how many rows of ``many`` have each key.

    A key of more than 1 / HOT_PARTS of these rows is dealt over parts of about that many rows, by a
    hash of the row; its row in ``few`` is repeated for each part.  Fewer than HOT_PARTS keys can be
    so frequent, so the list of them that is broadcast is bounded whatever the input's size.
    """
    total = few.agg(F.sum(size)).first()[0] or 1
    few = few.withColumn("_parts", F.least(F.col(size), F.ceil(F.col(size) * F.lit(HOT_PARTS) / F.lit(total))).cast("int"))
    hot = F.broadcast(few.filter("_parts > 1").select(*on, "_parts"))
    part = F.pmod(F.xxhash64(*many.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = many.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    few = few.withColumn("_part", F.explode(F.expr("sequence(0, greatest(_parts, 1) - 1)"))).drop("_parts")
    return dealt.join(few, [*on, "_part"]).drop("_part")


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers[base] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def prefix_sums(symbols: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Sums from which hash_between() takes the hash of any run of symbols."""
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * powers(len(symbols), base)[0], out=out[1:])
    return out


def hash_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of symbols[start:end], the same wherever the run stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums), base)[1][start])


def window_hashes(symbols: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Rolling hashes of every run of k symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = prefix_sums(symbols, base)
    return mix((sums[k:] - sums[:n]) * powers(n, base)[1])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of the undirected edges (a, b); component is the smallest id.

    Alternating stars: every round hooks each node's neighbours to the least node it knows, so the
    depth halves.  A node's neighbours are never gathered; only minima and joins are used, and the
    links of a node with many of them are dealt over parts.  Nulls and loops in edges are ignored.
    Every round is written and read again, so components are made while the query is built.
    """
    links = edges.filter("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    links, before = materialize(links, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = join_spread(both, least, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u != v").distinct(), "large")
        small_least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join_spread(large, small_least, ["u"], "n")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        ).filter("u != v").distinct()
        after = materialize(small, "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (links, least, large, small_least):
            release(done)
        links = after
        if now == before:
            break
        before = now
    # stars now: each u points to its component's least node
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
