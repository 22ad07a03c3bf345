"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only)."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Modulus of the round function; products of two residues stay below 2**62.
PRIME = 2147483647
ROUNDS = 8
SHARDS = 40
SEED = 20


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    rng = random.Random(seed)
    return [tuple(rng.randrange(1, PRIME) for _ in range(3)) for _ in range(rounds)]


def halves(n: int) -> tuple[int, int]:
    """a * b >= n with fewer than a numbers too many, so that hardly any row walks a cycle."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def quotient(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _round(x: Column, k: Column, size: int) -> Column:
    t = (x % PRIME * k["k0"] + k["k1"]) % PRIME
    return ((t * t + k["k2"]) % PRIME * k["k0"] + t) % PRIME % size


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """A bijection of 0 .. a*b-1: alternating additive rounds on the quotient and the remainder."""
    a, b = halves(n)
    keys = F.array(*[
        F.struct(F.lit(i % 2).alias("side"), *[F.lit(v).cast("long").alias(f"k{j}") for j, v in enumerate(k)])
        for i, k in enumerate(round_keys(seed))
    ])
    start = F.struct(quotient(x, b).alias("l"), (x % b).alias("r"))

    def step(s: Column, k: Column) -> Column:
        return F.when(
            k["side"] == 0, F.struct(((s["l"] + _round(s["r"], k, a)) % a).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _round(s["l"], k, b)) % b).alias("r")))

    return F.aggregate(keys, start, step, lambda s: s["l"] * b + s["r"])


def walk(x: Column, n: int, steps: int, seed: int = SEED) -> Column:
    """Permute, and again while the outcome is no row number, at most ``steps`` more times."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), permute(x, n, seed),
        lambda p, _: F.when(p < n, p).otherwise(permute(p, n, seed)),
    )


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with ``row_number`` 0 .. n-1 in the given order, and n; no task sees more than its range.

    The rows are ranged and sorted once and kept as a table with their place in their range; the
    ranges' sizes (one row for each) give the offsets.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranged")
    part = F.shiftrightunsigned("_place", 33)
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, starts = 0, []
    for p, n in sizes:  # one entry for each range partition
        starts.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    joined = table.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return joined.withColumn("row_number", number).drop("_part", "_start", "_place"), total


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Deal all documents into shards by a reproducible shuffle; law ``rows``.

    Rows are numbered by (doc_id, text_crc32, size), the number is permuted by a Feistel network
    with cycle walking over 0 .. n-1, and permuted % shards and permuted // shards are the shard and
    the slot.  Shard sizes differ by one row at most and slots are gapless from 0.

    A null text has size 16 and the CRC of no bytes; null ids come first; repeated rows are separate
    rows that get places of their own (which of two equal rows gets which is immaterial); an empty
    table gives no rows.  Further columns are dropped.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    table, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    steps = 4
    while n:
        placed = table.withColumn("p", walk(F.col("row_number"), n, steps, seed))
        if placed.agg(F.max("p")).first()[0] < n:
            break
        steps *= 2  # a longer cycle than expected: walk on until none is outside
    else:
        placed = table.withColumn("p", F.lit(0).cast("long"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"),
        quotient(F.col("p"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(read_table(spark, sf_dir, "documents"))
