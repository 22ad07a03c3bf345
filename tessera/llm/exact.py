"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, map_texts, materialize, read_table, U64, window_hashes

#: A cut falls where the hash of the last WINDOW bytes has CUT_BITS zero bits: 2048 bytes on average.
WINDOW, CUT_BITS = 32, 11
MIN_CHUNK, MAX_CHUNK = 256, 1 << 16
KEY_BYTES = 16


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text; they depend on the text's own bytes alone."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    out, last, block = [], 0, 1 << 20
    for at in range(0, n, block):  # bounded memory for very long texts
        low = max(0, at - WINDOW + 1)
        hashes = window_hashes(np.frombuffer(data, np.uint8, min(n, at + block) - low, low), WINDOW)
        for end in (np.flatnonzero(hashes & U64((1 << CUT_BITS) - 1) == 0) + low + WINDOW).tolist():
            while end - last > MAX_CHUNK:
                last += MAX_CHUNK
                out.append(last)
            if end - last >= MIN_CHUNK and end < n:
                out.append(end)
                last = end
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    return [*out, n]


def normalised(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty."""
    return (text or "").encode().lower()


def _key(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _recipes(size: int) -> Callable[[], Callable[[dict], dict]]:
    def step(rows: dict) -> dict:
        recipe, sha = [], []
        for text in rows["text"]:
            data, at = normalised(text), 0
            keys = []
            for end in cuts(data):
                keys.append(_key(data[at:end], size))
                at = end
            recipe.append(keys)
            sha.append(hashlib.sha256(data).hexdigest())
        return {"doc_id": rows["doc_id"], "row": rows["row"], "recipe": recipe, "text_sha256": sha}

    return lambda: step


def _chunks(size: int) -> Callable[[], Callable[[dict], dict]]:
    def step(rows: dict) -> dict:
        out: dict[str, list] = {"row": [], "seq": [], "key": [], "chunk": []}
        for row, text in zip(rows["row"], rows["text"], strict=True):
            data, at = normalised(text), 0
            for seq, end in enumerate(cuts(data)):
                out["row"].append(row)
                out["seq"].append(seq)
                out["key"].append(_key(data[at:end], size))
                out["chunk"].append(data[at:end])
                at = end
        return out

    return lambda: step


def exact_groups(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Groups of documents whose texts are equal after lower-casing A-Z, with the row that stays.

    Each text is cut into content-defined chunks; its recipe is the ordered list of their
    identifiers.  Identifiers are verified: every distinct chunk's bytes move once, already merged
    within each task, and are compared where they share a key.  Only if different chunks share a key
    (hardly ever with 16 bytes) do the documents that hold them get a second list that tells those
    chunks apart.  Groups are rows with equal lists; texts themselves are never moved or sorted.

    Of equal texts the row with the largest doc_id stays (a null id counts as the smallest; of rows
    that share the largest id exactly one stays).  A null text counts as empty, and empty texts form
    a group.  Every input row gives one row; an empty table gives none; further columns are dropped.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    placed = texts.withColumn("row", F.monotonically_increasing_id())
    recipes = materialize(
        map_texts(placed, _recipes(key_bytes), "doc_id long, row long, recipe array<binary>, text_sha256 string"), "recipes"
    )
    chunks = map_texts(placed.select("row", "text"), _chunks(key_bytes), "row long, seq int, key binary, chunk binary")
    shared = chunks.groupBy("key", "chunk").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.sha2("chunk", 256)))).alias("shas")
    ).filter("n > 1")
    shared = materialize(shared.select("key", "shas"), "shared-keys")
    if shared.isEmpty():
        recipes = recipes.withColumn("apart", F.array().cast("array<struct<seq:int,of:int>>"))
    else:
        apart = chunks.join(shared, "key").select(
            "row", F.struct("seq", F.array_position("shas", F.sha2("chunk", 256)).cast("int").alias("of")).alias("x")
        ).groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("apart"))
        recipes = recipes.join(apart, "row", "left")
        recipes = recipes.withColumn("apart", F.coalesce("apart", F.array().cast("array<struct<seq:int,of:int>>")))
    groups = recipes.groupBy("recipe", "apart").agg(
        F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")
    )
    # a text that a third of all rows have is dealt over parts
    return join_spread(recipes, materialize(groups, "groups"), ["recipe", "apart"], "group_size").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay in exact_groups(), with all their columns; texts move once more."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_sha"))
    kept = kept.withColumn("_row", F.xxhash64("_kept_id"))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    named = docs.withColumns({"_sha": sha, "_row": F.xxhash64(F.col("doc_id").cast("long"))})
    found = named.join(kept, ["_row", "_sha"], "left_semi")  # copies of a text spread by their ids
    return found.dropDuplicates(["_row", "_sha"]).select(*docs.columns)


def ascii_lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (
  SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def op5_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))
