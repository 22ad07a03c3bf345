"""SimHash near-duplicates by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, arrow_schema, connected_components, join_spread, map_texts, materialize, read_table

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: A bucket of more fingerprints is dealt out again by its remaining bits.
BUCKET = 1 << 14
#: Full buckets up to which their list is broadcast; more of them are joined by a shuffle.
MARKS = 50_000
#: Comparisons of one fingerprint with one block of 64 that run side by side.
TASKS = 1 << 15
ONE = U64(1)


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles of a text, repeats included; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return hash_of(b" ".join(words), SEED)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(
        b"".join([digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]), np.uint8
    ).reshape(-1, 8)  # big-endian: the first byte holds the highest bits
    value = 0
    for i in range(8):
        ones = np.bincount(hashes[:, i], minlength=256) @ BYTE_BITS
        for one in (2 * ones > len(hashes)).tolist():
            value = value << 1 | one
    return value


#: Which bits a byte has, highest first.
BYTE_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1


def _fingerprints() -> Callable[[dict], dict]:
    def step(rows: dict) -> dict:
        values = np.array([fingerprint(x) for x in rows["text"]], U64)
        return {"doc_id": rows["doc_id"], "fp": values.view(np.int64)}

    return step


def _hashed_fingerprints() -> Callable[[dict], dict]:
    step = _fingerprints()
    return lambda rows: step(rows) | {"h": rows["h"]}


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each document, fp being the 64 bits as a signed long."""
    return map_texts(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), _fingerprints, "doc_id long, fp long")


def close_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints in the same bucket at a distance of ``radius`` at most.

    Fingerprints are sorted by bucket.  Each bucket is cut into blocks of 64; a block is kept as 64
    bit planes, one word for each bit, with a lane for each of its fingerprints.  One fingerprint
    meets a whole block at once: a plane is inverted where its bit is set, and the differences of
    all 64 lanes are added by carry-save counters.  Counters start so that a lane overflows at
    radius + 1; an overflow sticks, and a comparison whose lanes have all overflowed is abandoned.
    """
    n = len(fps)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    rank = np.arange(n) - np.repeat(starts, sizes)
    blocks_in = -(-sizes // 64)
    first_block = np.concatenate(([0], np.cumsum(blocks_in)[:-1]))
    block = np.repeat(first_block, sizes) + rank // 64
    lane = (rank % 64).astype(U64)
    total = int(blocks_in.sum())
    lanes = np.zeros(total, U64)
    np.bitwise_or.at(lanes, block, ONE << lane)
    planes = np.zeros((BITS, total), U64)
    edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    for bit in range(BITS):
        planes[bit] = np.bitwise_or.reduceat((fps >> U64(bit) & ONE) << lane, edges)
    block_start = edges
    last_block = np.repeat(first_block + blocks_in, sizes)
    todo = last_block - block  # a fingerprint meets its own block and those after it
    width = (radius + 1).bit_length()
    bias = (1 << width) - 1 - radius
    ends = np.cumsum(todo)
    for low in range(0, int(ends[-1]), TASKS):
        high = min(low + TASKS, int(ends[-1]))
        task = np.arange(low, high)
        query = np.searchsorted(ends, task, side="right")
        other = block[query] + task - (ends[query] - todo[query])
        own = other == block[query]
        alive = lanes[other]
        # in its own block a fingerprint meets only the later lanes
        later = ~((ONE << lane[query]) | ((ONE << lane[query]) - ONE))
        alive = np.where(own, alive & later, alive)
        counters = [np.full(len(task), ~U64(0) if bias >> i & 1 else U64(0)) for i in range(width)]
        value = fps[query]
        for bit in range(BITS):
            if bit % 8 == 0:
                keep = np.flatnonzero(alive)
                if len(keep) < len(alive):
                    query, other, value, alive = query[keep], other[keep], value[keep], alive[keep]
                    counters = [c[keep] for c in counters]
                if not len(alive):
                    break
            carry = planes[bit][other] ^ (U64(0) - (value >> U64(bit) & ONE))
            for i in range(width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            alive = alive & ~carry
        keep = np.flatnonzero(alive)
        query, other, alive = query[keep], other[keep], alive[keep]
        while len(query):
            lowest = alive & (~alive + ONE)
            yield query, block_start[other] + np.log2(lowest.astype(np.float64)).astype(np.int64)
            alive = alive ^ lowest
            keep = np.flatnonzero(alive)
            query, other, alive = query[keep], other[keep], alive[keep]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node of its component under the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            split = x != y
            if not split.any():
                break
            a, b, x, y = a[split], b[split], x[split], y[split]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _linked(radius: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b) from each node of a bucket to the first that it is linked with there."""

    def found(ids: np.ndarray, fps: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        label = spanning(len(fps), close_pairs(fps, bucket, radius))
        joined = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[label[joined]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            """Compare whole buckets; the last one may go on in the next batch."""
            nonlocal held, size
            if not held:
                return None
            table, part, key, ids, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            change = np.concatenate(([True], (table[1:] != table[:-1]) | (part[1:] != part[:-1]) | (key[1:] != key[:-1])))
            bucket = np.cumsum(change)
            cut = len(ids) if last else int(np.flatnonzero(change)[-1])
            held = [] if last else [(table[cut:], part[cut:], key[cut:], ids[cut:], fps[cut:])]
            size = len(ids) - cut
            return found(ids[:cut], fps[:cut].view(U64), bucket[:cut]) if cut else None

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy() for k in ("t", "part", "key", "id", "fp")))
            size += batch.num_rows
            if size >= 4 * BUCKET and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return run


def _parts(first: int, bits: int, radius: int) -> list[tuple[int, int]]:
    """radius + 1 ranges (shift, width) of ``bits`` bits from ``first``; fingerprints that differ in
    radius bits at most agree in at least one of them."""
    n = radius + 1
    widths = [bits // n + (i < bits % n) for i in range(n)]
    return [(first + sum(widths[:i]), w) for i, w in enumerate(widths)]


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect just the fingerprints (id, fp) within ``radius``; each fp is there once.

    The 64 bits are cut into radius + 1 parts, one of which two close fingerprints share; rows meet in
    a bucket for each part and value.  A bucket over ``bucket`` rows is dealt out again by parts of
    its other bits, and so on until no bucket is larger or so few bits are left that their values
    bound it: exact, with no cap.
    """
    rotated = lambda left: F.shiftleft("fp", left).bitwiseOR(F.shiftrightunsigned("fp", 64 - left)) if left else F.col("fp")
    choices = []
    for t, (shift, width) in enumerate(_parts(0, BITS, radius)):
        # the part's bits go lowest, the others above them
        choices.append(F.struct(F.lit(t).alias("t"), F.lit(width).alias("used"), rotated((64 - shift) % 64).alias("bits")))
    rows = nodes.select("id", "fp", F.explode(F.array(*choices)).alias("c")).select("id", "fp", "c.t", "c.used", "c.bits")
    rows = rows.withColumn("part", F.lit(0).cast("long"))
    key = lambda used, bits: bits.bitwiseAND(F.expr("shiftleft(1L, least(used, 63)) - 1"))
    rows = rows.withColumn("key", key(F.col("used"), F.col("bits")))
    done = None
    while True:
        full = materialize(rows.groupBy("t", "part", "key", "used").agg(F.count("*").alias("n")).filter(F.col("n") > bucket), "full")
        splits = F.col("used") <= 64 - 3 * (radius + 1)  # below, a bucket has few distinct values
        if full.filter(splits).isEmpty():
            break
        marks = full.filter(splits).select("t", "part", "key", F.lit(True).alias("over"))
        few = marks.count() <= MARKS
        marked = rows.join(F.broadcast(marks) if few else marks.hint("merge"), ["t", "part", "key"], "left")
        calm = marked.filter("over is null").drop("over")
        done = calm if done is None else done.unionByName(calm)
        over = marked.filter("over").withColumn("step", F.ceil((64 - F.col("used")) / (radius + 1)).cast("int"))
        again = over.withColumn("x", F.explode(F.array(*[F.lit(i) for i in range(radius + 1)])))
        shift = F.least(F.col("x") * F.col("step"), 64 - F.col("used"))
        width = F.least(F.col("step"), 64 - F.col("used") - shift)
        again = again.withColumn("shift", shift).withColumn("width", width).filter("width > 0")
        rest = F.expr("shiftrightunsigned(bits, used) & (shiftleft(1L, 64 - used) - 1)")
        again = again.withColumn("rest", rest)
        again = again.withColumn("picked", F.expr("shiftrightunsigned(rest, shift) & (shiftleft(1L, width) - 1)"))
        others = F.expr("shiftleft(shiftrightunsigned(rest, shift + width), shift) | (rest & (shiftleft(1L, shift) - 1))")
        again = again.withColumn("low", F.expr("bits & (shiftleft(1L, used) - 1)"))
        again = again.withColumn("others", others)
        again = again.withColumn("bits", F.expr("if(used + width >= 64, 0L, shiftleft(others, used + width)) | shiftleft(picked, used) | low"))
        again = again.withColumn("part", F.xxhash64("part", "x", "used", "key")).withColumn("used", F.expr("used + width"))
        rows = again.select("id", "fp", "t", "used", "bits", "part").withColumn("key", key(F.col("used"), F.col("bits")))
        rows = materialize(rows, "split")
    rows = rows if done is None else done.unionByName(rows)
    schema = "a long, b long"
    dealt = rows.select("t", "part", "key", "id", "fp").repartition("t", "part", "key").sortWithinPartitions("t", "part", "key", "id")
    return dealt.mapInArrow(_linked(radius, arrow_schema(nodes.sparkSession, schema)), schema)


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of each document; fingerprints link at ``radius`` or fewer bits.

    Equal fingerprints are one node from the start, so copies are never compared with each other.
    Distinct fingerprints meet in buckets and are compared bit-sliced; within a bucket only enough
    links to connect it are kept, and components are found by distributed alternating stars.  Null, empty and blank texts have fingerprint zero and are
    linked like any other; a null doc_id keeps its row (component of its fingerprint; null if no row
    there has an id); repeated rows give repeated rows; an empty table gives none; further columns
    are dropped.
    """
    return _components(fingerprints(docs), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _components(found: DataFrame, radius: int) -> DataFrame:
    """found (doc_id, fp, ...) with component_id and a label of its own for each component; written tables are made while the query is built."""
    prints = materialize(found, "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "nodes")
    # fingerprints are the nodes, so that two texts under one doc_id are no link between theirs
    linked = connected_components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius)).withColumnRenamed("id", "fp")
    labelled = materialize(nodes.join(linked, "fp", "left").withColumn("label", F.coalesce("component", "fp")).drop("component"), "labelled")
    least = materialize(labelled.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("m")), "least")
    named = join_spread(labelled, least, ["label"], "m").select("fp", "n", "label", "component_id")
    return join_spread(prints, materialize(named, "named"), ["fp"], "n").drop("n")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that are the first, by doc_id, of their component, with all their columns.

    Of rows that share the first doc_id one stays, by a hash of the text.  Rows without an id cannot
    be named as the first and stay.  Null and empty texts are documents like any other (fingerprint
    zero); texts are read whole; an empty table gives no rows.
    """
    known = docs.filter("doc_id is not null")
    text_hash = F.xxhash64(F.col("text").cast("string"))
    given = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash.alias("h"))
    prints = map_texts(given, _hashed_fingerprints, "doc_id long, h long, fp long")
    first = _components(prints, radius).groupBy("label").agg(F.min(F.struct("doc_id", "h")).alias("x")).select("x.*")
    first = materialize(first.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "first")
    kept = known.join(first, (F.col("doc_id").cast("long") == F.col("_id")) & (text_hash == F.col("_h")), "left_semi")
    if not known.groupBy("doc_id", text_hash.alias("_h")).count().filter("count > 1").isEmpty():  # rows that repeat as a whole
        kept = kept.withColumn("_h", text_hash).dropDuplicates(["doc_id", "_h"]).drop("_h")
    return kept.unionByName(docs.filter("doc_id is null"))


def op7_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
