"""Suffix-array deduplication: repeated byte strings by the difference-cover algorithm.

A string of LENGTH bytes is filed under its minimizer: the least rolling hash of GRAM bytes among its
first WINDOW positions.  Equal strings have equal minimizers and equal bytes from the minimizer on, so
all starts with one minimizer form an *anchor* (first and last start, and a key of the bytes that they
share), and equal strings meet among anchors of one key.  Keys found once are done with.  Anchors
whose whole bytes are equal are known to repeat.  What differs within a key goes to a suffix array
built by the difference-cover algorithm, many keys to a task, and neighbours' prefixes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from .common import U64, arrow_schema, hash_between, join_spread, map_texts, materialize, prefix_sums, read_table, release, window_hashes

LENGTH, GRAM, WINDOW = 400, 32, 128
#: Bytes that any passage of 50 words has if its words are of three letters on average; English and French ones have five or so.
PASSAGE_BYTES = 200
#: Starts of a text that are looked at together; longer texts are cut into runs of starts.
RUN = 1 << 18
#: Different anchors under one key that go to one suffix array; a key with more is parted by its starts'
#: distances from the minimizer, in blocks of STEPS, and what the starts of a block share.
CROWD = 1024
STEPS = (32, 8, 2, 1)
#: Bytes of text in one suffix array.
ARRAY_BYTES = 1 << 19
SECOND_BASE = 0xD6E8FEB86659FD93


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first start, last start, minimizer, key, two hashes of all bytes) of each anchor of a text."""
    found: list[tuple[np.ndarray, ...]] = []
    gram, window = min(GRAM, length), min(WINDOW, length - min(GRAM, length) + 1)
    common = length - window + 1  # bytes from the minimizer on that all starts of an anchor share
    for low in range(0, len(data) - length + 1, RUN):
        text = np.frombuffer(data, np.uint8, min(len(data) - low, RUN + length - 1), low)
        starts = len(text) - length + 1
        hashes = window_hashes(text, gram)[: starts + window - 1]
        least = hashes >> U64(24) << U64(24) | np.arange(len(hashes), dtype=U64)  # ties: the first
        span = 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: starts], least[window - span : window - span + starts])
        at = (least[:starts] & U64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:] - 1, [starts - 1]))
        at = at[first]
        sums, more = prefix_sums(text), prefix_sums(text, SECOND_BASE)
        key = hash_between(sums, at, at + common)
        # where the minimizer lies in the bytes is part of what must be equal
        whole = hash_between(sums, first, last + length) + (at - first).astype(U64)
        other = hash_between(more, first, last + length, SECOND_BASE) ^ (at - first).astype(U64)
        found.append((first + low, last + low, at + low, key.view(np.int64), whole.view(np.int64), other.view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer array (values above 0), by the difference cover {1, 2} mod 3.

    Suffixes at the cover's positions are sorted by their first three symbols; if triples repeat, the
    string of their names is sorted in the same way.  The rest is sorted by one symbol and the rank
    after it, and merged.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    text = np.concatenate((s, np.zeros(3, np.int64)))
    one = np.arange(1, n + (n % 3 == 1), 3)  # one dummy at n if n is 1 mod 3
    two = np.arange(2, n, 3)
    cover = np.concatenate((one, two))
    bits = int(text.max()).bit_length()
    if 3 * bits <= 63:
        triple = text[cover] << 2 * bits | text[cover + 1] << bits | text[cover + 2]
        order = np.argsort(triple, kind="stable")
        changed = np.diff(triple[order]) != 0
    else:
        order = np.lexsort((text[cover + 2], text[cover + 1], text[cover]))
        rows = np.stack([text[cover + i][order] for i in range(3)])
        changed = (np.diff(rows, axis=1) != 0).any(axis=0)
    names = np.empty(len(cover), np.int64)
    names[order] = np.cumsum(np.concatenate(([True], changed)))
    if names[order[-1]] < len(cover):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    ordered = cover[order]
    ordered = ordered[ordered < n]
    wide = len(cover).bit_length()
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(text[zero] << wide | rank[zero + 1], kind="stable")]
    is_one = ordered % 3 == 1
    first, second = ordered[is_one], ordered[~is_one]
    below = np.searchsorted(text[first] << wide | rank[first + 1], text[zero] << wide | rank[zero + 1])
    if 2 * bits + wide <= 63:
        pack = lambda i: text[i] << bits + wide | text[i + 1] << wide | rank[i + 2]
        under = np.searchsorted(pack(second), pack(zero))
    else:  # rank the pairs of symbols first
        pairs = np.concatenate((text[second] << 32 | text[second + 1], text[zero] << 32 | text[zero + 1]))
        _, pairs = np.unique(pairs, return_inverse=True)
        a, b = pairs[: len(second)], pairs[len(second) :]
        under = np.searchsorted(a << wide | rank[second + 2], b << wide | rank[zero + 2])
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + below + under
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = zero
    out[~taken] = ordered
    return out


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its starts 0 .. len - length have a string that another start has."""
    sizes = np.array([len(x) for x in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begin = np.cumsum(sizes) - sizes
    eligible = np.ones(len(text), bool)
    for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        eligible[b + n - length + 1 : b + n] = False
    order = suffix_array(text.astype(np.int64) + 1)
    order = order[eligible[order]]
    marks = np.zeros(len(text), bool)
    windows = sliding_window_view(text, length)
    for at in range(0, len(order) - 1, 4096):  # adjacent prefixes
        a, b = order[at : at + 4096], order[at + 1 : at + 4097]
        a = a[: len(b)]
        same = windows[a, 0] == windows[b, 0]
        same[same] = (windows[a[same]] == windows[b[same]]).all(axis=1)
        marks[a[same]] = True
        marks[b[same]] = True
    return [marks[b : b + n - length + 1] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def intervals(marks: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, as first and last."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


ANCHORS = "k1 long, k2 long, key long, g1 long, g2 long, first int, last int, deep int"


def _anchored(length: int) -> Callable[[], Callable[[dict], dict]]:
    def step(rows: dict) -> dict:
        out: list[list[np.ndarray]] = [[] for _ in range(8)]
        for k1, k2, text in zip(rows["k1"], rows["k2"], rows["text"], strict=True):
            first, last, at, key, g1, g2 = anchors((text or "").encode(), length)
            n = len(first)
            for to, x in zip(out, (np.full(n, k1), np.full(n, k2), key, g1, g2, first, last, at - first), strict=True):
                to.append(x)
        names = [x.split()[0] for x in ANCHORS.split(", ")]
        kinds = [np.int64] * 5 + [np.int32] * 3
        return {k: np.concatenate(x).astype(t) if x else np.zeros(0, t) for k, x, t in zip(names, out, kinds, strict=True)}

    return lambda: step


def _press(texts: pd.Series) -> pd.Series:
    """Texts as zstd frames, which move and spill in a third of the space."""
    with_level = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda x: with_level.compress(x.encode()))


def _unpress(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


PIECES = "within long, key long, g1 long, g2 long, crowded boolean, a int, deep int, piece binary"


def _cut(length: int, kinds: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of anchors, from the texts that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pydict()
                out: dict[str, list] = {k: [] for k in kinds.names}
                for z, wanted in zip(rows["z"], rows["wanted"], strict=True):
                    data = _unpress(z)
                    for w in wanted:
                        for k in ("key", "g1", "g2", "crowded", "deep"):
                            out[k].append(w[k])
                        out["within"].append(w["key"])
                        out["a"].append(0)
                        out["piece"].append(data[w["first"] : w["last"] + length])
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return run


PARTS = "within long, same binary, key long, g1 long, g2 long, a int, deep int, piece binary"


def _parted(length: int, step: int) -> Callable[[], Callable[[dict], dict]]:
    """Pieces cut into blocks of starts by distance from the minimizer.

    ``within`` stands for the block and the bytes that all its starts share, which equal strings have
    in common; ``same`` for all bytes.
    """

    def run(rows: dict) -> dict:
        out: dict[str, list] = {x.split()[0]: [] for x in PARTS.split(", ")}
        for within, key, g1, g2, a, deep, piece in zip(*(rows[k] for k in ("within", "key", "g1", "g2", "a", "deep", "text")), strict=True):
            shallow = deep - (len(piece) - length)
            for block in range(shallow // step, deep // step + 1):
                far, close = min(deep, block * step + step - 1), max(shallow, block * step)
                part = piece[deep - far : deep - close + length]
                core = piece[deep - block * step : deep - block * step - step + 1 + length]
                name = hashlib.blake2b(b"%d %d %d " % (within, step, block) + core, digest_size=8).digest()
                same = hashlib.blake2b(b"%d " % far + part, digest_size=16).digest()
                row = int.from_bytes(name, "little", signed=True), same, key, g1, g2, a + deep - far, far, part
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    return lambda: run


FOUND = "key long, g1 long, g2 long, runs array<struct<a:int,b:int>>"


def _sorted_out(length: int, kinds: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffix arrays over whole groups (within), up to ARRAY_BYTES of text in each."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        marks = repeated_starts([r[5] for r in rows], length)
        out = [(*r[1:4], [{"a": r[4] + a, "b": r[4] + b} for a, b in runs]) for r, m in zip(rows, marks, strict=True) if (runs := intervals(m))]
        return pa.RecordBatch.from_pydict(dict(zip(kinds.names, map(list, zip(*out, strict=True)), strict=True)) if out else {k: [] for k in kinds.names}, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("within", "key", "g1", "g2", "a", "piece")), strict=True):
                if size >= ARRAY_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return run


SPANS = "n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
#: Instead of kept, where whole characters are asked for.
DECODED = "n_bytes long, spans array<struct<start:long,end:long>>, text string"


def _removed(carried: list[str], kinds: pa.Schema, length: int, decoded: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                out: tuple[list, list, list] = [], [], []
                for z, starts in zip(rows.column("z").to_pylist(), rows.column("starts").to_pylist(), strict=True):
                    data, spans, parts, end = _unpress(z), [], [], 0
                    for x in sorted((x["a"], x["b"] + length) for x in starts or ()):
                        if spans and x[0] <= spans[-1]["end"]:
                            spans[-1]["end"] = max(spans[-1]["end"], x[1])
                        else:
                            spans.append({"start": x[0], "end": x[1]})
                    for s in spans:
                        parts.append(data[end : s["start"]])
                        end = s["end"]
                    parts.append(data[end:])
                    for to, v in zip(out, (len(data), spans, b"".join(parts)), strict=True):
                        to.append(v)
                if decoded:  # here and not in a UDF of its own, which would take a second Python worker in each task
                    begin, end = ([[s[k] for s in x] for x in out[1]] for k in ("start", "end"))
                    out = out[0], out[1], _whole_characters(out[2], begin, end).tolist()
                new = [pa.array(x, kinds.field(len(carried) + i).type) for i, x in enumerate(out)]
                old = [rows.column(k).cast(kinds.field(i).type) for i, k in enumerate(carried)]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=kinds)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, carry: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """(doc_id, carried columns, n_bytes, spans, kept): each document without repeated strings' bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    document or another; all strings are judged on the input.  ``spans`` are the maximal removed runs
    and ``kept`` the other bytes.  Rows are told apart by doc_id and a hash of doc_id and text, so of
    repeated rows each is a repeat of the others.  Null and empty texts have no bytes; texts shorter
    than ``length`` keep everything; null ids stay; an empty table gives no rows; further columns are
    dropped unless named in ``carry``; with ``decoded`` there is ``text``, of whole characters, in place
    of ``kept``.  Long texts are anchored in runs and never compared as a whole.

    A key of more than ``crowd`` different anchors (a common passage in many surroundings) does not go
    to one task.  Its starts are parted by their distance from the minimizer, in ever smaller blocks,
    and by the bytes that a block's starts share: what lies inside the passage then is equal as a
    whole, and what reaches out of it parts by its surroundings.
    """
    spark = docs.sparkSession
    press = F.pandas_udf(_press, BinaryType())
    carried = ["doc_id", *[f"_carried_{i}" for i in range(len(carry))]]
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`").alias(to) for c, to in zip(carry, carried[1:], strict=True)],
    )
    texts = texts.withColumns({"k1": F.coalesce("doc_id", F.lit(0).cast("long")), "k2": F.xxhash64("doc_id", "text")})
    long_ones = texts.filter(F.octet_length("text") >= length)
    found = map_texts(long_ones.select("k1", "k2", "text"), _anchored(length), ANCHORS)
    shared_keys = materialize(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    hits = materialize(join_spread(found, shared_keys, ["key"], "n").drop("n"), "anchors")

    wholes = hits.groupBy("key", "g1", "g2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "first", "last", "deep")).alias("at"))
    wholes = materialize(wholes, "wholes")
    kinds = materialize(wholes.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "kinds")
    open_ones = join_spread(wholes, kinds, ["key"], "kinds").select("key", "g1", "g2", (F.col("kinds") > crowd).alias("crowded"), "at.*")
    wanted = open_ones.groupBy("k1", "k2").agg(F.collect_set(F.struct("key", "g1", "g2", "crowded", "first", "last", "deep")).alias("wanted"))
    # written, so that no task that presses texts has another Python operator: each one takes a worker of its own
    pressed = materialize(texts.select(*carried, "k1", "k2", F.octet_length("text").alias("size"), press("text").alias("z")), "pressed")
    once = pressed.filter(F.col("size") >= length).select("k1", "k2", "z")
    pieces = materialize(once.join(wanted, ["k1", "k2"]).select("z", "wanted").mapInArrow(_cut(length, arrow_schema(spark, PIECES)), PIECES), "pieces")

    found_schema = arrow_schema(spark, FOUND)
    columns = ["within", "key", "g1", "g2", "a", "deep", "piece"]
    ready, crowded, full = pieces.filter("not crowded").select(columns), pieces.filter("crowded").select(columns), None
    kept = [shared_keys, kinds, pieces]
    for step in STEPS:
        if crowded.isEmpty():
            break
        given = crowded.withColumnRenamed("piece", "text")
        parts = materialize(map_texts(given, _parted(length, step), PARTS), "parts")
        by = parts.groupBy("within", "same").agg(F.count("*").alias("n"), F.min(F.struct("key", "g1", "g2", "a")).alias("one"))
        by = materialize(by, "equals")
        sorts = materialize(by.groupBy("within").agg(F.count("*").alias("sorts")), "sorts")
        both = materialize(join_spread(by, sorts, ["within"], "sorts"), "equals")
        counted = materialize(join_spread(parts, both, ["within", "same"], "n"), "counted")
        kept += [parts, by, sorts, both, counted]
        again = counted.filter("n > 1").select("key", "g1", "g2", F.array(F.struct(
            F.col("a"), (F.col("a") + F.octet_length("piece") - length).cast("int").alias("b"))).alias("runs"))
        full = again if full is None else full.unionByName(again)
        rest = counted.filter((F.col("sorts") > 1) & (F.struct("key", "g1", "g2", "a") == F.col("one")))
        ready = ready.unionByName(rest.filter(F.col("sorts") <= crowd).select(columns))
        crowded = rest.filter(F.col("sorts") > crowd).select(columns)
    dealt = ready.repartition("within").sortWithinPartitions("within", "key", "g1", "g2", "a")
    runs = dealt.mapInArrow(_sorted_out(length, found_schema), FOUND)
    runs = materialize(runs if full is None else runs.unionByName(full), "runs")

    same = wholes.filter("n > 1").select("key", "g1", "g2", "n", F.lit(None).cast("array<struct<a:int,b:int>>").alias("runs"))
    differ = runs.join(same, ["key", "g1", "g2"], "left_anti").select("key", "g1", "g2", F.lit(1).cast("long").alias("n"), "runs")
    marks = materialize(same.unionByName(differ), "marks")
    marked = join_spread(hits, marks, ["key", "g1", "g2"], "n")
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first")).alias("b")))
    spans = marked.select("k1", "k2", "first", F.explode(F.coalesce("runs", whole)).alias("r")).select(
        "k1", "k2", F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b")).alias("s")
    )
    spans = spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("starts"))  # a set, as repeated rows have the same spans
    spans = materialize(spans, "starts")
    for done in (*kept, runs, marks, wholes, hits):
        release(done)
    schema = StructType([*pressed.select(*carried).schema, *StructType.fromDDL(DECODED if decoded else SPANS)])
    joined = pressed.join(spans, ["k1", "k2"], "left").select(*carried, "z", "starts")
    out = joined.mapInArrow(_removed(carried, to_arrow_schema(schema), length, decoded), schema)
    return out.withColumnsRenamed(dict(zip(carried[1:], carry, strict=True)))


def _whole_characters(kept: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Text of the kept bytes; each run between spans is decoded apart, so that no bytes join over a removed one."""
    out = []
    for data, begin, end in zip(kept, starts, ends, strict=True):
        begin, end = np.asarray(begin, np.int64), np.asarray(end, np.int64)
        cuts = [0, *(begin - np.concatenate(([0], np.cumsum(end - begin)[:-1]))).tolist(), len(data)] if len(begin) else [0, len(data)]
        out.append("".join(bytes(data[i:j]).decode(errors="ignore") for i, j in zip(cuts, cuts[1:])))
    return pd.Series(out, dtype=object)


def without_repeats(docs: DataFrame, length: int = PASSAGE_BYTES) -> DataFrame:
    """docs with the bytes of repeated strings taken out of text; a character cut in two goes whole.

    Strings have PASSAGE_BYTES, so that passages of 50 words go wherever they repeat.  All rows stay,
    also those of which nothing is left; null texts become empty; see remove_repeats() for odd cases.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = remove_repeats(docs, length, carry=others, decoded=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
