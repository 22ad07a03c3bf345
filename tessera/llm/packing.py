"""Best-fit packing with exact-complement hashing over the histogram of lengths."""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, map_texts, materialize, read_table
from .tokenizing import byte_alphabet, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: A length with more pieces is ranked in parts of so many, and in no more parts than GROUPS for all lengths.
PART, GROUPS = 1 << 16, 100_000
#: Entries of a task's word cache; a full cache keeps the words of the text at hand.
CACHE_WORDS = 800_000
#: The word pattern of the tokenizer file, without white space (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters are lower-cased and cut alike by every Unicode version.
PLAIN = re.compile(r"[!-~¡-ĀĂ-įĲ-ſ]+\Z")

#: What keeps a text from being lower-cased and spread out at once: other characters, or marks side by side.
UNEASY = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]|[!-/:-@\[-`{-~]{2}")


class _Words(dict):
    """Packed ids by word (bytes without ASCII white space), learnt when they are missed."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if text.islower() and text.isalpha() and PLAIN.match(text):
            ids = self._piece(text)
        elif "<|" in text or not PLAIN.match(text):
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
            ids = b"".join([self[x.encode()] if x.isalpha() else self._piece(x) for x in PIECES.findall(text)])
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode(self, text: str) -> bytes:
        if UNEASY.search(text) is None:  # case folds letter by letter, and each mark is a piece of its own
            text = text.lower().replace(",", " , ").replace(".", " . ")
        words = text.encode().split()
        if len(self) > CACHE_WORDS:
            kept = {w: self[w] for w in set(words) if w in self}
            self.clear()
            self.update(kept)
        return b"".join(map(self.__getitem__, words))


@functools.lru_cache(maxsize=2)
def words_of(path: str) -> _Words:
    """One cache in each Python worker, which serves its later tasks too."""
    return _Words(path)


def _cut(path: str, capacity: int, end_id: int) -> Callable[[], Callable[[dict], dict]]:
    tail = end_id.to_bytes(4, "little")

    def make() -> Callable[[dict], dict]:
        words = words_of(path)

        def step(rows: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = words.encode(text or "") + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[k].append(v)
            return out

        return step

    return make


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at capacity."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_texts(texts, _cut(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many sequences, lengths in one) that use up the histogram of lengths.

    From the longest length down, a length's gap is looked up among the remaining lengths: a single
    length, then a pair, then a triple with just that sum, found through hashes of the sums.  A
    combination is consumed as often as its lengths' counts allow.  What is left goes best-fit,
    longest first, all pieces of a length that meet equal gaps at once.  The work depends on the
    number of different lengths, at most ``capacity``, not on the number of pieces.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    made: list[tuple[int, tuple[int, ...]]] = []

    def consume(lengths: tuple[int, ...]) -> bool:
        kinds = {x: lengths.count(x) for x in lengths}
        times = min(int(count[x]) // n for x, n in kinds.items())
        if times > 0:
            for x, n in kinds.items():
                count[x] -= n * times
            made.append((times, lengths))
        return times > 0

    for length in range(capacity, 0, -1):
        if count[length] == 0:
            continue
        gap = capacity - length
        if gap == 0:
            consume((length,))
            continue
        if gap <= capacity and count[gap]:
            consume((length, gap))
        while count[length]:  # pairs with that sum; each round uses up a length or finds none
            have = np.flatnonzero(count[: gap + 1])
            have = have[have > 0]
            fit = have[(have <= gap - have) & (count[gap - have] > 0)]
            if not any([consume((length, gap - int(x), int(x))) for x in fit[::-1]]):
                break
        while count[length]:
            have = np.flatnonzero(count[: gap + 1])
            have = have[have > 0]
            done = False
            for c in have[::-1].tolist():  # the largest of the triple; the other two by their sum
                rest = gap - c
                if rest < 2 or rest > 2 * c:
                    continue
                low = have[(have <= c) & (have <= rest - 1)]
                pair = low[(low <= rest - low) & (rest - low <= c) & (count[rest - low] > 0)]
                for x in pair[::-1].tolist():
                    done |= consume((length, c, rest - x, x))
                if not count[length]:
                    break
            if not done:
                break
    # residuals, best fit: groups of equal open sequences by the gap they have
    gaps: dict[int, list[list]] = {}
    open_gaps: list[int] = []
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                each = capacity // length  # new sequences, full of this length
                for n, k in ((left // each, each), (1 if left % each else 0, left % each)):
                    if n:
                        _open(gaps, open_gaps, capacity - k * length, [n, (length,) * k])
                break
            gap = open_gaps[at]
            group = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            each = gap // length
            full = min(group[0], left // each)
            if full:
                _open(gaps, open_gaps, gap - each * length, [full, group[1] + (length,) * each])
                left -= full * each
                if group[0] > full:
                    _open(gaps, open_gaps, gap, [group[0] - full, group[1]])
            else:
                _open(gaps, open_gaps, gap - left * length, [1, group[1] + (length,) * left])
                if group[0] > 1:
                    _open(gaps, open_gaps, gap, [group[0] - 1, group[1]])
                left = 0
    for groups in gaps.values():
        made.extend((n, lengths) for n, lengths in groups)
    return made


def _open(gaps: dict, order: list[int], gap: int, group: list) -> None:
    if gap not in gaps:
        gaps[gap] = []
        order.insert(bisect_left(order, gap), gap)
    gaps[gap].append(group)


class Slots:
    """Where the r-th piece of a length goes, from the patterns of a plan."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for times, lengths in patterns:
            offset = 0
            for length in lengths:
                runs.setdefault(length, []).append((times, sequence, offset))
                offset += length
            sequence += times
        self.sequences = sequence
        self.runs = {}
        for length, found in runs.items():
            times, first, offset = np.array(found, np.int64).T
            ends = np.cumsum(times)
            self.runs[length] = (ends, ends - times, first, offset)

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, starts, first, offset = self.runs[length]
        run = np.searchsorted(ends, rank, side="right")
        return first[run] + rank - starts[run], offset[run]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces, by a plan made on the histogram of their lengths.

    The driver sees one count for each length and part, at most GROUPS + capacity numbers, and the
    plan, which has about as many patterns as there are lengths.  A length with many pieces is dealt
    over parts of about PART pieces, in which they get their ranks.  Pieces as long as a sequence are
    one each, wherever they are, and are not moved.
    """
    whole = materialize(cut.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    sizes = {r["length"]: r["n"] for r in whole.filter(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    each = max(PART, -(-sum(sizes.values()) // GROUPS))
    parts = F.lit(1)
    if many := {k: -(-n // each) for k, n in sizes.items() if n > each}:
        parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("length").cast("int")), F.lit(1))
    table = whole.filter(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("_n"), parts).cast("int")).drop("_n")
    counts = {(r["length"], r["_salt"]): r["n"] for r in table.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()}
    histogram: dict[int, int] = {}
    first: dict[tuple[int, int], int] = {}
    for length, salt in sorted(counts):
        first[length, salt] = histogram.get(length, 0)
        histogram[length] = first[length, salt] + counts[length, salt]
    slots = Slots(plan(histogram, capacity))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    kinds = arrow_schema(cut.sparkSession, schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rank = (-1, -1), 0  # a group may go on in the next batch
        for batch in batches:
            length = batch.column("length").to_numpy()
            salt = batch.column("_salt").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            edges = np.flatnonzero((np.diff(length) != 0) | (np.diff(salt) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(length)], strict=True):
                if a == b:
                    continue
                key = int(length[a]), int(salt[a])
                if key != now:
                    now, rank = key, 0
                sequence[a:b], offset[a:b] = slots.place(key[0], first[key] + rank + np.arange(b - a))
                rank += b - a
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).cast(kinds.field(k).type) for k in kinds.names[:5]] + [pa.array(sequence), pa.array(offset)], schema=kinds
            )

    dealt = table.repartition("length", "_salt").sortWithinPartitions("length", "_salt", "doc_id", "piece", "ids_crc32")
    full = whole.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("_n"), "offset": F.lit(0).cast("long")})
    return dealt.mapInArrow(place, schema).unionByName(full.select(*kinds.names))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    A document is its ids and the end id; only longer ones are cut, into pieces of ``capacity``.
    Null and empty texts are the end id alone; repeated rows are packed one by one; null ids stay; an
    empty table gives no rows; further columns are dropped; long texts are taken whole.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity)


def op9_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
