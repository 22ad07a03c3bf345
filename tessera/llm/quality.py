"""Quality rules: base counts and repetition coverage by rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read_table, window_hashes

#: Share of a text's word characters that may lie in repeated n-grams, by n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Fixed value: share of the lines' characters that may lie in lines equal to an earlier one.
LINE_CHAR_LIMIT = 0.20
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double"
)


def covered(ids: np.ndarray, n: int, first: bool) -> np.ndarray | None:
    """Marks the words inside n-word windows found twice or more; ``first``: the first one too.

    Windows meet by rolling hash and are then compared word by word with the first of their hash.
    None: no window repeats.
    """
    hashes = window_hashes(ids, n)
    if len(hashes) < 2:
        return None
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return None
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    leader = np.repeat(order[starts], np.diff(np.concatenate((starts, [len(order)]))))
    later = order != leader
    windows = sliding_window_view(ids, n)
    hit, lead = order[later], leader[later]
    equal = np.ones(len(hit), bool)
    for at in range(0, len(hit), 1 << 16):
        equal[at : at + (1 << 16)] = (windows[hit[at : at + (1 << 16)]] == windows[lead[at : at + (1 << 16)]]).all(axis=1)
    if not equal.all():  # two different windows share a hash: compare them as they are
        seen: dict[bytes, int] = {}
        pairs = [(i, seen.setdefault(windows[i].tobytes(), i)) for i in range(len(windows))]
        hit = np.array([i for i, j in pairs if i != j], int)
        lead = np.array([j for i, j in pairs if i != j], int)
        if not len(hit):
            return None
    edges = np.zeros(len(ids) + 1, np.int32)
    for at in (hit, np.unique(lead)) if first else (hit,):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + n, -1)
    return np.cumsum(edges[:-1]) > 0


def chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) if data.isascii() else int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def measure(text: str | None) -> tuple:
    """The columns after doc_id for one text."""
    data = (text or "").encode()
    words = data.split()
    n, joined = len(words), b"".join(words)
    word_chars = chars(joined)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    distinct = set(lines)
    dup_lines, repeat, share, line_share = len(lines) - len(distinct), 0, 0.0, 0.0
    line_failed = False
    if dup_lines:
        total, once = sum(map(chars, lines)), sum(map(chars, distinct))
        line_share = (total - once) / total
        line_failed = line_share > LINE_CHAR_LIMIT
    ngram_failed = False
    if n > min(NGRAM_LIMITS):
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        sizes = None
        for k in sorted(NGRAM_LIMITS):
            marks = covered(ids, k, first=False)
            if marks is None:  # no longer window repeats either
                break
            if sizes is None:
                sizes = np.fromiter(map(chars, words), np.int64, n)
            part = float(sizes[marks].sum()) / word_chars
            share, ngram_failed = max(share, part), ngram_failed or part > NGRAM_LIMITS[k]
            if k == REPEAT_WINDOW:
                repeat = int(covered(ids, k, first=True).sum())
    base_failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    return n, word_chars, symbols, dup_lines, repeat, base_failed, not (base_failed or line_failed or ngram_failed), share, line_share


def _make() -> Callable[[dict], dict]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def step(rows: dict) -> dict:
        found = list(zip(*map(measure, rows["text"]), strict=True)) or [[]] * (len(names) - 1)
        return dict(zip(names, [rows["doc_id"], *found], strict=True))

    return step


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Counts and a verdict for each document, in one pass without a shuffle.

    ``kept`` is false where a base rule fails (under 20 words, or over 30 % of the words in repeated
    8-word windows), where repeated lines hold over 20 % of the lines' characters, or where the characters inside repeated 5- to 10-word n-grams (first occurrences not counted) pass
    NGRAM_LIMITS.  A null or empty text has no words and fails; repeated rows are judged alike; null
    ids stay; an empty table gives no rows; further columns are dropped.  One text is held at a time,
    however long it is.
    """
    return map_texts(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), _make, SCHEMA)


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(read_table(spark, sf_dir, "documents"))
