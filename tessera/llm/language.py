"""Language ID: a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, hash_between, map_texts, mix, prefix_sums, read_table, slices

#: Training sample: about so many documents, none longer than so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
TABLE_BITS = 16
#: Bytes in an n-gram feature; those that reach a word's border are its affixes.
ORDERS = (1, 2, 3, 4)
#: Words in a block of the forward-backward pass.
BLOCK = 64
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
_MARKS = bytes(i for i in range(128) if not chr(i).isalpha())
_BLANKED = bytes.maketrans(_MARKS, b" " * len(_MARKS))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and of other characters."""
    return (text or "").lower().encode().translate(_BLANKED).split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of distinct words, one after another, and where each word's slots start.

    A word stands between border bytes.  Its features are all n-grams of ORDERS (with a border:
    affixes) and the word as a whole (its entry in the learned lexicon).
    """
    text = np.frombuffer(b"\x01" + b"\x01".join(words) + b"\x01", np.uint8)
    border = np.flatnonzero(text == 1)
    begin, end = border[:-1], border[1:] + 1  # each word with both borders
    mask = U64((1 << TABLE_BITS) - 1)
    sums = prefix_sums(text)
    slots, owner = [], []
    for n in ORDERS:
        at = np.arange(len(text) - n + 1)
        word = np.searchsorted(border, at, side="right") - 1
        word = np.minimum(word, len(words) - 1)
        inside = (at >= begin[word]) & (at + n <= end[word])
        at, word = at[inside], word[inside]
        slots.append(mix(hash_between(sums, at, at + n) + U64(n)) & mask)
        owner.append(word)
    slots.append(mix(hash_between(sums, begin, end) + U64(99)) & mask)
    owner.append(np.arange(len(words)))
    slot, own = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    own = own[order]
    return slot[order].astype(np.int64), np.searchsorted(own, np.arange(len(words)))


@dataclass
class Crf:
    """Weights of features (slot, language), transitions and starts, all in log space."""

    langs: list[str]
    weight: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Mean feature weight of each word for each language; each distinct word is scored once."""
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        slot, first = features(list(known))
        sums = np.add.reduceat(self.weight[slot], first, axis=0)
        return (sums / np.sqrt(np.diff(np.append(first, len(slot))))[:, None])[ids]

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(language of a word | all words of its text), by forward-backward.

        Texts stand one after another.  Each is cut into blocks; all blocks' transfer matrices are
        multiplied up side by side, messages then pass from block to block along each text, and
        blocks are filled in side by side: exact, without a Python step for each word.
        """
        k = len(self.langs)
        blocks = -(-lengths // BLOCK)
        first_word = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
        doc = np.repeat(np.arange(len(lengths)), blocks)
        number = np.arange(int(blocks.sum())) - first_block[doc]
        begin = first_word[doc] + number * BLOCK
        size = np.minimum(BLOCK, lengths[doc] - number * BLOCK)
        score = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        move, start = np.exp(self.move), np.exp(self.start)
        n = len(begin)
        carry = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for t in range(BLOCK):
            on = np.flatnonzero(size > t)
            if not len(on):
                break
            step = (carry[on] if t == 0 else carry[on] @ move) * score[begin[on] + t][:, None, :]
            carry[on] = step / step.max(axis=(1, 2), keepdims=True)
        # a text's first word has no move before it: the starts stand in its place
        before, after = np.ones((n, k)), np.ones((n, k))
        most = int(blocks.max())
        state = np.broadcast_to(start, (len(lengths), k)).copy()
        for j in range(most):
            on = np.flatnonzero(blocks > j)
            at = first_block[on] + j
            before[at] = state[on]
            out = np.einsum("ni,nij->nj", state[on], carry[at]) @ move  # ready for the next block's first word
            state[on] = out / out.max(axis=1, keepdims=True)
        state = np.ones((len(lengths), k))
        for j in range(most - 1, -1, -1):
            on = np.flatnonzero(blocks > j)
            at = first_block[on] + j
            after[at] = state[on]
            out = np.einsum("nij,nj->ni", carry[at], state[on]) @ move.T
            state[on] = out / out.max(axis=1, keepdims=True)
        forward = np.empty_like(score)
        message = before
        for t in range(BLOCK):
            on = np.flatnonzero(size > t)
            if not len(on):
                break
            out = (message[on] if t == 0 else message[on] @ move) * score[begin[on] + t]
            message[on] = out / out.sum(axis=1, keepdims=True)
            forward[begin[on] + t] = message[on]
        message = after
        for t in range(BLOCK - 1, -1, -1):
            on = np.flatnonzero(size > t)
            if not len(on):
                continue
            at = begin[on] + t
            forward[at] *= message[on]
            out = (message[on] * score[at]) @ move.T
            message[on] = out / out.max(axis=1, keepdims=True)
        return forward / forward.sum(axis=1, keepdims=True)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, np.ndarray | None]]:
        """(language, its mean marginal, marginals of the words) of each text."""
        words = [words_of(x) if x and LETTER.search(x) else [] for x in texts]
        lengths = np.array([len(x) for x in words], np.int64)
        some = np.flatnonzero(lengths)
        out: list[tuple[str, float, np.ndarray | None]] = [(UNDETERMINED, 0.0, None)] * len(texts)
        if not len(some) or not self.langs:
            return out
        flat = [w for x in words for w in x]
        found = self.marginals(self.emissions(flat), lengths[some])
        ends = np.cumsum(lengths[some])
        for i, a, b in zip(some.tolist(), (ends - lengths[some]).tolist(), ends.tolist(), strict=True):
            mean = found[a:b].mean(axis=0)
            best = int(mean.argmax())
            out[i] = self.langs[best], min(1.0, float(mean[best])), found[a:b]
        return out


def train(texts: list[str], labels: list[str], seed: int = 4, steps: int = 400, batch: int = 48, length: int = 24) -> Crf:
    """Maximise the likelihood of word labels in code-switched sequences by AdaGrad.

    A text's words carry its language.  Training sequences splice runs of 3 to 24 words from
    random texts, so that both staying and switching are seen.
    """
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(seed)
    model = Crf(langs, np.zeros((1 << TABLE_BITS, k)), np.zeros((k, k)), np.zeros(k))
    known: dict[bytes, int] = {}
    held = []
    for text, lang in zip(texts, labels, strict=True):
        ids = [known.setdefault(w, len(known)) for w in words_of(text)]
        if ids:
            held.append((np.array(ids), langs.index(lang)))
    if not held:
        return Crf([], model.weight, model.move, model.start)
    by_lang = [[x for x, y in held if y == i] for i in range(k)]
    by_lang = [(i, x) for i, x in enumerate(by_lang) if x]
    slot, first = features(list(known))
    last = np.append(first[1:], len(slot))
    root = np.sqrt(last - first)
    grads = [np.full_like(x, 1e-2) for x in (model.weight, model.move, model.start)]
    for _ in range(steps):
        ids, gold = np.empty((batch, length), np.int64), np.empty((batch, length), np.int64)
        for row in range(batch):
            at = 0
            while at < length:
                lang, texts_of = by_lang[rng.integers(len(by_lang))]
                words = texts_of[rng.integers(len(texts_of))]
                run = min(int(rng.integers(3, length + 1)), length - at, len(words))
                low = int(rng.integers(len(words) - run + 1))
                ids[row, at : at + run], gold[row, at : at + run] = words[low : low + run], lang
                at += run
        flat = ids.ravel()
        counts = (last - first)[flat]
        take = np.repeat(first[flat] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        emission = np.add.reduceat(model.weight[slot[take]], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / root[flat][:, None]
        score = np.exp(emission - emission.max(axis=1, keepdims=True)).reshape(batch, length, k)
        move, start = np.exp(model.move), np.exp(model.start)
        alpha, beta = np.empty((length, batch, k)), np.ones((length, batch, k))
        now = start * score[:, 0]
        alpha[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, length):
            now = alpha[t - 1] @ move * score[:, t]
            alpha[t] = now / now.sum(axis=1, keepdims=True)
        pair = np.zeros((k, k))
        for t in range(length - 1, 0, -1):
            right = beta[t] * score[:, t]
            joint = alpha[t - 1][:, :, None] * move[None] * right[:, None, :]
            pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now = right @ move.T
            beta[t - 1] = now / now.max(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        post = post.transpose(1, 0, 2)
        error = np.eye(k)[gold] - post
        gold_pair = np.zeros((k, k))
        np.add.at(gold_pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        per_word = error.reshape(-1, k) / root[flat][:, None]
        per_slot = np.repeat(per_word, counts, axis=0)
        changed = np.stack([np.bincount(slot[take], per_slot[:, j], 1 << TABLE_BITS) for j in range(k)], axis=1) / batch
        changes = (changed - 1e-5 * model.weight, (gold_pair - pair) / batch - 1e-3 * model.move, error[:, 0].sum(axis=0) / batch)
        for value, past, change in zip((model.weight, model.move, model.start), grads, changes, strict=True):
            past += change * change
            value += 0.3 * change / np.sqrt(past)
    return model


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null id counts as no text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def sampled(df: DataFrame, most: int, salt: int) -> DataFrame:
    """About ``most`` rows chosen by a hash of their id, in one pass; never over twice as many."""
    n = df.count()
    share = min(1.0, most / n) if n else 1.0
    pick = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    return df.filter(pick).limit(2 * most)


def fit(docs: DataFrame, holdout: Column, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Crf:
    """Train on a bounded sample of documents that have text and lang and are not held out."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~holdout & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= chars))
    found = sorted((r["doc_id"] or 0, r["text"], r["lang"]) for r in sampled(rows, sample, 4).collect())
    return train([x[1] for x in found], [x[2] for x in found])


def _labelled(model) -> Callable[[], Callable[[dict], dict]]:
    def make() -> Callable[[dict], dict]:
        crf = model.value

        def step(rows: dict) -> dict:
            found = crf.label(rows["text"])
            switches, words = [], []
            for _, _, marginals in found:
                best = marginals.argmax(axis=1) if marginals is not None else np.zeros(0)
                words.append(len(best))
                switches.append(int(np.count_nonzero(np.diff(best))))
            return {
                "doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": [x[0] for x in found],
                "score": [x[1] for x in found], "n_words": words, "n_switches": switches,
            }

        return step

    return make


def identify(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """Language of each document, from word labels of a CRF trained on the folds that are not held out.

    ``lang_pred`` is the language with the largest mean word marginal, ``score`` that mean,
    ``n_switches`` how often neighbouring words' best labels differ.  Only texts and their ``lang`` in
    the other folds are learned from, in a sample of about SAMPLE_DOCS documents of at most
    SAMPLE_CHARS characters; whole texts are labelled.  A null text or one without letters is ``und``
    with score 0, as is everything if nothing could be learned; null ids are in the fold of no text;
    repeated rows are labelled alike; an empty table gives no rows; further columns are dropped.
    """
    holdout = fold("doc_id", parts) == held
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, holdout))  # a fixed size, 2**TABLE_BITS rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), holdout.alias("held_out"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
    return map_texts(texts, _labelled(model), schema)


def keep_identified(docs: DataFrame, least: float = 0.5, parts: int = 4, held: int = 2) -> DataFrame:
    """The rows of docs, with all columns, whose language is determined with a score of ``least`` at least.

    Rows pass through one by one, without a shuffle; texts that are null or have no letters go.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, fold("doc_id", parts) == held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            for part in slices(batch):
                found = crf.label(part.column("text").to_pylist())
                yield part.filter(pa.array([x[0] != UNDETERMINED and x[1] >= least for x in found]))

    return docs.mapInArrow(run, docs.schema)


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
