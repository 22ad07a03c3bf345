"""Byte-level BPE by depth-first traversal of a trie of distinct words, and back."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read_table

#: Entries of a task's word caches; a full cache keeps the words of the batch at hand, so
#: memory is bounded; results do not depend on it.
CACHE_WORDS = 600_000
#: Known token pairs of a task before a new batch starts anew.
STABLE_PAIRS = 1_000_000
#: Bytes of text whose new words share a trie.
BATCH_BYTES = 4 << 20
INF = float("inf")
#: White space as the tokenizers library's patterns see it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A run that the word pattern never looks across: white space, or other text with one space before.
UNITS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The byte-level pre-tokenizer's published pattern (fixed value).
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """BPE of many words at once.

    The last token of a prefix's encoding determines that encoding: without it, the prefix that is
    left is encoded on its own.  So each trie node holds one last token.  It is the token that ends
    there, starts at an ancestor, and is stable beside the ancestor's last token: BPE of their two
    strings gives just these two.  Nodes are visited depth first, every shared prefix once.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.id_of = {raw: i for i, raw in self.bytes_of.items()}
        self.ranks: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}  # token: its merge's rank and sides
        vocab = spec["model"]["vocab"]
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[a], vocab[b]
            self.ranks[pair] = rank
            parts.setdefault(vocab[a + b], (rank, *pair))
        # pieces that stand at a token's end (start) while it is being merged, and the rank that ends each
        self.right_edge: dict[int, list[tuple[int, float]]] = {}
        self.left_edge: dict[int, list[tuple[int, float]]] = {}
        live = set()
        for i in sorted(self.bytes_of, key=lambda i: parts[i][0] if i in parts else -1):
            rank, a, b = parts.get(i, (-1, None, None))
            if a is None:
                self.right_edge[i] = self.left_edge[i] = [(i, INF)]
                if len(self.bytes_of[i]) == 1:
                    live.add(i)
                continue
            if a in live and b in live and not self._crossed(a, b, rank):
                live.add(i)
            self.right_edge[i] = [(i, INF), *((x, rank if end == INF else end) for x, end in self.right_edge[b])]
            self.left_edge[i] = [(i, INF), *((x, rank if end == INF else end) for x, end in self.left_edge[a])]
        self._automaton({self.bytes_of[i]: i for i in live})
        self.decoded = self.bytes_of | {i: c.encode() for c, i in self.added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.stable: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _crossed(self, left: int, right: int, before: float = INF) -> bool:
        """Whether a merge across the border of two tokens comes before their own merges, and ``before``.

        Of equal ranks the leftmost pair merges first, so a tie on the right side goes to the border.
        """
        ranks = self.ranks
        for x, x_end in self.right_edge[left]:
            for y, y_end in self.left_edge[right]:
                rank = ranks.get((x, y))
                if rank is not None and rank < x_end and rank <= y_end and rank < before:
                    return True
        return False

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """States for the longest suffix that starts a token, with the tokens that end in each."""
        self.goto: dict[int, int] = {}
        own: list[int | None] = [None]
        for raw, i in tokens.items():
            at = 0
            for byte in raw:
                key = at << 8 | byte
                nxt = self.goto.get(key)
                if nxt is None:
                    nxt = self.goto[key] = len(own)
                    own.append(None)
                at = nxt
            own[at] = i
        edges: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, to in self.goto.items():
            edges[key >> 8].append((key & 255, to))
        self.fail = [0] * len(own)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        queue = [0]
        for at in queue:
            for byte, to in edges[at]:
                if at:
                    self.fail[to] = self._next(self.fail[at], byte)
                mine = () if own[to] is None else ((own[to], len(self.bytes_of[own[to]])),)
                self.ending[to] = mine + self.ending[self.fail[to]]
                queue.append(to)

    def _next(self, at: int, byte: int) -> int:
        while True:
            to = self.goto.get(at << 8 | byte)
            if to is not None or at == 0:
                return to or 0
            at = self.fail[at]

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Encodings of distinct byte strings.

        Sorted words are a depth-first walk of their trie: the stacks hold the path, and a word
        re-uses the nodes that it shares with the one before.
        """
        ending, stable, goto, following = self.ending, self.stable, self.goto, self._next
        if len(stable) > STABLE_PAIRS:
            stable.clear()
        out: dict[bytes, list[int]] = {}
        before = b""
        tokens, sizes, path = [-1], [0], [0]  # of each prefix: last token, its length, automaton state
        for word in sorted(words):
            common = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                common += 1
            del tokens[common + 1 :], sizes[common + 1 :], path[common + 1 :]
            state = path[common]
            for end in range(common + 1, len(word) + 1):
                byte = word[end - 1]
                to = goto.get(state << 8 | byte)
                state = following(state, byte) if to is None else to
                for token, size in ending[state]:
                    left = tokens[end - size]
                    if left < 0:
                        break
                    key = left << 32 | token
                    fits = stable.get(key)
                    if fits is None:
                        fits = stable[key] = not self._crossed(left, token)
                    if fits:
                        break
                tokens.append(token)
                sizes.append(size)
                path.append(state)
            ids, at = [], len(word)
            while at:
                ids.append(tokens[at])
                at -= sizes[at]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def _learn(self, units: set[str]) -> None:
        """Fill the caches for units that they lack."""
        if len(self.words) >= CACHE_WORDS:
            self.words = {}
        known, found = self.words, self.units
        parts = {u: WORDS.findall(u) for u in units if not (u[1:] if u[0] == " " else u).isalpha()}  # letters are one word
        new = {w for p in parts.values() for w in p if w not in known}
        text = {w.encode(): w for w in new}
        alone = {u.encode(): u for u in units if u not in parts}
        for raw, ids in self.encode_words({*text, *alone}).items():
            packed = array("I", ids).tobytes()
            if raw in text:
                known[text[raw]] = packed
            if raw in alone:
                found[alone[raw]] = packed
        for u, p in parts.items():
            found[u] = b"".join([known[w] for w in p])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        runs: list[list] = []
        for text in texts:
            at, run = 0, []
            for m in self.special.finditer(text) if self.special and "<|" in text else ():
                run.append(UNITS.findall(text[at : m.start()]))
                run.append(self.added[m[0]].to_bytes(4, "little"))
                at = m.end()
            run.append(UNITS.findall(text[at:] if at else text))
            runs.append(run)
        need = {u for run in runs for x in run if type(x) is list for u in x}
        missing = need.difference(self.units)
        if missing:
            if len(self.units) + len(missing) > CACHE_WORDS:  # keep what this batch uses
                self.units = {u: self.units[u] for u in need if u in self.units}
            self._learn(missing)
        code = self.units.__getitem__
        return [b"".join([x if type(x) is bytes else b"".join(map(code, x)) for x in run]) for run in runs]

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I")
        return b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> TrieEncoder:
    """One encoder in each Python worker, which serves its later tasks too."""
    return TrieEncoder(path)


def _encoder(path: str) -> Callable[[], Callable[[dict], dict]]:
    def make() -> Callable[[dict], dict]:
        encoder = encoder_of(path)

        def step(rows: dict) -> dict:
            packed = encoder.encode_all([x or "" for x in rows["text"]])
            return {"doc_id": rows["doc_id"], "n_tokens": [len(x) // 4 for x in packed], "ids": packed, "decoded": list(map(encoder.decode, packed))}

        return step

    return make


def _digests(path: str) -> Callable[[], Callable[[dict], dict]]:
    make = _encoder(path)

    def digest() -> Callable[[dict], dict]:
        inner = make()

        def step(rows: dict) -> dict:
            out = inner(rows)
            return {
                "doc_id": out["doc_id"], "n_tokens": out["n_tokens"],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in out["ids"]],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in out["decoded"]],
            }

        return step

    return digest


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document; ids are packed little-endian uint32.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, the same on every
    machine.  Texts are cut into words; the distinct new words of a run of documents go into a trie
    whose traversal encodes every shared prefix once.  One pass, no shuffle; caches are bounded.
    Added tokens' strings inside a text become those tokens, as in the library.  Null and empty texts
    give no ids; repeated rows are encoded alike; an empty table gives no rows; null ids stay;
    further columns are dropped; long texts are taken whole.
    """
    return map_texts(_texts(docs), _encoder(tokenizer), "doc_id long, n_tokens long, ids binary, decoded string", BATCH_BYTES)


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """encode_decode() with SHA-256 digests in place of ids and text; the same rules hold."""
    return map_texts(_texts(docs), _digests(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", BATCH_BYTES)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
