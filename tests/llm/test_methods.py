"""What lies inside the operators, against plain versions of it: gradients, marginals, permutations, shares, stages."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language, packing, quality, sharding, simhash, suffixes, tokenizing, toxicity

from .test_operators import DE, EN, PASSAGE, WORD, WORDS, docs, none, say  # noqa: F401 - fixtures


def test_risk_gradient():
    """The gradient of the non-negative risk against finite differences, on either side of zero."""
    rng = np.random.default_rng(1)
    xp, xu = (rng.integers(0, 2, (n, 6)).astype(np.float32) for n in (40, 90))
    seen = set()
    for scale in (0.1, 3.0):
        for prior in (0.1, 0.5):
            theta = rng.normal(0, scale, 7)

            def parts(t, p=prior):
                fp, fu = xp @ t[:-1] + t[-1], xu @ t[:-1] + t[-1]
                return p * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - p * np.logaddexp(0, fp).mean()

            slope, positive = toxicity.slope_at(theta, xp, xu, prior)
            assert positive == (parts(theta)[1] >= 0)
            seen.add(positive)
            for i in range(7):
                step = np.zeros(7)
                step[i] = 1e-4
                up, down = parts(theta + step), parts(theta - step)
                want = (sum(up) - sum(down)) / 2e-4 if positive else -(up[1] - down[1]) / 2e-4
                assert slope[i] == pytest.approx(want, abs=2e-3)
            fp, fu = xp @ theta[:-1] + theta[-1], xu @ theta[:-1] + theta[-1]
            assert toxicity.risk(fp, fu, prior) == pytest.approx(parts(theta)[0] + max(0, parts(theta)[1]))
    theta = np.zeros(7)
    theta[-1] = 8.0  # all called toxic: the clean part is not negative; all called clean with a large prior may be
    assert toxicity.slope_at(theta, xp, xu[:1] * 0, 0.5)[1]
    theta = np.append(np.full(6, 5.0), -8.0)
    assert not toxicity.slope_at(theta, np.ones((4, 6), np.float32), np.zeros((9, 6), np.float32), 0.5)[1]


@pytest.mark.parametrize("lengths", [[1], [2, 5], [7, 1, 3]])
def test_marginals(lengths):
    """Forward-backward against all label paths."""
    rng = np.random.default_rng(len(lengths))
    k = 3
    crf = language.Crf(list("abc"), np.zeros((4, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    emissions = rng.normal(0, 2, (sum(lengths), k))
    got, at = crf.marginals(emissions, np.array(lengths)), 0
    for n in lengths:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            score = crf.start[path[0]] + sum(emissions[at + i, y] for i, y in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:]))
            for i, y in enumerate(path):
                want[i, y] += np.exp(score)
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_long_marginals():
    """Texts of several blocks are as if they were one."""
    rng = np.random.default_rng(9)
    crf = language.Crf(list("ab"), np.zeros((4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    n = 3 * language.BLOCK + 5
    emissions = rng.normal(size=(n, 2))
    move, score = np.exp(crf.move), np.exp(emissions)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    forward[0] = np.exp(crf.start) * score[0]
    for t in range(1, n):
        forward[t] = forward[t - 1] @ move * score[t]
        forward[t] /= forward[t].sum()
    for t in range(n - 2, -1, -1):
        backward[t] = move @ (score[t + 1] * backward[t + 1])
        backward[t] /= backward[t].sum()
    want = forward * backward
    assert np.allclose(crf.marginals(emissions, np.array([n])), want / want.sum(axis=1, keepdims=True))


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_feistel(spark, n):
    """The permutation with cycle walking against plain integers; it takes every number once."""
    a, b = sharding.halves(n)

    def once(x):
        left, right = divmod(x, b)
        for i, (k0, k1, k2) in enumerate(sharding.round_keys(5)):
            value, size = (right, a) if i % 2 == 0 else (left, b)
            t = (value % sharding.PRIME * k0 + k1) % sharding.PRIME
            moved = ((t * t + k2) % sharding.PRIME * k0 + t) % sharding.PRIME % size
            left, right = ((left + moved) % a, right) if i % 2 == 0 else (left, (right + moved) % b)
        return left * b + right

    def walked(x):
        x = once(x)
        while x >= n:
            x = once(x)
        return x

    got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.walk(F.col("id"), n, 64, 5)).collect()]
    assert got == [walked(x) for x in range(n)] and sorted(got) == list(range(n))


def test_repetition_shares(docs):  # noqa: F811
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()}
    for r in quality.repetition_rules(docs).collect():
        words = WORD.findall(texts.get(r["doc_id"]) or "") if r["doc_id"] is not None else ["no", "id"]
        lines = [x for x in (texts.get(r["doc_id"]) or "").split("\n") if WORD.search(x)]
        total = sum(map(len, lines))
        line_share = sum(map(len, lines)) - sum(map(len, set(lines)))
        line_share = line_share / total if total and len(lines) > len(set(lines)) else 0.0
        shares = {}
        for n in quality.NGRAM_LIMITS:
            seen, marked = set(), set()
            for i in range(len(words) - n + 1):
                gram = tuple(words[i : i + n])
                if gram in seen:
                    marked.update(range(i, i + n))
                seen.add(gram)
            shares[n] = sum(len(words[i]) for i in marked) / max(1, sum(map(len, words)))
        assert r["dup_line_share"] == pytest.approx(line_share)
        assert r["dup_ngram_share"] == pytest.approx(max(shares.values()))
        failed = line_share > quality.LINE_CHAR_LIMIT or any(shares[n] > limit for n, limit in quality.NGRAM_LIMITS.items())
        assert r["kept"] == (not (r["base_failed"] or failed))


def test_pipeline_against_brute_force(spark):
    rows = [(i, say(EN if i % 2 else DE, 60 + i), ("de", "en")[i % 2], "s", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[3][1].upper(), "en", "s", 0), (102, None, None, None, None), (103, " \n", "en", "s", 0), (104, "", None, "s", 0)]
    base = say(EN, 400)
    rows += [(110, base, "en", "s", 0), (111, base + " end", "en", "s", 0), (111, base + " other", "en", "s", 0)]
    rows += [(120, say(EN, 50) + " " + PASSAGE + " " + say(EN, 50), "en", "s", 0), (121, say(DE, 60) + " " + PASSAGE, "de", "s", 0)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        out = stages[name](spark, now, "")
        return out, [(r["doc_id"], r["text"]) for r in out.collect()]

    before = [(r[0], r[1]) for r in rows]
    now, after = run("language ID")
    assert Counter(after) == Counter(x for x in before if x[0] not in (102, 103, 104))  # no letters; all others are clean
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = {}
    for i, t in after:
        want[norm(t)] = max(want.get(norm(t), (-1, "")), (i, t))
    now, after = run("exact dedup")
    assert Counter(after) == Counter(want.values())
    prints = [simhash.fingerprint(t) for _, t in after]
    parent = list(range(len(after)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(after)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    groups = {}
    for i, x in enumerate(after):
        groups.setdefault(root(i), []).append(x[0])
    now, after = run("SimHash near-dedup")
    assert Counter(i for i, _ in after) == Counter(min(g) for g in groups.values())
    length = suffixes.PASSAGE_BYTES
    data = [(i, t.encode()) for i, t in after]
    seen = Counter(d[j : j + length] for _, d in data for j in range(len(d) - length + 1))
    want = Counter()
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for j in range(len(d) - length + 1):
            if seen[d[j : j + length]] > 1:
                gone[j : j + length] = True
        want[i, bytes(np.frombuffer(d, np.uint8)[~gone]).decode(errors="ignore")] += 1
    now, after = run("suffix-array dedup")
    assert Counter(after) == want
    texts = dict(after)
    assert PASSAGE not in texts[120] and PASSAGE not in texts[121] and len(texts[120]) > 200
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizing.tokenizer_path("word_bpe_49k.json"))
    packed = stages["best-fit packing"](spark, now, "").collect()
    assert Counter((r["doc_id"], r["length"]) for r in packed) == Counter((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in after)


def test_pipeline_of_nothing(spark):
    now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_full_pieces_have_sequences_of_their_own(spark):
    rows = [(i, 0, 0, 8 if i % 3 else i % 7 + 1, i) for i in range(300)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    places = {}
    for r in packing.pack(cut, 8).collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, places.values())) == 300
    for x in places.values():
        assert [o for o, _ in sorted(x)] == list(itertools.accumulate([0] + [n for _, n in sorted(x)][:-1])) and sum(n for _, n in x) <= 8


def test_one_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "x y z u v w"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([1, 1, None, 3])  # two texts under 1, one each
    assert len({r["text"] for r in got if r["doc_id"] == 1}) == 2


def test_removed_bytes_are_digested(spark):
    shared = " ".join(WORDS[:150])
    df = spark.createDataFrame([(1, "one " + shared), (2, shared + " two"), (3, "three")], "doc_id long, text string")
    got = {r["doc_id"]: hashlib.sha256(bytes(r["kept"])).hexdigest() for r in suffixes.remove_repeats(df, 400).collect()}
    assert got[1] == hashlib.sha256(b"one ").hexdigest() and got[3] == hashlib.sha256(b"three").hexdigest()
    assert re.fullmatch(r"[0-9a-f]{64}", got[2])
