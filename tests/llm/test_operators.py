"""Each corpus operator against a brute-force version, on a small table with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common, exact, language, packing, passages, quality, sharding, simhash, suffixes, tokenizing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
WORDS = [f"w{i}" for i in range(900)]
EN, DE = "the cat and this dog with that house over there".split(), "der hund und die katze mit dem haus über straße".split()


def say(words, n):
    return " ".join(random.choice(words) for _ in range(n))


PASSAGE = say(WORDS, 120)
TEXTS = [
    None, "", " \n\t", "Ünïcode ÀÉ <|endoftext|> 漢字 🎉", "same Text here", "SAME text HERE", "same Text here", say(EN, 300), say(DE, 300),
    say(EN, 40) + " " + PASSAGE, PASSAGE + " " + say(DE, 60), "line one\nline one\nline one\n" + say(EN, 30), "#" * 50, "a" * 3000, say(WORDS, 5000),
    "spam ham eggs toast " * 40,
] + [say(EN if i % 2 else DE, 30 + i) + (" you idiot" if i % 4 == 0 else "") for i in range(40)]
ROWS = [(i, t, ("en", "de")[i % 2] if i >= 16 else None, "src", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None), (4, "same Text here", None, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(a, b, c if a is None or a < 16 else ("de", "en")[a % 2], d, e) for a, b, c, d, e in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({k: F.lit("clash") for k in ("score", "fp", "id", "row", "key", "size", "z", "kept", "shard", "component", "recipe")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact(docs, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_groups(docs).collect()}
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = Counter(norm(t) for _, t, *_ in ROWS)
    for i, t, *_ in ROWS:
        ids = [a for a, b, *_ in ROWS if norm(b) == norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        assert (i, keep, groups[norm(t)], i == keep, hashlib.sha256(norm(t).encode()).hexdigest()) in got
    kept = [r for r in exact.exact_groups(docs, key_bytes=1).collect() if r["kept"]]
    assert len(kept) == len(groups)
    assert exact.drop_exact_copies(docs).count() == len(groups)
    assert exact.exact_groups(none).count() == 0


@pytest.mark.parametrize("crowd", [1, 1024])
def test_suffixes(docs, none, crowd):
    length, data = 40, [(i, (t or "").encode()) for i, t, *_ in ROWS]
    seen = Counter(d[j : j + length] for _, d in data for j in range(len(d) - length + 1))
    want = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for j in range(len(d) - length + 1):
            if seen[d[j : j + length]] > 1:
                gone[j : j + length] = True
        want.append((str(i), len(d), len(suffixes.intervals(gone)), bytes(np.frombuffer(d, np.uint8)[~gone])))
    got = [(str(r["doc_id"]), r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in suffixes.remove_repeats(docs, length, crowd=crowd).collect()]
    assert Counter(got) == Counter(want)
    assert suffixes.remove_repeats(none).count() == 0


def test_whole_characters(spark):
    shared = "\u00a9" + "abcdefghij" * 4 + "\u00e3"  # c2 a9 ... c3 a3; é is c3 a9, è c3 a8
    texts = ["clean \ufffd text", None, "", f"one {shared[1:]} two \ufffd", f"\u00e9{shared[1:-1]}\u00e8 end", f"\u00e9{shared[1:-1]}\u00e9 tail"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    spans = {r["doc_id"]: (r["spans"], (texts[r["doc_id"]] or "").encode()) for r in suffixes.remove_repeats(docs, 30).collect()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in suffixes.without_repeats(docs, 30).collect()}
    assert got[0][0] == texts[0] and got[1][0] == got[2][0] == "" and "\ufffd" in got[3][0]
    for i, (removed, data) in spans.items():
        ends = [0, *(x for s in removed for x in (s["start"], s["end"])), len(data)]
        want = "".join(data[a:b].decode(errors="ignore") for a, b in zip(ends[::2], ends[1::2], strict=True))
        assert got[i] == (want, len(want))
    assert spans[4][0] and spans[5][0]
    # c3 | removed | a9: bytes on both sides of a removed run are no character
    pieces = [b"x\xc3", b"\xa9y"]
    assert suffixes._whole_characters(*([x] for x in (b"".join(pieces), [2], [40]))).tolist() == ["xy"]


def test_one_python_operator_a_task(docs):
    """Each Python operator of a task takes a worker process, so the last step of a stage has just one."""
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for out in (suffixes.without_repeats(d, 40), suffixes.remove_repeats(d, 40)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("ArrowEvalPython|MapInArrow", plan)) == 1, plan


def test_suffix_array():
    for n in range(60):
        for top in (1, 2, 200):
            s = np.array([random.randint(1, top) for _ in range(n)], np.int64)
            assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, *_ in ROWS if i is not None] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert toxicity.score_toxicity(none, labels.limit(0)).count() == 0
    clean = [say(EN, 60) for _ in range(400)]
    model = toxicity.train([x + " idiot" for x in clean[:100]], clean[:300] + [x + " idiot" for x in clean[300:340]], 0.12)
    assert model.score("the dog idiot") >= 0.5 > model.score("the dog")


def test_language(docs, none):
    rows = language.identify(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = dict((a, b) for a, b, *_ in ROWS).get(r["doc_id"])
        if r["doc_id"] is not None and r["doc_id"] >= 16:
            assert r["lang_pred"] == ("de", "en")[r["doc_id"] % 2]
        if r["doc_id"] in (0, 1, 2, 12):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0), text
    assert {r["doc_id"] for r in language.keep_identified(docs, 0.0).collect()}.isdisjoint({0, 1, 2, 12})
    assert language.identify(none).count() == 0
    crf = language.train([say(EN, 100), say(DE, 100)] * 5, ["en", "de"] * 5)
    best = crf.label(["the cat and this dog " * 3 + "der hund und die katze " * 3])[0][2].argmax(axis=1)
    assert best[:15].tolist() == [1] * 15 and best[15:].tolist() == [0] * 15


def test_tokenizer(docs, none):
    from tokenizers import Tokenizer

    path = tokenizing.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in tokenizing.encode_decode(docs, path).collect():
        text = next(t or "" for i, t, *_ in ROWS if i == r["doc_id"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"]) == (ids, len(ids))
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert tokenizing.encode_digests(none, path).count() == 0


def test_simhash(spark, docs, none):
    import xxhash

    def brute(text):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(ROWS)
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    assert all(prints[i] == brute(t) for i, t, *_ in ROWS)
    base = [random.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(3))) for b in base for _ in range(8)})
    parent = list(range(len(fps)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(i, f - (1 << 64) * (f >> 63)) for i, f in enumerate(fps)], "id long, fp long")
    for bucket in (1 << 14, 2):
        found = dict((r["id"], r["component"]) for r in common.connected_components(simhash.links(nodes, 2, bucket)).collect())
        assert [found.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]
    assert simhash.simhash_components(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.feistel_shards(docs, 7).collect()
    assert len(rows) == len(ROWS)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, sharding.feistel_shards(docs.repartition(3), 7).collect()))
    assert all(r["text_crc32"] == zlib.crc32((t or "").encode()) and r["size"] == len((t or "").encode()) + 16 for r in rows for i, t, *_ in ROWS if i == r["doc_id"])
    assert sharding.feistel_shards(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 64).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 64):
            part = ids[p : p + 64]
            want[i, p // 64, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.05 * sum(r["length"] for r in rows) / 64 + 1
    assert packing.pack_documents(none, path).count() == 0


def test_quality(docs, none):
    for r in quality.repetition_rules(docs).collect():
        t = next(t or "" for i, t, *_ in ROWS if i == r["doc_id"])
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        marked = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(marked))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(marked) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert quality.repetition_rules(none).count() == 0


def test_passages(docs, none):
    got = {r["doc_id"]: r for r in passages.passage_classes(docs).collect()}
    assert got[9]["class_id"] == got[10]["class_id"] == 9 and got[9]["n_dup_words"] >= 115
    assert got[8]["class_id"] == 8 and got[14]["class_id"] == 14 and got[0]["n_passages"] == 0
    assert passages.passage_classes(none).count() == 0


def near(x, y):
    x, y = passages.shingles(" ".join(x)), passages.shingles(" ".join(y))
    return any(passages.best_match(x, a, y, int(b)) for a in range(len(x)) for b in np.flatnonzero(y == x[a]))


@pytest.mark.parametrize(("n", "edits"), [(50, [25]), (60, [30]), (80, [40]), (100, [33, 66])])
def test_edited_passages(n, edits):
    words = [f"v{i}" for i in range(n)]
    y = list(words)
    for e in edits:
        y[e] = "changed"
    for around in (0, 150):
        pad = [[f"{k}{i}" for i in range(around)] for k in "abcd"]
        assert near(pad[0] + words + pad[1], pad[2] + y + pad[3])
    y[::12] = ["changed"] * len(y[::12])
    assert not near(words, y)
    moved = words[n // 2 :] + words[: n // 2]
    assert near(words, moved)


@pytest.mark.parametrize(("n", "later"), [(60, 26), (60, 75), (200, 100)])
def test_passage_with_a_stray_phrase(n, later):
    words = [f"v{i}" for i in range(n)]
    y = words + [f"z{i}" for i in range(later)] + words[20:25] + [f"y{i}" for i in range(200)]
    x, y = passages.shingles(" ".join(words)), passages.shingles(" ".join(y))
    first, last, low, high = passages.best_match(x, 10, y, 10)
    assert (first, low) == (0, 0) and last == len(x) - 1 and high >= last


@pytest.mark.parametrize("leads", [1, 32])
def test_passages_not_like_the_first(spark, leads):
    phrase = say([f"p{i}" for i in range(99)], 30)
    words = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    # 30 words that all share, in 20 more words that three sets of documents share and other documents do not
    texts = [f"{words(f'a{i}', 60)} {phrase} {words(f'b{i}', 60)}" for i in range(12)]
    texts += [f"{words(f'c{k}{i}', 60)} {words(f'd{k}', 10)} {phrase} {words(f'e{k}', 10)} {words(f'f{k}{i}', 60)}" for k in range(3) for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = passages.matches(docs, leads)
    edges = {(r[0], r[1]) for r in found.select("doc_id", "other_id").collect()}
    got = {i: i for i in range(len(texts))}
    for _ in texts:
        for a, b in edges:
            got[a] = got[b] = min(got[a], got[b])
    assert [got[i] for i in range(len(texts))] == [*range(12), *[12] * 4, *[16] * 4, *[20] * 4]


def test_passages_like_one_that_is_done_with(spark):
    """x is like all first texts and like z, which is like x alone: each family is one class, by that link."""
    texts = []
    for f in range(6):
        base = [f"b{f}x{i}" for i in range(50)]
        edited = lambda at: [f"e{f}x{at}" if i == at else w for i, w in enumerate(base)]  # noqa: E731, B023
        family = [*map(edited, (6, 10, 14, 18, 22, 26)), base, edited(40)]
        for k, words in enumerate(family):
            texts.append(" ".join([f"p{f}x{k}x{i}" for i in range(60)] + words + [f"q{f}x{k}x{i}" for i in range(60)]))
        assert [near(x, family[-1]) for x in family[:-1]] == [False] * 6 + [True]
    rows = passages.passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert [got[i] for i in range(len(texts))] == [i // 8 * 8 for i in range(len(texts))]


def test_copies_and_repeated_ids(spark):
    """Copies are compared as one text and counted; a link goes to each copy of the other text."""
    p, words = say(WORDS, 60), lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, alone = f"{words('a', 60)} {p} {words('c', 60)}", f"{words('d', 60)} {p} {words('e', 60)}", words("f", 70)
    texts = [(3, a), (1, a), (2, b), (5, alone), (5, alone), (6, alone), (7, "short " * 49), (8, "short " * 49), (None, a)]
    rows = passages.passage_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in rows}
    assert got == {(3, 1, 2), (1, 1, 2), (2, 1, 2), (5, 5, 1), (6, 5, 1), (7, 7, 0), (8, 8, 0), (None, None, 0)}
    assert len(rows) == len(texts) and next(r["n_dup_words"] for r in rows if r["doc_id"] == 6) == 70


def test_windows_of_one_kind_meet_others_once(spark, monkeypatch):
    """Of a line that texts repeat over and over, whose windows are settled, few go on; what differs still meets one of them."""
    texts = [" ".join([f"a{i}x{j}" for j in range(60)] + ["is", "onhe"] * 300 + [f"b{i}x{j}" for j in range(60)]) for i in range(8)]
    pair = [" ".join([f"c{i}x{j}" for j in range(60)] + ["is", "onhe"] * 9 + [f"d{j}" for j in range(60)]) for i in range(2)]
    taken = []
    mixed = passages.mixed
    monkeypatch.setattr(passages, "mixed", lambda windows: taken.append(windows.count()) or mixed(windows))
    rows = passages.passage_classes(spark.createDataFrame(list(enumerate(texts + pair)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {**dict.fromkeys(range(8), 0), 8: 8, 9: 8}
    assert taken[1] < taken[0] / 2, taken


def test_passage_within_a_document(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    texts = [f"{words('a', 50)} {words('p', 60)} {words('b', 90)} {words('p', 60)} {words('c', 50)}", words("q", 200), " ".join(["r1 r2 r3 r4 r5 r6"] * 5)]
    rows = passages.passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_passages"]) for r in rows}
    assert got == {0: (0, 0, 2), 1: (1, 0, 0), 2: (2, 0, 0)}
    assert 120 <= next(r["n_dup_words"] for r in rows if r["doc_id"] == 0) <= 150


@pytest.mark.parametrize("n", [50, 60, 100, 200])
def test_passage_recall(n):
    """Pairs of passages of similarity 0.8 or a little more, by brute force, in other surroundings: all are found."""
    rng, texts, pairs = random.Random(n), [], 0
    words = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    while pairs < 100:
        x = words(rng.randrange(n, n + 10))
        y = list(x)
        for _ in range(rng.randrange(1, n // 40 + 2)):
            e = rng.randrange(len(y))
            y[e : e + rng.randrange(2)] = words(rng.randrange(2))
        one, other = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (x, y))
        if len(y) >= 50 and 0.8 <= len(one & other) / len(one | other) < 0.88:
            texts += [" ".join(words(80) + t + words(80)) for t in (x, y)]
            pairs += 1
    ids = list(range(len(texts)))
    rows = passages._windows()({"text": texts, "k1": ids, "k2": ids})
    at = {}
    for k, key, place, reach in zip(*(np.asarray(rows[c]).tolist() for c in ("k1", "key", "at", "reach")), strict=True):
        at.setdefault(k, {}).setdefault(key, []).append((place, *divmod(reach, passages.RUN)))
    hashed = [passages.shingles(t) for t in texts]
    for i in ids[::2]:
        places = [(a, b) for key in at[i].keys() & at[i + 1].keys() for a in at[i][key] for b in at[i + 1][key]]
        joined = [(a[0], b[0]) for a, b in places if min(a[1], b[1]) + min(a[2], b[2]) >= passages.RUN - 1]
        assert any(passages.best_match(hashed[i], a, hashed[i + 1], b) for a, b in joined), i


def test_surroundings():
    """Windows with passages alike share as many other shingles as is said, or all of them 0."""
    rng = random.Random(3)
    for _ in range(60):
        x = [f"w{rng.randrange(rng.choice((3, 30, 10**6)))}" for _ in range(150)]
        y = list(x)
        y[rng.randrange(150)] = "changed"
        hx, hy = passages.shingles(" ".join(x)), passages.shingles(" ".join(y))
        names, till = passages.tokens(hx, np.array([len(hx)]), np.array([0]))
        others, _ = passages.tokens(hy, np.array([len(hy)]), np.array([0]))
        for a in range(0, int(till[0]), 7):
            for b in np.flatnonzero(others[: int(till[0])] == names[a])[:2]:
                if passages.best_match(hx, a, hy, int(b)):
                    (m, one), (n, other) = passages.surroundings(hx, a), passages.surroundings(hy, int(b))
                    assert len(np.intersect1d(one, other)) >= min(m, n)


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(1, 50))
        v = rng.integers(0, 2**63, n, dtype=np.uint64)
        seen = {}
        for a, b, d in zip(*passages.compact_windows(v, np.array([0]), np.array([n]), 5), strict=True):
            for i in range(a, b + 1):
                for j in range(max(b, i + 4), d + 1):
                    assert (i, j) not in seen
                    seen[i, j] = b
        assert all(seen[i, j] == i + v[i : j + 1].argmin() for i in range(n) for j in range(i + 4, n))


def test_pipeline(docs, spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = d.count()
        d = common.materialize(stage(spark, d, ""), "test")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < d.count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() >= d.count()


def test_exact_matches_sql(spark):
    from ..oracle import connect, same

    sf = "/root/testdata/sf0.01"
    same(exact.op5_chunk_recipes(spark, sf), connect(sf), exact.ORACLE)


def test_pairs_that_may_match():
    """No pair of windows with passages alike goes by the shingles around them, in texts that repeat themselves too."""
    rng, seen = random.Random(5), Counter()
    for _ in range(200):
        few = rng.choice((6, 20, 60, 10**6))
        x = [f"w{rng.randrange(few)}" for _ in range(rng.randrange(50, 200))]
        y = list(x)
        for _ in range(rng.randrange(1, 16)):
            e = rng.randrange(len(y))
            y[e : e + rng.randrange(3)] = [f"c{rng.randrange(9)}"] * rng.randrange(3)
        x, y = passages.shingles(" ".join(x)), passages.shingles(" ".join(y))
        for a in range(0, len(x), 11):
            for b in np.flatnonzero(y == x[a])[:3].tolist():
                around = np.stack([passages.short_hashes(x, a), passages.short_hashes(y, b)])
                may, does = bool(passages.may_match(around, np.array([0]), np.array([1]))[0]), bool(passages.best_match(x, a, y, b))
                assert may or not does
                seen[may, does] += 1
    assert seen[True, True] > 300 and seen[False, False] > 300, seen


def test_near_copies_meet_few(spark, monkeypatch):
    """Of near copies, and of texts that share a phrase, not each pair of windows is verified; classes are those of all pairs."""
    rng, base, texts = random.Random(8), [f"b{i}" for i in range(130)], []
    for i in range(48):
        y = [w if rng.random() > 0.07 else f"e{i}x{j}" for j, w in enumerate(base)]
        texts.append(" ".join([f"p{i}x{j}" for j in range(9)] + y))
    phrase = [f"c{i}" for i in range(40)]
    texts += [" ".join([f"q{i}x{j}" for j in range(60)] + phrase + [f"r{i}x{j}" for j in range(60)]) for i in range(48)]
    hashed, want = [passages.shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(hashed):
        for j, y in enumerate(hashed[:i]):
            if want[i] != want[j] and any(passages.best_match(x, a, y, int(b)) for a in np.flatnonzero(np.isin(x, y)) for b in np.flatnonzero(y == x[a])):
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    counts, tried = [], passages.tried
    monkeypatch.setattr(passages, "tried", lambda pairs, pressed: counts.append(pairs.count()) or tried(pairs, pressed))
    rows = passages.passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["class_id"] for r in sorted(rows)] == want
    assert sum(counts[1:]) <= counts[0], counts
