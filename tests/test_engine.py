import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import embedding, graph, history, markdown, search
from tessera.plans.queries import WORKSPACE, workspace
from tessera.plans.sql import run_sql
from tessera.sources import workspace as W


def test_heading_tree_and_fences():
    text = WORKSPACE["notes/a.md"]
    rows = markdown.headings(text)
    assert [(h["heading_path"], h["level"]) for h in rows] == [("Alpha", 1), ("One", 2), ("One/Deep", 3), ("Two", 2)]
    data = text.encode()
    assert data[rows[1]["byte_start"] : rows[1]["byte_end"]].decode().startswith("## One ##\n")
    assert rows[1]["byte_end"] == rows[3]["byte_start"]
    assert markdown.headings("~~~\n# a\n```\n# b\n")  == []


def test_links_skip_code_and_external():
    found = markdown.links(WORKSPACE["notes/a.md"])
    assert [(x["target"], x["anchor"], x["kind"], x["alias"]) for x in found] == [("b", "Two", "wiki", "bee"), ("../c.md", None, "md", "c")]


def test_front_matter_round_trip():
    values, n = markdown.front_matter(WORKSPACE["notes/a.md"].split("\n"))
    assert values == {"title": "Alpha", "tags": ["x", "y, z"], "about": "first"} and n == 5
    text = markdown.render_front_matter({"a": True, "b": 3, "c": 'x: "y"', "d": ["p", "q"]})
    assert markdown.front_matter(text.split("\n"))[0] == {"a": True, "b": 3, "c": 'x: "y"', "d": ["p", "q"]}
    assert markdown.front_matter(["---", "a: 1"]) == ({}, 0)
    assert markdown.ensure_front_matter("x", {"k": "v"}) == "---\nk: v\n---\nx"


@pytest.mark.parametrize("sizes", [(10, 10, 10), (150, 1300, 20), (700, 700, 100), (5, 1195, 1)])
def test_chunk_extents(sizes):
    text = "# T\n" + "".join(f"\n## S{i}\n\n" + "wörd " * (n // 5) + "\n\n" + "para " * (n // 5) + "\n" for i, n in enumerate(sizes))
    data = text.encode()
    for c in markdown.chunks(text, markdown.headings(text)):
        assert 0 <= c["byte_start"] <= c["byte_end"] <= len(data)
        assert 1 <= c["line_start"] <= c["line_end"] <= text.count("\n") + 1


def test_small_neighbours_merge_but_not_across_parents():
    text = "## A\nx\n## B\ny\n### C\nz\n"
    assert [(c["heading_path"], c["text"]) for c in markdown.chunks(text, markdown.headings(text))] == [("A", "x\n\ny"), ("B/C", "z")]


def test_sections(spark):
    parsed = markdown.parse(workspace(spark)).cache()
    found = {r["path"]: (r["n"], r["lines"]) for r in markdown.resolve(parsed, "two").collect()}
    assert found["notes/a.md"][0] == 1 and found["notes/b.md"] == (2, [2, 4])
    got = markdown.section_text(workspace(spark), parsed, "One/Deep").collect()
    assert [r["text"] for r in got] == ["### Deep\n\n`[[no]]` text\n\n"]
    section = markdown.headings(WORKSPACE["notes/b.md"])[1]
    assert markdown.replace_section(WORKSPACE["notes/b.md"], section, "new") == "# Bee\n## Two\n\nnew\n\n## Two\nagain [[a]] [[nowhere]]\n"
    assert markdown.duplicate_headings(parsed).count() == 1
    parsed.unpersist()


def test_link_resolution_order(spark):
    files = spark.createDataFrame([("x/a.md", []), ("a.md", ["Al"]), ("y/only.md", []), ("p/two.md", []), ("q/two.md", [])], "path string, aliases array<string>")
    edges = spark.createDataFrame([("x/s.md", "a", 1), ("s.md", "a", 2), ("s.md", "only", 3), ("s.md", "two", 4), ("s.md", "Al", 5), ("a.md", "a.md", 6)], "src string, target string, line int")
    got = graph.resolve_links(edges, files)
    assert [r["target_path"] for r in got.orderBy("line").collect()] == ["x/a.md", "a.md", "y/only.md", None, "a.md", "a.md"]
    assert {r["path"] for r in graph.orphans(files, got).collect()} == {"p/two.md", "q/two.md"}
    assert [r["src"] for r in graph.backlinks(got, "a.md").collect()] == ["s.md", "s.md"]
    assert graph.rewrite_links("see [[a|A]] and [[a]]", [(1, "[[a]]")], "b.md") == "see [[a|A]] and [[b]]"


def test_bm25_against_fts5(spark):
    texts = ["the cat sat on the mat", "Éclair foo_bar baz foo bar", "the the the dog", "cat foo bar cat", "", "the dog and the foo bar"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for query in ("cat", "the", "foo_bar", "the dog", "eclair", "the_the", "foo_bar_cat"):
        match = " ".join(f'"{w}"' for w in query.split())
        want = sorted((i, round(s, 6)) for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)))
        got = sorted((r["doc_id"], r["score"]) for r in search.bm25(docs, query).collect())
        assert [x[0] for x in got] == [x[0] for x in want], query
        assert [x[1] for x in got] == pytest.approx([x[1] for x in want], abs=2e-6), query


def test_grep_looks_at_lines(spark):
    docs = spark.createDataFrame([(1, "abc\nxyz"), (2, "no"), (3, None)], "doc_id long, text string")
    for pattern in ("xyz", r"(?<!\s)xyz", r"\Axyz", "^xyz$", r"xyz\Z", r"\bxyz\b"):
        assert [(r[0], r[1]) for r in search.grep(docs, pattern).collect()] == [(1, 2)], pattern
    assert search.capped(search.grep(docs, "."), 1)[1] is True
    assert [r["line"] for r in search.grep(docs, "xyz", context=1).orderBy("line").collect()] == [1, 2]


def test_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r[0], r[1]) for r in search.cosine(rows, [1.0, 0.0], 4).collect()] == [(0, 1.0), (3, 1.0), (1, -1.0), (2, -1.0)]
    assert search.cosine(rows, [0.0, 0.0], 4).count() == 0


def test_history(spark):
    v = spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (3, "p", "b"), (4, "p", "a"), (5, "q", "a")], "seq long, path string, sha string")
    assert [r["seq"] for r in history.consecutive_dedupe(v).orderBy("seq").collect()] == [1, 3, 4, 5]
    assert {r["seq"] for r in history.keep_last(v, 1).collect()} == {4, 5}
    assert history.restore_target(v, "p", "b") == "b"
    with pytest.raises(LookupError):
        history.restore_target(v, "p", "")
    fresh = spark.createDataFrame([(6, "p", "a"), (7, "q", "c")], v.schema)
    assert history.snapshot(v, fresh).count() == 6


def test_embedding_cache(spark):
    chunks = spark.createDataFrame([("s1", "x"), ("s1", "x"), ("s2", "y")], "embed_sha string, input string")
    none = spark.createDataFrame([], "embed_sha string, model string, dim int, vec array<float>")
    got = embedding.embed(chunks, none, dim=16)
    assert got.count() == 2 and embedding.embed(chunks, got, dim=16).count() == 0
    vec = embedding.hash_vector("x", 16)
    assert sum(x * x for x in vec) == pytest.approx(1, abs=1e-5)


def test_scalars(spark):
    row = spark.sql("select 'Naïve  *Café*_Bar! [[x]]' s, 1536L n, array('a','b') t, 'x/y/z.md' p")
    got = row.select(T.slug("s"), T.human_size("n"), T.has_tags("t", ["a"]), T.edit_tags("t", ["c"], ["a"]), T.path_parts("p", 1), T.kind("p")).first()
    assert list(got) == [T.slug_text("Naïve  *Café*_Bar! [[x]]"), "1.5k", True, ["b", "c"], "x/", "md"]
    import re

    for glob, path, want in (("**/x.md", "x.md", True), ("**/x.md", "a/b/x.md", True), ("a/**", "a/b/c", True), ("a/**", "b", False), ("*.md", "a/b.md", True), ("[!a].md", "b.md", True)):
        assert bool(re.match(T.glob_regex(glob), path)) == want
    text = spark.sql("select ' \n one \n\n two\nthree' t").select(T.excerpt("t"), F.array_join(T.lines("t", 2, 3), "|")).first()
    assert list(text) == ["one two", " one |"]


def test_workspace_catalog_and_sql(spark, tmp_path):
    for path, text in WORKSPACE.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    assert {r["path"] for r in W.walk(spark, str(tmp_path)).collect()} == set(WORKSPACE)
    assert {r["path"]: r["text"] for r in W.read_documents(spark, str(tmp_path)).collect()} == WORKSPACE
    stored = W.blobs(workspace(spark))
    assert {r["text"] for r in W.blob_texts(stored).collect()} == set(WORKSPACE.values())
    rows = spark.range(150)
    rows.createOrReplaceTempView("r150")
    result = run_sql(spark, "SELECT id FROM r150 ORDER BY id")
    assert len(result.rows) == 100 and result.total == 150
    assert run_sql(spark, "SELECT id FROM r150 LIMIT 3").total is None
    with pytest.raises(ValueError):
        W.normalise("/w", "../x")
    assert W.normalise("/w", "a/../b.md") == "b.md"


def test_doctor(spark):
    parsed = markdown.parse(workspace(spark))
    edges = graph.resolve_links(markdown.link_rows(parsed), parsed.select("path", F.array("title").alias("aliases")))
    chunks = markdown.chunk_rows(parsed)
    vectors = spark.createDataFrame([("gone", [1.0])], "embed_sha string, vec array<float>")
    got = {(r["category"], r["item"]) for r in graph.doctor(parsed, edges, markdown.heading_rows(parsed), chunks, vectors).collect()}
    assert ("broken", "notes/b.md:5:nowhere") in got and ("duplicate_headings", "notes/b.md:Two") in got
    assert ("orphan_embeddings", "gone") in got and ("dim_mismatch", "gone") in got and ("orphans", "é.md") in got


def test_streaming(spark, tmp_path):
    from tessera.streaming.sync import follow

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path": "a.md", "text": "# A"}\n')
    follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["title"] == "A"
