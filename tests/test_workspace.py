"""Commands on a folder, end to end, and the index that follows them."""

import sys

import pytest

from tessera.functions import text as T
from tessera.operators import embedding, graph, index, markdown
from tessera.plans.sql import run_sql
from tessera.sources import workspace as W
from tessera.sources.commands import Refused, Workspace, find_root


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    (root / "notes").mkdir()
    (root / "notes" / "a.md").write_text("---\ntitle: Alpha\ntags: [x]\n---\n# Alpha\n\nsee [[b|bee]] and [b](b.md#Two)\n\n## One\n\nfirst words here\n\n## Two\n\nother words\n")
    (root / "notes" / "b.md").write_text("# Bee\n\n## Two\n\nback to [[a]] and [[nowhere]]\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "c.md").write_text("no")
    return Workspace.init(spark, str(root), dim=16)


def read(ws, path):
    return (ws.root / path).read_text()


def test_commands(ws, spark):
    assert ws.paths() == ["notes/a.md", "notes/b.md"] and find_root(str(ws.root / "notes")) == ws.root
    with pytest.raises(FileNotFoundError):
        find_root("/")
    with pytest.raises(Refused):
        Workspace.init(spark, str(ws.root))
    # new and write
    ws.new("notes/new.md", "# New\n\ntext\n", about="fresh")
    assert read(ws, "notes/new.md").startswith("---\ntitle: new\nabout: fresh\n---\n# New")
    with pytest.raises(Refused):
        ws.new("notes/new.md")
    ws.write("notes/new.md", "# Newer\n")
    assert read(ws, "notes/new.md") == "---\ntitle: new\nabout: fresh\n---\n# Newer\n"
    ws.append("notes/new.md", "more\n")
    assert read(ws, "notes/new.md").endswith("# Newer\n\nmore\n")
    # undo twice is nothing; restore by hash
    before = read(ws, "notes/new.md")
    ws.undo("notes/new.md")
    assert read(ws, "notes/new.md") != before
    ws.undo("notes/new.md")
    assert read(ws, "notes/new.md") == before
    first = min(ws.versions().filter("path = 'notes/new.md'").collect(), key=lambda r: r["seq"])
    ws.restore("notes/new.md", first["sha"][:10])
    assert "# New\n" in read(ws, "notes/new.md")
    with pytest.raises(LookupError):
        ws.restore("notes/new.md", "zz")
    # sections
    section = ws.section("notes/a.md#two")
    with pytest.raises(Refused):
        ws.set("notes/a.md#two", "changed", sha="0000")
    ws.set("notes/a.md#two", "changed", sha=section["content_sha"][:8])
    assert read(ws, "notes/a.md").endswith("## Two\n\nchanged\n")
    with pytest.raises(LookupError):
        ws.section("notes/a.md#three")
    assert ws.tag("notes/a.md", ["y"], ["x"]) == ["y"] and "tags: [y]" in read(ws, "notes/a.md")
    # move rewrites links; removing a linked document is refused
    assert ws.move("notes/b.md", "deep/c.md") == 2
    assert "[[deep/c|bee]] and [b](deep/c.md#Two)" in read(ws, "notes/a.md")
    assert ws.versions().filter("path = 'notes/b.md'").count() == 0
    with pytest.raises(graph.Linked):
        ws.remove("deep/c.md")
    links = {(r["src"], r["target_path"]) for r in ws.index().links.collect()}
    assert ("notes/a.md", "deep/c.md") in links and ("deep/c.md", "notes/a.md") in links
    ws.remove("notes/new.md")
    assert ws.index().files.count() == 2
    # sync sees what changed behind our back
    assert ws.sync() == {}
    (ws.root / "notes" / "d.md").write_text("# Dee\n\nsee [[a]]\n")
    (ws.root / "deep" / "c.md").write_text("# Cee\n")
    assert ws.sync() == {"notes/d.md": "new", "deep/c.md": "changed"}
    assert ws.sync() == {}
    # search, map, health
    hits, said = ws.find("words", k=3, text_only=True)
    assert [(r["path"], r["heading_path"]) for r in hits.collect()] == [("notes/a.md", "One")] and "chunks have no vector" in said[0]
    hits, said = ws.find("words", k=3)
    assert hits.count() == 3 and said == []
    assert ws.find("words", folder="deep")[0].filter("path like 'notes/%'").count() == 0
    assert "**a.md** `#y` → 2 out, 1 back\n  One · Two" in ws.map() and "## notes/" in ws.map()
    assert ws.doctor().filter("category = 'dim_mismatch'").count() == 0
    ws.keep = 1
    assert ws.collect_garbage() > 0 and ws.versions().groupBy("path").count().filter("count > 1").count() == 0


def test_versions_of_the_index(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "# A\n"), ("b.md", "[[a]]")], "path string, text string")
    now = index.build(docs)
    index.save(now, str(tmp_path / "i"))
    index.save(index.remove(now, docs.filter("path = 'a.md'").select("path")), str(tmp_path / "i"))
    found = index.load(spark, str(tmp_path / "i"))
    assert [r["target_path"] for r in found.links.collect()] == [None]
    back = index.upsert(found, index.build(docs.filter("path = 'a.md'")))
    assert [r["target_path"] for r in back.links.collect()] == ["a.md"] and back.files.count() == 2
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "none"))


def test_sidecar():
    echo = "import sys, json\nfor x in sys.stdin:\n    r = json.loads(x)\n    print(json.dumps({'id': r['id'], 'vector': [len(r['text']), 0]}))"
    ask = embedding.sidecar([sys.executable, "-c", echo])
    assert ask(["ab", "c"]) == [[2, 0], [1, 0]]
    assert embedding.embed_query("abc", ask, 2) == [3, 0]
    with pytest.raises(embedding.Failed):
        embedding.embed_query("abc", ask, 3)
    for program in ("import sys; sys.exit(3)", "print('no json')", "print('{}')", "pass"):
        with pytest.raises(embedding.Failed):
            embedding.sidecar([sys.executable, "-c", program])(["x"])
    with pytest.raises(embedding.Failed):
        embedding.sidecar(["/no/such/program"])(["x"])
    import pandas as pd

    assert embedding.unpack_vector(embedding.pack_vector(pd.Series([[1.5, -2.0]])))[0] == [1.5, -2.0]


def test_cut_at_blank_lines():
    """Every piece begins with the end of the one before, and stands where its bytes say."""
    paragraphs = [f"p{i} " + "wörd " * (i * 7 % 60) for i in range(30)]
    text = "## S\n\n" + "\n\n".join(paragraphs) + "\n"
    data = text.encode()
    rows = markdown.chunks(text, markdown.headings(text), 300, 0, 0.1)
    assert len(rows) > 5 and [r["ordinal"] for r in rows] == list(range(len(rows)))
    for a, b in zip(rows, rows[1:]):
        assert b["text"].startswith(a["text"][-30:] + "\n\n")
        assert data[b["byte_start"] : b["byte_end"]].decode() == b["text"]
        assert len(b["text"]) <= 300 + 30 + 2 or "\n\n" not in b["text"][32:]
    assert "\n\n".join(p for p in paragraphs) in text and all(p in "".join(r["text"] for r in rows) for p in paragraphs)
    # a part left out between paragraphs: the extent is the whole section's
    odd = "## S\n\n" + "a" * 200 + "\n\n \n\n" + "b" * 50 + "\n\n" + "c" * 200
    rows = markdown.chunks(odd, markdown.headings(odd), 260, 0, 0.0)
    assert rows[0]["text"] == "a" * 200 + "\n\n" + "b" * 50 and (rows[0]["byte_start"], rows[0]["byte_end"]) == (5, len(odd))


def test_csv_json_and_ls(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name,when\n1,\"a, b\",2024-01-02\n2,,2024-01-03\n")
    W.create_database(spark, "csvs")
    with pytest.raises(ValueError):
        W.create_database(spark, "csvs")
    try:
        assert W.import_csv(spark, str(tmp_path / "in.csv"), "csvs", "t") == 2
        W.export_csv(spark, "csvs", "t", str(tmp_path / "out.csv"), single=True)
        assert (tmp_path / "out.csv").read_text().splitlines()[:2] == ["id,name,when", '1,"a, b",2024-01-02']
        assert [tuple(r)[:2] for r in W.catalog(spark, "csvs").collect()] == [("t", 2)]
        assert [r["value"] for r in W.to_json(spark.table("csvs.t").orderBy("id")).collect()][1] == '{"id":2,"name":null,"when":"2024-01-03"}'
        assert run_sql(spark, "CREATE TABLE csvs.u AS SELECT 1 AS x").rows == []
    finally:
        spark.sql("DROP DATABASE csvs CASCADE")
    files = spark.createDataFrame([("a/x.md", "md", 5, 2, ["p", "q"]), ("a/y.db", "db", 9, 1, []), ("b/z.md", "md", 5, 3, ["p"])], "path string, kind string, size long, mtime long, tags array<string>")
    assert [r["path"] for r in W.ls(files, sort="size").collect()] == ["a/y.db", "a/x.md", "b/z.md"]
    assert [r["path"] for r in W.ls(files, "a/*", "md", ["q"]).collect()] == ["a/x.md"]
    assert markdown.split_address("a.md#B/C") == ("a.md", "B/C") and markdown.split_address("a.md") == ("a.md", None)


def test_slug_is_the_same_in_both_forms(spark):
    texts = ["Été  *Naïve*", " - a -- b_c ~d~ ", "[[link]] `x`", "C++ / D#", "漢字 १२", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.slug("t")).collect()]
    assert got == [T.slug_text(t) for t in texts]
