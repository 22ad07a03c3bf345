"""How often queries of the document model read their documents, and how much of them is in a task's memory."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import digest, graph, index, markdown
from tessera.operators.scratch import SLICE_BYTES
from tessera.plans import documents  # noqa: F401 - registers its queries
from tessera.plans.queries import QUERIES

from .test_queries import SF


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "name, most",
    {"md_links": 2, "md_links_of": 2, "md_backlinks": 2, "md_degrees": 3, "map_rows": 4, "doctor_report": 1, "md_chunks": 1, "index_sync_plan": 1, "doctor": 1, "find_chunks": 2, "index_remove": 4, "index_upsert": 10, "index_sync": 14}.items(),
)
def test_documents_are_parsed_once_a_part(spark, name, most):
    """Documents are parsed for no part that a query does not need, and for none again at each use of it."""
    assert plan(QUERIES[name](spark, SF)).count("MapIn") <= most


def test_a_task_holds_slices_of_its_texts(spark):
    docs = spark.range(0, 600, 1, 1).select(F.concat("id", F.lit(".md")).alias("path"), F.repeat(F.lit("ab cd\n"), 2000).alias("text"))

    def make(paths, texts):
        return [paths, [sum(map(len, texts))] * len(paths)]

    found = [r["n"] for r in markdown.by_slices(docs, make, "path string, n long").collect()]
    assert len(found) == 600 and max(found) <= SLICE_BYTES and min(found) > 0


def test_parts_are_those_of_the_whole_parse(spark):
    texts = [None, "", "no title", "---\ntitle: T\naliases: [x, y]\nabout: [a]\n---\n# H\n\n## A\n[[b]] `[[c]]` [l](d.md#e \"t\")\n\n```\n# no\n[[no]]\n```\n\n## A\nö\n" + "word \n\n" * 400]
    docs = spark.createDataFrame([(f"{i}.md", t) for i, t in enumerate(texts)], "path string, text string")
    whole = {r["path"]: r for r in markdown.parse(docs).collect()}
    for part in markdown.PARTS:
        one = markdown.parse(docs, parts=(part,)).collect()
        assert len(one) == len(texts) and all(r[c] == whole[r["path"]][c] for r in one for c in r.asDict())
    for path, text in zip(sorted(whole), texts, strict=True):
        sections = markdown.headings(text or "")
        assert [h.asDict() for h in whole[path]["headings"]] == sections
        assert [x.asDict() for x in whole[path]["links"]] == markdown.links(text or "")
        assert [x.asDict() for x in whole[path]["chunks"]] == markdown.chunks(text or "", sections)
    assert [whole[f"{i}.md"]["title"] for i in range(4)] == ["0", "1", "2", "T"]
    assert isinstance(markdown._nested([[], []], pa.list_(pa.struct({"a": pa.int32()}))), pa.ListArray)


def test_links_by_alias_and_in_one_pass(spark):
    texts = {"a.md": "---\nalias: Al\n---\n", "x/b.md": "[[Al]] [[a]] [[c]] [[b]] the alias", "y/c.md": "[[gone]] [[Al]]"}
    docs = spark.createDataFrame(list(texts.items()), "path string, text string")
    now = index.build(docs)
    target = lambda i: {(r["src"], r["target"]): r["target_path"] for r in i.links.collect()}
    want = {("x/b.md", "Al"): "a.md", ("x/b.md", "a"): "a.md", ("x/b.md", "c"): "y/c.md", ("x/b.md", "b"): "x/b.md", ("y/c.md", "gone"): None, ("y/c.md", "Al"): "a.md"}
    assert target(now) == want
    assert {r["path"]: (r["out_links"], r["back_links"]) for r in graph.degrees(now.files, now.links).collect()} == {"a.md": (0, 3), "x/b.md": (4, 0), "y/c.md": (2, 1)}
    # a link that has a target keeps it, the others look for one
    more = index.upsert(now, index.build(spark.createDataFrame([("gone.md", ""), ("x/a.md", "")], "path string, text string")))
    assert target(more) == {**want, ("y/c.md", "gone"): "gone.md"}
    left = index.remove(more, spark.createDataFrame([("a.md",)], "path string"))
    assert target(left) == {**want, ("y/c.md", "gone"): "gone.md", ("x/b.md", "a"): "x/a.md", ("x/b.md", "Al"): None, ("y/c.md", "Al"): None}


def test_report_deals_a_category_over_tasks(spark):
    findings = spark.range(5000).select(F.when(F.col("id") < 3, "few").otherwise("many").alias("category"), F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("item"))
    shown = digest.report(findings, 4)
    rows = sorted((r["category"], r["item"], r["total"]) for r in shown.collect())
    assert rows == [("few", f"i{i:05}", 3) for i in range(3)] + [("many", f"i{i:05}", 4997) for i in range(3, 7)]
    assert "_share" in plan(shown)
    assert {r["total"] for r in digest.report(findings, None).collect()} == {3, 4997}
