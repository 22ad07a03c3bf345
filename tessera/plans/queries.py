"""The document engine's registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, history, markdown, search
from .sql import asof_join, range_join

TABLES = set("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Sample Markdown with what the driver's tables lack.
WORKSPACE = {
    "notes/a.md": "---\ntitle: Alpha\ntags: [x, \"y, z\"]\nabout: first\n---\n# Alpha\n\nintro\n\n## One ##\n\nSee [[b#Two|bee]] and [c](../c.md \"C\").\n\n### Deep\n\n`[[no]]` text\n\n## Two\n\n```\n# not a heading\n[[not-a-link]]\n```\nend ![i](i.png) [w](https://w.org)\n",
    "notes/b.md": "# Bee\n## Two\nshort\n## Two\nagain [[a]] [[nowhere]]\n",
    "c.md": "no headings, only [[notes/a]] here\n",
    "é.md": "# Été\n\n## Naïve café_bar\n\nmot\n",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TERMS_SQL = r"list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
BM25_SQL = f"""
w AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents),
c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'thing')) AS f1 FROM w),
s AS (SELECT count(*) AS n, avg(l) AS a, sum(CASE WHEN f0 > 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN f1 > 0 THEN 1 ELSE 0 END) AS n1 FROM c),
i AS (SELECT a, CASE WHEN n0 + n0 >= n THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END AS i0,
  CASE WHEN n1 + n1 >= n THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1 FROM s),
bm AS (SELECT doc_id, round(-(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score
  FROM c, i WHERE f0 > 0 AND f1 > 0)"""
COS_SQL = """
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
co AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)"""


@query(f"WITH {BM25_SQL} SELECT doc_id, score FROM bm ORDER BY score, doc_id LIMIT 20")
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents"), "the thing", 20)


def _vector(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"WITH {COS_SQL} SELECT vec_id, score FROM co ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    return search.cosine(table(spark, d, "embeddings"), _vector(spark, d), 20)


@query(f"""WITH {BM25_SQL}, {COS_SQL},
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score, doc_id) AS r FROM bm QUALIFY r <= 50
  UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM co QUALIFY r <= 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 10) AS score FROM l GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def rrf_hybrid(spark, d):
    """The pairing of documents with vectors of the same number is synthetic."""
    return search.find(table(spark, d, "documents"), table(spark, d, "embeddings"), "the thing", _vector(spark, d), 10)


LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents"


@query(f"SELECT doc_id, CAST(line AS INT) AS line, text, true AS match FROM ({LINES_SQL}) WHERE regexp_matches(text, 'thing\\b.*and')")
def grep_lines(spark, d):
    return search.grep(table(spark, d, "documents"), r"thing\b.*and")


@query(f"""WITH l AS (SELECT *, regexp_matches(text, '(?i)licensed') AS m FROM ({LINES_SQL})),
n AS (SELECT *, max(CAST(m AS INT)) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l)
SELECT doc_id, CAST(line AS INT) AS line, text, m AS match FROM n WHERE near = 1""")
def grep_context(spark, d):
    return search.grep(table(spark, d, "documents"), "licensed", ignore_case=True, context=2)


@query("SELECT doc_id FROM documents WHERE contains(text, '@mail')")
def grep_files(spark, d):
    return search.grep_files(table(spark, d, "documents"), "@mail", fixed=True)


@query("SELECT doc_id, sha256(text) AS sha, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_by_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""WITH c AS (SELECT doc_id, source, sha256('hash' || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS embed_sha FROM documents)
SELECT DISTINCT embed_sha FROM c WHERE embed_sha NOT IN (SELECT embed_sha FROM c WHERE source IN ('src1', 'src2'))""")
def embed_cache_missing(spark, d):
    chunks = table(spark, d, "documents").select("source", history.embed_sha(F.col("text")).alias("embed_sha"))
    return history.missing_embeddings(chunks, chunks.filter("source in ('src1', 'src2')")).select("embed_sha")


SYNC_SQL = """r AS (SELECT doc_id AS path, n_chars AS size, n_chars AS mtime, sha256(text) AS sha FROM documents WHERE doc_id % 10 <> 3),
d AS (SELECT doc_id AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, n_chars + doc_id % 2 AS mtime,
  sha256(text || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS sha FROM documents WHERE doc_id % 10 <> 4),
st AS (SELECT coalesce(r.path, d.path) AS path, CASE WHEN r.path IS NULL THEN 'new' WHEN d.path IS NULL THEN 'removed'
  WHEN (r.size = d.size AND r.mtime = d.mtime) OR r.sha = d.sha THEN 'unchanged' ELSE 'changed' END AS status FROM r FULL JOIN d ON r.path = d.path)"""


def _snapshots(spark, d):
    """Two derived states of documents: the subject of a diff, not a shortcut through the table."""
    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 10 != 3").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("n_chars").alias("mtime"), F.sha2("text", 256).alias("sha"))
    edit = F.when(F.col("doc_id") % 7 == 0, "!").otherwise("")
    new = docs.filter("doc_id % 10 != 4").select(
        F.col("doc_id").alias("path"), (F.col("n_chars") + F.length(edit)).alias("size"), (F.col("n_chars") + F.col("doc_id") % 2).alias("mtime"), F.sha2(F.concat("text", edit), 256).alias("sha")
    )
    return old, new


@query(f"WITH {SYNC_SQL} SELECT path, status FROM st")
def sync_diff(spark, d):
    return history.sync_diff(*_snapshots(spark, d))


@query(f"WITH {SYNC_SQL} SELECT status, count(*) AS n FROM st GROUP BY status")
def sync_status_counts(spark, d):
    return sync_diff(spark, d).groupBy("status").agg(F.count("*").alias("n"))


EDGES_SQL = "e AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)"


def _edges(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target"))


@query(f"WITH {EDGES_SQL} SELECT page_id, target, count(*) AS n FROM e GROUP BY ALL")
def link_edges(spark, d):
    return _edges(spark, d).groupBy("page_id", "target").agg(F.count("*").alias("n"))


PAGES_SQL = EDGES_SQL + """, p AS (SELECT page_id, regexp_replace(url, '^.*/', '') AS name FROM pages),
u AS (SELECT name, min(page_id) AS target_id FROM p GROUP BY name HAVING count(*) = 1),
x AS (SELECT e.page_id, e.target, u.target_id FROM e LEFT JOIN u ON regexp_replace(e.target, '^.*/', '') = u.name)"""


def _resolved(spark, d):
    pages = table(spark, d, "pages").select("page_id", graph.basename("url").alias("name"))
    single = pages.groupBy("name").agg(F.min("page_id").alias("target_id"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return _edges(spark, d).withColumn("name", graph.basename("target")).join(single, "name", "left").select("page_id", "target", "target_id")


@query(f"WITH {PAGES_SQL} SELECT page_id, target, target_id FROM x")
def link_resolve(spark, d):
    return _resolved(spark, d)


@query(f"""WITH {PAGES_SQL}, o AS (SELECT page_id, count(*) AS n FROM x GROUP BY 1), b AS (SELECT target_id, count(*) AS n FROM x WHERE target_id <> page_id GROUP BY 1)
SELECT p.page_id AS path, coalesce(o.n, 0) AS out_links, coalesce(b.n, 0) AS back_links FROM pages p LEFT JOIN o ON o.page_id = p.page_id LEFT JOIN b ON b.target_id = p.page_id""")
def link_degrees(spark, d):
    edges = _resolved(spark, d).select(F.col("page_id").alias("src"), F.col("target_id").alias("target_path"))
    return graph.degrees(table(spark, d, "pages").select(F.col("page_id").alias("path")), edges)


@query(f"WITH {EDGES_SQL} SELECT target, count(DISTINCT page_id) AS n FROM e GROUP BY target ORDER BY n DESC, target LIMIT 20")
def backlinks_topk(spark, d):
    return _edges(spark, d).groupBy("target").agg(F.count_distinct("page_id").alias("n")).orderBy(F.desc("n"), "target").limit(20)


@query(f"WITH {PAGES_SQL} SELECT page_id AS path FROM pages WHERE page_id NOT IN (SELECT target_id FROM x WHERE target_id IS NOT NULL)")
def orphan_pages(spark, d):
    return graph.orphans(table(spark, d, "pages").select(F.col("page_id").alias("path")), _resolved(spark, d).select(F.col("target_id").alias("target_path")))


def _versions(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("sha"), "ts")


VERSIONS_SQL = "v AS (SELECT user_id AS path, event_id AS seq, event_type AS sha, ts FROM events)"


@query(f"WITH {VERSIONS_SQL} SELECT path, seq, sha, ts FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def history_latest(spark, d):
    return history.latest(_versions(spark, d))


@query(f"WITH {VERSIONS_SQL} SELECT path, seq, sha, ts FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) <= 50")
def history_keep_n(spark, d):
    return history.keep_last(_versions(spark, d), 50)


@query(f"WITH {VERSIONS_SQL} SELECT path, seq, sha, ts FROM v QUALIFY lag(sha) OVER (PARTITION BY path ORDER BY seq) IS DISTINCT FROM sha")
def history_consecutive_dedupe(spark, d):
    return history.consecutive_dedupe(_versions(spark, d))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY n_chars DESC, doc_id")
def ls_filter_tags(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return docs.filter(T.has_tags("tags", ["en", "src3"])).select("doc_id", "lang", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


@query("SELECT source || '/' || lang || '/' AS folder, count(*) AS n, sum(n_chars) AS size FROM documents GROUP BY 1")
def map_group_counts(spark, d):
    path = F.concat_ws("/", "source", "lang", F.lit("x"), F.concat("doc_id", F.lit(".md")))
    return table(spark, d, "documents").groupBy(T.path_parts(path, 2).alias("folder")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"))


@query(f"""WITH {PAGES_SQL} SELECT 'broken' AS category, count(*) AS n FROM x WHERE target_id IS NULL
UNION ALL SELECT 'orphans', count(*) FROM pages WHERE page_id NOT IN (SELECT target_id FROM x WHERE target_id IS NOT NULL)
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'unlabelled', count(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL""")
def doctor_counts(spark, d):
    docs = table(spark, d, "documents")
    parts = {
        "broken": _resolved(spark, d).filter("target_id is null"), "orphans": orphan_pages(spark, d), "duplicates": dup_by_hash(spark, d),
        "unlabelled": docs.join(table(spark, d, "labels"), "doc_id", "left_anti"),
    }
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("category"), "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def props_json(spark, d):
    k = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS text FROM documents")
def line_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.lines("text", 2, 3), "\n").alias("text"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
WHERE l_shipdate < TIMESTAMP '1998-09-01' GROUP BY ALL""")
def sql_aggregate(spark, d):
    rows = table(spark, d, "lineitem").filter("l_shipdate < timestamp_ntz '1998-09-01'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


JOIN_SQL = """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name"""
SEMI_SQL = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)"
ANTI_SQL = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
OUTER_SQL = """SELECT n_nationkey, n_name, s_suppkey, s_name FROM nation FULL JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000"""
CROSS_SQL = "SELECT r_name, n_name FROM region CROSS JOIN nation"
ROLLUP_SQL = "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"
GROUPING_SQL = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"
HAVING_SQL = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 ORDER BY n DESC, o_custkey LIMIT 50"
LATERAL_SQL = """SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x"""
LISTAGG_SQL = "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"
LISTAGG_SPARK = "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"
QUALIFY_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"
QUALIFY_SPARK = """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
FROM orders) WHERE r = 1"""
EXCEPT_SQL = "SELECT * EXCLUDE (c_acctbal) FROM customer"
EXCEPT_SPARK = "SELECT * EXCEPT (c_acctbal) FROM customer"
DISTINCT_ON_SQL = "SELECT DISTINCT ON (s_nationkey) s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey"
DISTINCT_ON_SPARK = """SELECT s_nationkey, max_by(s_suppkey, struct(s_acctbal, -s_suppkey)) AS s_suppkey, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY s_nationkey"""
RANGE_SQL = "SELECT range AS id, range * range AS squared FROM range(1000)"
RANGE_SPARK = "SELECT id, id * id AS squared FROM range(1000)"
UNPIVOT_SQL = """SELECT p_partkey, measure, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR measure IN (p_size, p_retailprice))"""
SUMMARY_SQL = """SELECT 'l_quantity' AS name, count(l_quantity) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev(l_quantity), 6) AS deviation,
approx_count_distinct(l_linenumber) BETWEEN 6 AND 8 AS near_seven FROM lineitem"""
QUANTILES_SQL = """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS middle, abs(approx_quantile(l_quantity, 0.5) - 25) <= 2 AS near_middle FROM lineitem GROUP BY l_returnflag"""
QUANTILES_SPARK = """SELECT l_returnflag, percentile(l_extendedprice, 0.5) AS middle, abs(percentile_approx(l_quantity, 0.5) - 25) <= 2 AS near_middle FROM lineitem GROUP BY l_returnflag"""
SETS_ALL_SQL = "(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)"
ANALYTIC_SQL = """SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, 0.0) OVER w AS later,
first_value(o_orderkey) OVER w AS first_key, round(percent_rank() OVER w, 9) AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
SCALARS_SQL = """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_trunc('month', o_orderdate) AS begun, upper(substr(o_orderpriority, 3)) AS word, abs(round(o_totalprice) - o_totalprice) AS off,
greatest(o_custkey, 100) AS g, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, lpad(CAST(o_custkey AS VARCHAR(20)), 8, '0') AS padded FROM orders"""
SCALARS_SPARK = SCALARS_SQL
NESTED_SQL = """SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS lines, len(list(l_linenumber)) AS n FROM lineitem GROUP BY l_orderkey"""
NESTED_SPARK = """SELECT l_orderkey, array_sort(collect_set(l_linenumber)) AS lines, CAST(size(collect_list(l_linenumber)) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey"""
MAP_SQL = """SELECT o_orderstatus, element_at(map_from_entries(list((o_orderpriority, n) ORDER BY o_orderpriority)), '2-HIGH')[1] AS high FROM
(SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus"""
MAP_SPARK = """SELECT o_orderstatus, element_at(map_from_entries(collect_list(struct(o_orderpriority, n))), '2-HIGH') AS high FROM
(SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus"""
THETA_SQL = """SELECT r_name, count(*) AS n FROM region JOIN nation ON n_nationkey > r_regionkey * 4 GROUP BY r_name"""
CUBE_SQL = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"
SETS_SQL = "(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)"
WINDOW_SQL = """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
FROM orders"""
TREE_SQL = """WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n, count(*) AS c FROM t JOIN region ON r_regionkey < n GROUP BY n"""
QUANTILE_SQL = "SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS suppliers, sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS taxed FROM lineitem GROUP BY l_returnflag"


def _delegated(name: str, sql: str, spoken: str | None = None) -> None:
    """One statement for both engines, or Spark's own words for it; tables are named by their files, not by views."""
    names = sorted(set(re.findall(r"(?:FROM|JOIN) (\w+)\b", spoken or sql)) & TABLES)

    def run(spark, d):
        statement = spoken or sql
        for t in names:
            statement = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", statement)
        return spark.sql(statement, **{t: table(spark, d, t) for t in names})

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


for _name, *_sql in (
    ("sql_join", JOIN_SQL), ("sql_semi", SEMI_SQL), ("sql_anti", ANTI_SQL), ("sql_cube", CUBE_SQL), ("sql_sets", SETS_SQL), ("sql_window", WINDOW_SQL),
    ("sql_recursive", TREE_SQL), ("sql_filtered", QUANTILE_SQL), ("sql_outer", OUTER_SQL), ("sql_cross", CROSS_SQL), ("sql_rollup", ROLLUP_SQL), ("sql_grouping_sets", GROUPING_SQL),
    ("sql_having_topk", HAVING_SQL), ("sql_lateral", LATERAL_SQL), ("sql_listagg", LISTAGG_SQL, LISTAGG_SPARK), ("sql_qualify", QUALIFY_SQL, QUALIFY_SPARK), ("sql_except_columns", EXCEPT_SQL, EXCEPT_SPARK),
    ("sql_distinct_on", DISTINCT_ON_SQL, DISTINCT_ON_SPARK), ("sql_range", RANGE_SQL, RANGE_SPARK), ("sql_unpivot", UNPIVOT_SQL), ("sql_summary", SUMMARY_SQL), ("sql_quantiles", QUANTILES_SQL, QUANTILES_SPARK),
    ("sql_sets_all", SETS_ALL_SQL), ("sql_analytic", ANALYTIC_SQL), ("sql_scalars", SCALARS_SQL, SCALARS_SPARK), ("sql_nested", NESTED_SQL, NESTED_SPARK), ("sql_maps", MAP_SQL, MAP_SPARK), ("sql_theta_join", THETA_SQL),
):
    _delegated(_name, *_sql)


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
SELECT p.event_id, p.user_id, max_by(c.value, c.ts) AS asof_value FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.ts <= p.ts GROUP BY 1, 2""")
def sql_asof(spark, d):
    events = table(spark, d, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("at"), "value")
    return asof_join(left, right, "user_id", "ts", "at", "value").drop("ts")


@query("""SELECT p_size, count(*) AS n FROM part JOIN (SELECT p_size AS s, min(p_retailprice) AS lo, min(p_retailprice) + 50 AS hi FROM part GROUP BY 1)
ON lo <= p_retailprice AND p_retailprice < hi GROUP BY p_size""")
def sql_range_join(spark, d):
    part = table(spark, d, "part")
    spans = part.groupBy(F.col("p_size").alias("s")).agg(F.min("p_retailprice").alias("lo")).withColumn("hi", F.col("lo") + 50)
    return range_join(part, spans, "p_retailprice", "lo", "hi", 50).groupBy("p_size").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS low FROM orders GROUP BY 1")
def sql_pivot(spark, d):
    out = table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    return out.select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


def workspace(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(WORKSPACE.items()), "path string, text string")
