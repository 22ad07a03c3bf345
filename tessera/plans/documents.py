"""Registered queries of the document model, over a workspace that is made of the table documents.

Every document becomes a Markdown file: front matter, a title, a line with links, and a part for each of
its lines, every third one a level deeper.  Names of parts repeat, so there are duplicates and ordinals.
SQL builds what the parser must find from the same lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import digest, graph, history, index, markdown, search
from ..sources import workspace as W
from .queries import VERSIONS_SQL, _vector, _versions, query, table

PATH_SQL = "coalesce(source, 's') || '/' || coalesce(lang, 'xx') || '/' || doc_id || '.md'"
HUGE = 10**9


def workspace(spark, d, edit: str = "''", where: str = "true") -> DataFrame:
    """(path, text, i) of the documents that fit; edit (SQL) is added to each text."""
    rows = table(spark, d, "documents").filter(where).selectExpr("doc_id AS i", "coalesce(lang, 'xx') AS lang", "coalesce(source, 's') AS source", "n_chars", f"split(text || {edit}, '\n') AS parts")
    parts = """array_join(transform(parts, (x, k) -> concat(if((k + 1) % 3 = 0, '### Part ', '## Part '), (k + 1) % 4, '\n', 'n', k + 1, ' ', x)), '\n')"""
    intro = """concat('see [[', i + 1, ']], [[missing', i, ']] and [two on](', i + 2, '.md "t") `[[no]]`')"""
    front = r"concat('---\ntitle: Doc ', i, '\ntags: [', lang, ', ', source, ']\nabout: ', n_chars, ' characters\n---\n')"
    return rows.selectExpr("concat(source, '/', lang, '/', i, '.md') AS path", f"concat({front}, '# Doc ', i, '\n', {intro}, '\n', {parts}) AS text", "i")


def made(edit: str = "''", where: str = "true") -> str:
    return f"""l AS (SELECT doc_id AS i, {PATH_SQL} AS path, coalesce(lang, 'xx') AS lang, coalesce(source, 's') AS source, n_chars, string_split(text || {edit}, chr(10)) AS parts FROM documents WHERE {where}),
u AS (SELECT i, path, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS j, len(parts) AS m FROM l),
h AS (SELECT *, CASE WHEN j % 3 = 0 THEN 3 ELSE 2 END AS level, 'Part ' || j % 4 AS name, CASE WHEN j % 3 = 0 THEN '### Part ' ELSE '## Part ' END || j % 4 AS head, 'n' || j || ' ' || line AS body,
  CASE WHEN j % 3 = 0 THEN 'Part ' || (j - 1) % 4 || '/' ELSE '' END || 'Part ' || j % 4 AS heading_path FROM u),
pre AS (SELECT i, path, lang, source, n_chars, '---' || chr(10) || 'title: Doc ' || i || chr(10) || 'tags: [' || lang || ', ' || source || ']' || chr(10) || 'about: ' || n_chars || ' characters' || chr(10) || '---' || chr(10) AS front,
  '# Doc ' || i AS h1, 'see [[' || (i + 1) || ']], [[missing' || i || ']] and [two on](' || (i + 2) || '.md "t") `[[no]]`' AS intro FROM l),
b AS (SELECT h.*, strlen(front) + strlen(h1) + strlen(intro) + 2 + coalesce(sum(strlen(head) + strlen(body) + 2) OVER (PARTITION BY h.i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  CASE WHEN level = 2 AND (j + 1) % 3 = 0 AND j < m THEN 1 ELSE 0 END AS child FROM h JOIN pre USING (i)),
e AS (SELECT *, start + strlen(head) + 1 AS body_start, start + strlen(head) + 1 + strlen(body) AS stop FROM b),
w AS (SELECT any_value(pre.path) AS path, i, any_value(front) AS front, any_value(h1) AS h1, any_value(intro || chr(10)) || string_agg(head || chr(10) || body, chr(10) ORDER BY j) AS rest FROM h JOIN pre USING (i) GROUP BY i),
t AS (SELECT path, i, front || h1 || chr(10) || rest AS text FROM w),
s AS (SELECT e.i, e.path, e.name AS text, e.level, e.heading_path, 2 * e.j + 6 AS line_start, 2 * (e.j + e.child) + 7 AS line_end, e.start AS byte_start,
  CASE WHEN e.child = 1 THEN n.stop + CASE WHEN n.j < n.m THEN 1 ELSE 0 END ELSE e.stop + CASE WHEN e.j < e.m THEN 1 ELSE 0 END END AS byte_end, e.body_start,
  row_number() OVER (PARTITION BY e.i, e.heading_path ORDER BY e.j) - 1 AS ordinal, sha256(e.body || CASE WHEN e.child = 1 THEN chr(10) || n.head || chr(10) || n.body ELSE '' END) AS content_sha
  FROM e LEFT JOIN e n ON n.i = e.i AND n.j = e.j + 1
  UNION ALL SELECT w.i, w.path, 'Doc ' || i, 1, 'Doc ' || i, 6, 2 * m + 7, strlen(front), strlen(front) + strlen(h1) + 1 + strlen(rest), strlen(front) + strlen(h1) + 1, 0, sha256(rest)
  FROM w JOIN (SELECT i, max(m) AS m FROM u GROUP BY i) USING (i)),
k AS (SELECT l.path AS src, x.raw, x.target, x.kind, 7 AS line, x.shown AS alias, g.path AS target_path FROM l,
  LATERAL (SELECT unnest([{{'raw': '[[' || (l.i + 1) || ']]', 'target': CAST(l.i + 1 AS VARCHAR), 'kind': 'wiki', 'shown': NULL, 'to_id': l.i + 1}},
    {{'raw': '[[missing' || l.i || ']]', 'target': 'missing' || l.i, 'kind': 'wiki', 'shown': NULL, 'to_id': NULL}},
    {{'raw': '[two on](' || (l.i + 2) || '.md "t")', 'target': (l.i + 2) || '.md', 'kind': 'md', 'shown': 'two on', 'to_id': l.i + 2}}], recursive := true)) x
  LEFT JOIN l g ON g.i = x.to_id),
c AS (SELECT path, heading_path, CAST(j - 1 AS INT) AS ordinal, body AS text, body_start AS byte_start, stop AS byte_end, 2 * j + 7 AS line_start, 2 * j + 7 AS line_end, sha256(body) AS raw_sha,
  sha256('hash' || chr(10) || replace(heading_path, '/', ' > ') || chr(10) || chr(10) || trim(body, ' ' || chr(9) || chr(10) || chr(13))) AS embed_sha,
  path || '#' || (j - 1) || ':' || substr(sha256(body), 1, 12) AS chunk_id, i, j FROM e)"""


MADE = made()


def _index(spark, d, **how):
    return index.build(workspace(spark, d, **how), min_chars=0, max_chars=HUGE)


@query(f"""WITH {MADE} SELECT path, text, level, heading_path, lower(replace(heading_path, ' ', '-')) AS slug_path, line_start, line_end, byte_start, byte_end, body_start, ordinal, content_sha FROM s""")
def md_headings(spark, d):
    return markdown.heading_rows(markdown.parse(workspace(spark, d)))


@query(f"""WITH {MADE} SELECT text, level, line_start, content_sha FROM s WHERE i = 7""")
def md_outline(spark, d):
    return markdown.heading_rows(markdown.parse(workspace(spark, d).filter("i = 7"))).select("text", "level", "line_start", "content_sha")


@query(f"""WITH {MADE} SELECT pre.path, 'md' AS kind, strlen(text) AS size, 0 AS mtime, sha256(text) AS sha256, 'Doc ' || pre.i AS title, n_chars || ' characters' AS about, lang || ',' || source AS tags,
'{{"title": "Doc ' || pre.i || '", "tags": ["' || lang || '", "' || source || '"], "about": "' || n_chars || ' characters"}}' AS frontmatter FROM pre JOIN t USING (i)""")
def md_files(spark, d):
    return _index(spark, d).files.withColumn("tags", F.array_join("tags", ","))


@query(f"WITH {MADE} SELECT src, raw, target, CAST(NULL AS VARCHAR) AS anchor, kind, line, alias, target_path, target_path IS NOT NULL AS resolved FROM k")
def md_links(spark, d):
    return _index(spark, d).links


@query(f"WITH {MADE} SELECT src, line, raw FROM k WHERE target_path = (SELECT path FROM l WHERE i = 12) AND src <> target_path ORDER BY src, line")
def md_backlinks(spark, d):
    path = workspace(spark, d).filter("i = 12").first()["path"]
    return graph.backlinks(_index(spark, d).links, path).select("src", "line", "raw")


@query(f"WITH {MADE} SELECT src, line, raw, target_path FROM k WHERE src = (SELECT path FROM l WHERE i = 5)")
def md_links_of(spark, d):
    """One document's links in the order of their lines."""
    path = workspace(spark, d).filter("i = 5").first()["path"]
    return _index(spark, d).links.filter(F.col("src") == path).orderBy("line").select("src", "line", "raw", "target_path")


@query(f"""WITH {MADE}, o AS (SELECT src, count(*) AS n FROM k GROUP BY 1), r AS (SELECT target_path, count(*) AS n FROM k WHERE src <> target_path GROUP BY 1)
SELECT path, coalesce(o.n, 0) AS out_links, coalesce(r.n, 0) AS back_links FROM l LEFT JOIN o ON src = path LEFT JOIN r ON r.target_path = path""")
def md_degrees(spark, d):
    now = _index(spark, d)
    return graph.degrees(now.files, now.links)


@query(f"WITH {MADE} SELECT path, heading_path, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 1")
def md_duplicate_headings(spark, d):
    return markdown.duplicate_headings(markdown.parse(workspace(spark, d)))


STAGED_SQL = f"""{MADE}, g AS (SELECT *, CASE WHEN level = 2 THEN 1 ELSE 2 END AS stage FROM s WHERE level > 1 AND text = 'Part 3'),
f AS (SELECT i, min(stage) AS stage FROM g GROUP BY i), a AS (SELECT g.* FROM g JOIN f USING (i, stage))"""


@query(f"""WITH {STAGED_SQL} SELECT path, count(*) AS n, array_to_string(list(line_start ORDER BY line_start), ',') AS lines, min(line_start) AS first_line FROM a GROUP BY path""")
def md_resolve(spark, d):
    found = markdown.resolve(markdown.parse(workspace(spark, d)), "part 3")
    return found.select("path", "n", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), F.array_min("lines").alias("first_line"))


@query(f"""WITH {STAGED_SQL}, z AS (SELECT path, i, count(*) AS n, min(line_start) AS q FROM a GROUP BY path, i)
SELECT z.path, z.n, array_to_string(string_split(t.text, chr(10))[q : a.line_end], chr(10)) || CASE WHEN a.line_end < len(string_split(t.text, chr(10))) THEN chr(10) ELSE '' END AS text
FROM z JOIN t USING (i) JOIN (SELECT i, line_start, line_end FROM a) a ON a.i = z.i AND a.line_start = q""")
def md_section_text(spark, d):
    docs = workspace(spark, d)
    return markdown.section_text(docs, markdown.parse(docs), "Part 3")


@query(f"""WITH {STAGED_SQL}, z AS (SELECT i, min(line_start) AS q, min(line_end) AS r FROM a GROUP BY i HAVING count(*) = 1), y AS (SELECT z.*, t.path, string_split(t.text, chr(10)) AS x FROM z JOIN t USING (i))
SELECT path, array_to_string(x[1 : q], chr(10)) || chr(10) || chr(10) || 'new text' || chr(10) || CASE WHEN r < len(x) THEN chr(10) || array_to_string(x[r + 1 : len(x)], chr(10)) ELSE '' END AS text FROM y""")
def md_replace_section(spark, d):
    return markdown.replace_in(workspace(spark, d), "Part 3", "new text")


@query(f"WITH {MADE} SELECT path, heading_path, ordinal, text, byte_start, byte_end, line_start, line_end, raw_sha, embed_sha, chunk_id FROM c")
def md_chunks(spark, d):
    return _index(spark, d).chunks


@query(f"""WITH {MADE}, p AS (SELECT a.*, CASE WHEN a.j % 3 = 2 AND length(q.body) < 200 THEN 1 ELSE 0 END AS taken, CASE WHEN a.j % 3 = 1 AND length(a.body) < 200 AND n.i IS NOT NULL THEN 1 ELSE 0 END AS takes,
  n.body AS more, n.stop AS later, n.m AS mm, n.j AS jj FROM e a LEFT JOIN e q ON q.i = a.i AND q.j = a.j - 1 LEFT JOIN e n ON n.i = a.i AND n.j = a.j + 1)
SELECT path, heading_path, CAST(row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS INT) AS ordinal, body || CASE WHEN takes = 1 THEN chr(10) || chr(10) || more ELSE '' END AS text, body_start AS byte_start,
CASE WHEN takes = 1 THEN later + CASE WHEN jj < mm THEN 1 ELSE 0 END ELSE stop END AS byte_end FROM p WHERE taken = 0""")
def md_chunks_joined(spark, d):
    rows = index.build(workspace(spark, d), min_chars=200, max_chars=HUGE).chunks
    return rows.select("path", "heading_path", "ordinal", "text", "byte_start", "byte_end")


def _vectors(spark, d):
    """Vectors for the first chunk of each document, from the table embeddings."""
    first = _index(spark, d).chunks.filter("ordinal = 0").select("embed_sha", F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("vec_id"))
    return table(spark, d, "embeddings").join(first, "vec_id").select("embed_sha", F.col("embedding").alias("vec"))


TERMS = r"list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def bm25_sql(rows: str, key: str, counts: tuple[str, str]) -> str:
    """bm (key, score) over rows (key, text) for two phrases, whose counts are SQL over the list t of terms."""
    return f"""bw AS (SELECT {key}, {TERMS} AS t FROM {rows}), bc AS (SELECT {key}, len(t) AS n, {counts[0]} AS f0, {counts[1]} AS f1 FROM bw),
bs AS (SELECT count(*) AS n, avg(n) AS a, sum(CASE WHEN f0 > 0 THEN 1 ELSE 0 END) AS n0, sum(CASE WHEN f1 > 0 THEN 1 ELSE 0 END) AS n1 FROM bc),
bi AS (SELECT a, CASE WHEN n0 + n0 >= n THEN 1e-6 ELSE ln((n - n0 + 0.5) / (n0 + 0.5)) END AS i0, CASE WHEN n1 + n1 >= n THEN 1e-6 ELSE ln((n - n1 + 0.5) / (n1 + 0.5)) END AS i1 FROM bs),
bm AS (SELECT {key}, round(-(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / a))), 6) AS score FROM bc, bi WHERE f0 > 0 AND f1 > 0)"""


WORD_COUNT = "len(list_filter(t, lambda x: x = '{}'))"
PHRASE_COUNT = "len(list_filter(range(1, len(t)), lambda q: t[q] = '{}' AND t[q + 1] = '{}'))"


@query(f"WITH {bm25_sql('documents', 'doc_id', (PHRASE_COUNT.format('of', 'the'), WORD_COUNT.format('and')))} SELECT doc_id, score FROM bm ORDER BY score, doc_id LIMIT 20")
def bm25_phrase(spark, d):
    """A word with an underscore is a phrase; the accent is folded."""
    return search.bm25(table(spark, d, "documents"), "of_the ánd", 20)


@query(f"""WITH {MADE}, z AS (SELECT c.*, lang FROM c JOIN pre USING (path) WHERE lang = 'en'), {bm25_sql('z', 'chunk_id', (WORD_COUNT.format('the'), WORD_COUNT.format('thing')))},
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT DISTINCT c.embed_sha, embedding::DOUBLE[] AS vec, c.i FROM c JOIN embeddings ON vec_id = c.i WHERE c.j = 1),
co AS (SELECT z.chunk_id, round(list_cosine_similarity(vec, q), 6) AS score FROM z JOIN v USING (embed_sha), q),
g AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS r FROM bm QUALIFY r <= 50 UNION ALL SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM co QUALIFY r <= 50),
f AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 10) AS score FROM g GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 10),
x AS (SELECT round(score, 4) AS score, path, heading_path, line_start, line_end, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM f JOIN z USING (chunk_id))
SELECT score, path, heading_path, line_start, line_end, CASE WHEN length(b) <= 100 THEN b ELSE rtrim(substr(b, 1, 99)) || '…' END AS text FROM x""")
def find_chunks(spark, d):
    """Hybrid search over chunks with one tag, given back as a reader needs them."""
    now = _index(spark, d)
    return search.find_chunks(now.chunks, now.files, _vectors(spark, d), "the thing", _vector(spark, d), 10, tag="en")


@query(f"""WITH {MADE}, known AS (SELECT embed_sha FROM c WHERE i % 2 = 0 UNION SELECT 'gone')
SELECT 'broken' AS category, src || ':7:' || target AS item FROM k WHERE target_path IS NULL
UNION ALL SELECT 'orphans', path FROM l WHERE path NOT IN (SELECT target_path FROM k WHERE target_path IS NOT NULL)
UNION ALL SELECT 'duplicate_headings', path || ':' || heading_path FROM s GROUP BY path, heading_path HAVING count(*) > 1
UNION ALL SELECT 'dirty', chunk_id FROM c WHERE embed_sha NOT IN (SELECT embed_sha FROM known)
UNION ALL SELECT 'orphan_embeddings', 'gone' UNION ALL SELECT 'dim_mismatch', 'gone'""")
def doctor(spark, d):
    now = index.held(_index(spark, d), files=["path"], links=["src", "line", "target", "target_path"], chunks=["path", "chunk_id", "embed_sha"])
    some = now.chunks.filter(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 2 == 0).select("embed_sha").distinct()
    vectors = some.withColumn("vec", F.array(F.lit(1.0), F.lit(0.0))).unionByName(spark.sql("SELECT 'gone' AS embed_sha, array(1.0D) AS vec"))
    return graph.doctor(now.files, now.links, now.headings, now.chunks, vectors, 2)


@query(f"""WITH {MADE}, a AS (SELECT path || ':' || heading_path AS item FROM s GROUP BY path, heading_path HAVING count(*) > 1)
SELECT 'duplicate_headings' AS category, item, (SELECT count(*) FROM a) AS total FROM a ORDER BY item LIMIT 10""")
def doctor_report(spark, d):
    now = _index(spark, d)
    item = F.concat_ws(":", "path", "heading_path").alias("item")
    return digest.report(index.duplicate_headings(now).select(F.lit("duplicate_headings").alias("category"), item), 10)


@query(f"""WITH {MADE}, o AS (SELECT src, count(*) AS n FROM k GROUP BY 1), r AS (SELECT target_path, count(*) AS n FROM k WHERE src <> target_path GROUP BY 1),
y AS (SELECT path, string_agg(text, ' · ' ORDER BY line_start) FILTER (level = 2) AS detail FROM s GROUP BY path)
SELECT source || '/' AS folder, pre.path, '- **' || i || '.md** — ' || n_chars || ' characters `#' || lang || '` `#' || source || '` → ' || o.n || ' out, ' || coalesce(r.n, 0) || ' back' AS bullet, detail
FROM pre JOIN y ON y.path = pre.path LEFT JOIN o ON o.src = pre.path LEFT JOIN r ON r.target_path = pre.path""")
def map_rows(spark, d):
    now = _index(spark, d)
    return digest.map_rows(now.files, now.links, now.headings)


@query("SELECT 'db' AS path, string_agg(name || ' (' || n || ')', ' · ' ORDER BY name) AS tables FROM (SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region)")
def table_summary(spark, d):
    counts = [table(spark, d, t).agg(F.lit("db").alias("db_path"), F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in ("nation", "region")]
    return digest.table_summary(counts[0].unionByName(counts[1]))


STATE = """SELECT t.path, strlen(t.text) AS size, sha256(t.text) AS sha256, sc.n AS headings, cc.n AS chunks, kc.n AS resolved FROM t
JOIN (SELECT path, count(*) AS n FROM s GROUP BY 1) sc ON sc.path = t.path JOIN (SELECT path, count(*) AS n FROM c GROUP BY 1) cc ON cc.path = t.path
JOIN (SELECT src, count(target_path) AS n FROM k GROUP BY 1) kc ON kc.src = t.path"""


def _state(now: index.Index) -> DataFrame:
    """One row for each file with counts of what was derived from it."""
    out = now.files.select("path", "size", "sha256")
    out = out.join(now.headings.groupBy("path").agg(F.count("*").alias("headings")), "path").join(now.chunks.groupBy("path").agg(F.count("*").alias("chunks")), "path")
    return out.join(now.links.groupBy(F.col("src").alias("path")).agg(F.count_if("resolved").alias("resolved")), "path")


EDIT = "CASE WHEN doc_id % 10 = 4 THEN '!' ELSE '' END"


@query(f"WITH {made(EDIT)} {STATE}")
def index_upsert(spark, d):
    """Nine tenths of the documents are indexed; then the others are added and some are changed."""
    old = index.held(_index(spark, d, where="doc_id % 10 != 3"), files=[])
    return _state(index.upsert(old, index.held(_index(spark, d, edit=EDIT, where="doc_id % 10 IN (3, 4)"), files=[])))


@query(f"WITH {made(where='doc_id % 10 <> 5')} {STATE}")
def index_remove(spark, d):
    gone = workspace(spark, d).filter("i % 10 = 5").select("path")
    return _state(index.remove(index.held(_index(spark, d), files=[]), gone))


def _folder(spark, d):
    """A folder after the index was made: some files are new, changed, touched or gone."""
    docs = workspace(spark, d, edit=EDIT, where="doc_id % 10 != 5")
    return docs.select("path", "text"), docs.select("path", F.octet_length("text").cast("long").alias("size"), F.when(F.col("i") % 10 == 6, 1).otherwise(0).cast("long").alias("mtime"))


SYNC_STATUS = """SELECT doc_id AS i, CASE doc_id % 10 WHEN 3 THEN 'new' WHEN 4 THEN 'changed' WHEN 5 THEN 'removed' WHEN 6 THEN 'touched' ELSE 'unchanged' END AS status FROM documents"""


@query(f"WITH st AS ({SYNC_STATUS}) SELECT {PATH_SQL} AS path, status FROM documents JOIN st ON i = doc_id")
def index_sync_plan(spark, d):
    contents, listing = _folder(spark, d)
    return index.plan_sync(_index(spark, d, where="doc_id % 10 != 3"), listing, contents)


@query(f"WITH {made(EDIT, 'doc_id % 10 <> 5')} {STATE}")
def index_sync(spark, d):
    contents, listing = _folder(spark, d)
    old = index.held(_index(spark, d, where="doc_id % 10 != 3"), files=[])
    return _state(index.sync(old, listing, contents, min_chars=0, max_chars=HUGE)[0])


@query(f"WITH {MADE} SELECT path, chunk_id FROM c WHERE embed_sha NOT IN (SELECT embed_sha FROM c WHERE i % 3 = 0)")
def index_dirty(spark, d):
    now = _index(spark, d)
    have = now.chunks.filter(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 3 == 0).select("embed_sha")
    return index.dirty(now, have).select("path", "chunk_id")


def _files(spark, d):
    path = F.expr("concat(coalesce(source, 's'), '/', coalesce(lang, 'xx'), '/', doc_id, '.md')")
    rows = table(spark, d, "documents").select(path.alias("path"), F.col("n_chars").alias("size"), F.array("lang", "source").alias("tags"), (F.col("doc_id") % 50).alias("mtime"))
    return rows.withColumn("kind", T.kind("path"))


@query(f"""SELECT {PATH_SQL} AS path, n_chars AS size FROM documents WHERE regexp_full_match({PATH_SQL}, 'src[12]/.*/1.*[.]md') AND lang = 'en'""")
def ls_glob(spark, d):
    return W.ls(_files(spark, d), "src[12]/*/1*.md", "md", ["en"]).select("path", "size")


@query(f"SELECT {PATH_SQL} AS path, doc_id % 50 AS mtime FROM documents ORDER BY doc_id % 50 DESC, 1 LIMIT 40")
def ls_newest(spark, d):
    return W.ls(_files(spark, d), sort="mtime").select("path", "mtime").limit(40)


@query(f"SELECT {PATH_SQL} AS path FROM documents WHERE source = 'src2' AND lang = 'en'")
def under_folder(spark, d):
    return _files(spark, d).filter(T.under("path", "src2/en/")).select("path")


@query("""WITH b AS (SELECT doc_id, n_chars, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS x FROM documents),
y AS (SELECT doc_id, n_chars, coalesce(array_to_string(x[1:2], ' '), '') AS e FROM b)
SELECT doc_id, CASE WHEN length(e) <= 100 THEN e ELSE rtrim(substr(e, 1, 99)) || '…' END AS excerpt,
CASE WHEN n_chars < 1024 THEN n_chars || 'b' ELSE printf('%.1fk', n_chars / 1024) END AS size, n_chars || CASE WHEN n_chars = 1 THEN ' character' ELSE ' characters' END AS said FROM y""")
def excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt("text").alias("excerpt"), T.human_size("n_chars").alias("size"), digest.plural("n_chars", "character").alias("said"))


@query("""WITH s AS (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2031-01-01') - epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s >= 31536000 THEN s // 31536000 || 'y' WHEN s >= 2592000 THEN s // 2592000 || 'mo' WHEN s >= 86400 THEN s // 86400 || 'd' WHEN s >= 3600 THEN s // 3600 || 'h' ELSE s // 60 || 'm' END AS age FROM s""")
def ages(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    up = F.when(F.col("at") == F.col("ts").cast("timestamp"), F.col("at")).otherwise(F.col("at") + F.expr("interval 1 second"))
    return rows.select("event_id", T.age(up, F.lit("2031-01-01").cast("timestamp")).alias("age"))


@query(r"""SELECT DISTINCT p_name, p_type, trim(regexp_replace(regexp_replace(lower(p_name || ' *' || p_type || '*'), '[^a-z0-9\s/-]', '', 'g'), '\s+', '-', 'g'), '-') AS slug FROM part""")
def slugs(spark, d):
    return table(spark, d, "part").select("p_name", "p_type", T.slug(F.concat("p_name", F.lit(" *"), "p_type", F.lit("*"))).alias("slug")).distinct()


@query(f"WITH {VERSIONS_SQL} SELECT path, seq, sha, ts FROM v WHERE path = 7 ORDER BY seq DESC LIMIT 20")
def history_log(spark, d):
    return history.log(_versions(spark, d), 7)


@query(f"WITH {VERSIONS_SQL} SELECT CASE WHEN path = 7 THEN 70007 ELSE path END AS path, seq, sha, ts FROM v")
def history_rekey(spark, d):
    return history.rekey(_versions(spark, d), 7, 70007)


@query(f"""WITH {VERSIONS_SQL}, n AS (SELECT path, max(seq) AS seq FROM v GROUP BY 1), f AS (SELECT v.path, v.sha FROM v JOIN n USING (path, seq))
SELECT path, seq, sha, ts FROM v UNION ALL SELECT path, 1000000000 + path, 'click', NULL FROM f WHERE sha <> 'click'""")
def history_snapshot(spark, d):
    """Every path has the state click now; it is added where that is not the newest version."""
    v = _versions(spark, d)
    fresh = v.select("path").distinct().select("path", (F.col("path") + 1000000000).alias("seq"), F.lit("click").alias("sha"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    return history.snapshot(v, fresh)


@query(f"""WITH {VERSIONS_SQL}, n AS (SELECT path, arg_max(sha, seq) AS now FROM v GROUP BY 1) SELECT v.path, max(seq) AS seq, arg_max(sha, seq) AS sha FROM v JOIN n ON n.path = v.path AND v.sha <> n.now GROUP BY 1""")
def history_undo_targets(spark, d):
    """The newest version of each path that differs from its present state."""
    v = _versions(spark, d)
    now = history.latest(v).select("path", F.col("sha").alias("_now"))
    return history.latest(v.join(now, "path").filter("sha != _now").select("path", "seq", "sha"))


@query(f"""WITH {VERSIONS_SQL}, g AS (SELECT path, seq, sha FROM v QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) <= 2)
SELECT 'version' AS kind, path || ':' || seq AS item FROM g UNION ALL SELECT 'blob', sha FROM (SELECT DISTINCT sha FROM v) WHERE sha IN (SELECT sha FROM g)
UNION ALL SELECT 'embedding', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)""")
def history_gc(spark, d):
    v = _versions(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("embed_sha"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("embed_sha"))
    kept, blobs, left = history.collect_garbage(v, v.select("sha").distinct(), vectors, chunks, 2)
    out = kept.select(F.lit("version").alias("kind"), F.concat_ws(":", "path", "seq").alias("item"))
    return out.unionByName(blobs.select(F.lit("blob").alias("kind"), F.col("sha").alias("item"))).unionByName(left.select(F.lit("embedding").alias("kind"), F.col("embed_sha").alias("item")))


@query(r"SELECT doc_id, CAST(line AS INT) AS line, text, true AS match FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) WHERE regexp_matches(text, '^\w+ the ')")
def grep_line_start(spark, d):
    """A pattern that is bound to where a line begins."""
    return search.grep(table(spark, d, "documents"), r"\A\w+ the ")


@query()
def doc_chunks(spark, d):
    """Chunks of every document of the table as it is, long ones cut."""
    docs = table(spark, d, "documents").select(F.concat("doc_id", F.lit(".md")).alias("path"), "text")
    return markdown.chunk_rows(markdown.parse(docs)).drop("text")
