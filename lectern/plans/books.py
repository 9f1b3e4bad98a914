"""Structure, cleaning and quality queries. Outlines come from the event stream (a user is a book, events are entries in
order), trees from regions, nations and customers, pages from documents or conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import outline, scans, sections
from lectern.plans import sqltext as S
from lectern.plans.register import ORACLES, query
from lectern.sources import tables
from lectern.sources.tables import table

_TOC = "SELECT CAST(user_id AS VARCHAR) AS book_id, CAST(event_id AS INTEGER) AS toc_idx, CAST(1 + (event_id * 7 + user_id) % 4 AS INTEGER) AS level, event_type || ' ' || event_id AS title, CAST(event_id // 40 - 3 AS INTEGER) AS start_page FROM events"


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("book_id"),
        F.col("event_id").cast("int").alias("toc_idx"),
        (1 + (F.col("event_id") * 7 + F.col("user_id")) % 4).cast("int").alias("level"),
        F.concat_ws(" ", "event_type", "event_id").alias("title"),
        F.expr("cast(event_id div 40 - 3 as int)").alias("start_page"),
    )


@query(f"""
WITH toc AS ({_TOC}), last AS (SELECT book_id, max(start_page) - 1 AS last_page FROM toc GROUP BY ALL),
clamped AS (SELECT book_id, toc_idx, greatest(0, least(start_page, last_page)) AS start_page, last_page FROM toc JOIN last USING (book_id)),
ranged AS (SELECT *, greatest(start_page, least(coalesce(lead(start_page) OVER (PARTITION BY book_id ORDER BY toc_idx) - 1, last_page), last_page)) AS end_page FROM clamped)
SELECT book_id, toc_idx, CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page FROM ranged""")
def toc_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = toc(spark, sf_dir)
    last = entries.groupBy("book_id").agg((F.max("start_page") - 1).alias("last_page"))
    return outline.page_ranges(entries, last).select("book_id", "toc_idx", "start_page", "end_page")


@query(f"""
WITH toc AS ({_TOC})
SELECT t.book_id, t.toc_idx, (SELECT max(p.toc_idx) FROM toc p WHERE p.book_id = t.book_id AND p.toc_idx < t.toc_idx AND p.level < t.level) AS parent_idx FROM toc t""")
def nearest_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.parents(toc(spark, sf_dir)).select("book_id", "toc_idx", "parent_idx")


@query(f"""
WITH toc AS ({_TOC}),
c AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY toc_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM toc)
SELECT book_id, toc_idx, coalesce(before, CASE WHEN level = 1 THEN title END, 'Untitled Chapter') AS chapter,
       coalesce(CASE WHEN level = 1 THEN title END, before, 'Front Matter') AS block_chapter FROM c""")
def chapter_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = outline.chapters(outline.chapters(toc(spark, sf_dir), own_counts=True).withColumnRenamed("chapter", "block_chapter"))
    return both.select("book_id", "toc_idx", "chapter", "block_chapter")


_NODES = """
SELECT 'w' AS book_id, CASE WHEN r_regionkey = 0 THEN 'a' ELSE 'r' || r_regionkey END AS node_id, NULL AS parent_id, CAST(r_regionkey AS INTEGER) AS ord, r_name AS title FROM region
UNION ALL SELECT 'w', CASE WHEN n_nationkey = 3 THEN 'contents' ELSE 'n' || n_nationkey END, CASE WHEN n_regionkey = 0 THEN 'a' WHEN n_nationkey = 7 THEN 'gone' ELSE 'r' || n_regionkey END, CAST(n_nationkey AS INTEGER), n_name FROM nation
UNION ALL SELECT 'w', 'c' || c_custkey, CASE WHEN c_nationkey = 3 THEN 'contents' ELSE 'n' || c_nationkey END, CAST(c_custkey AS INTEGER), CASE WHEN c_custkey % 9 = 0 THEN 'Exercises ' || c_name ELSE c_name END FROM customer"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    return (
        r.selectExpr("'w' as book_id", "case when r_regionkey = 0 then 'a' else 'r' || r_regionkey end as node_id", "cast(null as string) as parent_id", "cast(r_regionkey as int) as ord", "r_name as title")
        .union(n.selectExpr("'w'", "case when n_nationkey = 3 then 'contents' else 'n' || n_nationkey end", "case when n_regionkey = 0 then 'a' when n_nationkey = 7 then 'gone' else 'r' || n_regionkey end", "cast(n_nationkey as int)", "n_name"))
        .union(c.selectExpr("'w'", "'c' || c_custkey", "case when c_nationkey = 3 then 'contents' else 'n' || c_nationkey end", "cast(c_custkey as int)", "case when c_custkey % 9 = 0 then 'Exercises ' || c_name else c_name end"))
    )


@query(f"WITH nodes AS ({_NODES}) SELECT k.parent_id, array_to_string(list(k.node_id ORDER BY k.ord, k.node_id), ' ') AS children FROM nodes k JOIN nodes p ON k.parent_id = p.node_id GROUP BY ALL")
def children_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.children(nodes(spark, sf_dir)).select("parent_id", F.array_join("children", " ").alias("children"))


@query(f"""
WITH RECURSIVE nodes AS ({_NODES}),
tree AS (
  SELECT node_id, title, title AS chapter_title, '' AS parent_title, lpad(ord || '', 6, '0') AS path FROM nodes n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT node_id FROM nodes)
  UNION ALL SELECT n.node_id, n.title, t.chapter_title, t.title, t.path || '.' || lpad(n.ord || '', 6, '0') FROM nodes n JOIN tree t ON n.parent_id = t.node_id)
SELECT node_id, title, chapter_title, parent_title, path, regexp_matches(title, '(?i)exercises|problems|summary') AS is_deprioritized
FROM tree WHERE NOT regexp_full_match(node_id, '[a-zA-Z]') AND node_id <> 'contents'""")
def flatten_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = outline.flatten(nodes(spark, sf_dir), depth=3)
    path = F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 6, "0")), ".")
    return flat.select("node_id", "title", "chapter_title", "parent_title", path.alias("path"), "is_deprioritized")


@query("""
SELECT CAST(e.conv_id AS VARCHAR) AS book_id, CAST(e.turn AS INTEGER) AS toc_idx, string_agg(p.text, chr(10) ORDER BY p.turn) AS text
FROM conversations e JOIN conversations p ON e.conv_id = p.conv_id AND p.turn BETWEEN e.turn AND e.turn + 2 GROUP BY ALL""")
def range_join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").cast("int").alias("page"), "text")
    entries = pages.select("book_id", F.col("page").alias("toc_idx"), F.col("page").alias("start_page"), (F.col("page") + 2).alias("end_page"))
    return sections.range_text(entries, pages)


_REPEATS = f"""
pages AS (SELECT source AS book_id, doc_id AS page, text, {S.lines("text")} AS l FROM documents),
margins AS (SELECT DISTINCT book_id, page, line FROM (SELECT book_id, page, {S.normal_line("raw")} AS line FROM (SELECT book_id, page, unnest(l[1:3] || l[-3:]) AS raw FROM pages)) WHERE length(line) >= 3),
totals AS (SELECT book_id, count(*) AS total FROM pages GROUP BY ALL HAVING count(*) >= 5),
repeating AS (SELECT book_id, line, count(*) AS n_pages FROM margins JOIN totals USING (book_id) GROUP BY book_id, line, total HAVING count(*) >= total * 0.1)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page"), "text")


@query(f"WITH {_REPEATS} SELECT * FROM repeating")
def repeating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.repeating_lines(pages(spark, sf_dir), ratio=0.1)


@query(f"""WITH {_REPEATS}, drops AS (SELECT book_id, list(line) AS d FROM repeating GROUP BY ALL)
SELECT page, CASE WHEN d IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x: NOT list_contains(d, {S.normal_line("x")})), chr(10)) END AS text FROM pages LEFT JOIN drops USING (book_id)""")
def strip_repeating(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return sections.strip_repeating(p, sections.repeating_lines(p, ratio=0.1)).select("page", "text")


@query("""
WITH sized AS (SELECT source AS book_id, doc_id AS section_id, length(text) AS n_chars FROM documents), m AS (SELECT book_id, median(n_chars) AS median FROM sized GROUP BY ALL)
SELECT book_id, section_id, n_chars, round(n_chars / median, 2) AS ratio, CASE WHEN n_chars / median > 3.0 THEN 'long' ELSE 'short' END AS kind
FROM sized JOIN m USING (book_id) WHERE median > 0 AND (n_chars / median > 3.0 OR n_chars / median < 0.15)""")
def length_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.length_outliers(pages(spark, sf_dir).withColumnRenamed("page", "section_id"))


@query(f"SELECT book_id, '[' || section_id || '] ' || kind || ': ' || n_chars || ' chars (' || ratio || ' x median)' AS line FROM ({ORACLES['length_outliers']})")
def qa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = length_outliers(spark, sf_dir)
    return tables.qa_report(found.withColumn("section_id", F.col("section_id").cast("string")))


_SCAN = """
pages AS (SELECT user_id AS book_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS page, CASE user_id % 3 WHEN 0 THEN props || ' ' || props || ' ' || props WHEN 1 THEN event_type || ' ' ELSE left(event_type, 2) END AS text FROM events),
sampled AS (SELECT p.*, n FROM pages p JOIN (SELECT book_id, count(*) AS n FROM pages GROUP BY ALL) USING (book_id)
            WHERE n <= 15 OR page < 5 OR (page >= n // 2 - 2 AND page < n // 2 + 3) OR page >= n - 5)"""


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.expr("CASE user_id % 3 WHEN 0 THEN concat_ws(' ', props, props, props) WHEN 1 THEN concat(event_type, ' ') ELSE left(event_type, 2) END")
    page = F.expr("row_number() over (partition by user_id order by event_id) - 1")
    return e.select(F.col("user_id").alias("book_id"), page.cast("long").alias("page"), text.alias("text"))


@query(f"WITH {_SCAN} SELECT book_id, page FROM sampled")
def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.sample_pages(scan_pages(spark, sf_dir)).select("book_id", "page")


@query(f"""WITH {_SCAN}
SELECT book_id, CASE WHEN avg(length(trim(text))) < 25 THEN 'scanned' ELSE 'text' END AS classification, avg(length(trim(text))) < 5 AS needs_force_ocr, round(avg(length(trim(text))), 1) AS avg_chars_per_page, any_value(n) AS total_pages, count(*) AS pages_sampled FROM sampled GROUP BY book_id""")
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.classify(scan_pages(spark, sf_dir))


@query("""
SELECT book_id, CAST(c AS INTEGER) AS chunk, c * 50 AS first_page, least((c + 1) * 50, n) - 1 AS last_page
FROM (SELECT user_id AS book_id, count(*) AS n, unnest(range((count(*) + 49) // 50)) AS c FROM events GROUP BY user_id)""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.chunk_plan(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("book_id")).agg(F.count("*").alias("total_pages")))


_STATUS = "CASE WHEN o_custkey % 10 = 0 OR o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'success' ELSE 'cached' END"


@query(f"""
SELECT book_id, count(*) FILTER (s = 'success') AS n_success, count(*) FILTER (s = 'cached') AS n_cached, count(*) FILTER (s = 'failed') AS n_failed, count(*) FILTER (s = 'failed') = count(*) AS all_failed
FROM (SELECT o_custkey AS book_id, {_STATUS} AS s FROM orders) GROUP BY book_id""")
def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.chunk_states(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.expr(_STATUS).alias("status")))


@query(f"""SELECT o_custkey AS book_id, o_orderkey AS chunk FROM orders WHERE {_STATUS} = 'failed'""")
def chunks_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chunk"), F.expr(_STATUS).alias("status"))
    return scans.pending(states.select("book_id", "chunk"), states)


@query()
def merge_tiny_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a book, a turn a section; its parent is the turn before."""
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat(F.lit("t"), t)
    own = c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), name(F.col("turn")).alias("section_id"), (1 + F.col("turn") % 3).cast("int").alias("level"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"), "text")
    return sections.merge_tiny(own, below=200)


@query("""SELECT CAST(conv_id AS VARCHAR) AS book_id, kind, count(*) AS n, max(r) AS last FROM (
  SELECT conv_id, role AS kind, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) GROUP BY ALL""")
def numbered_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.lit("s").alias("section_id"), F.col("role").alias("kind"), F.col("turn").alias("pos"))
    return sections.number_in_section(c).groupBy("book_id", "kind").agg(F.count("*").alias("n"), F.max("n").alias("last"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS book_id, o_orderpriority AS section_id, count(*) FILTER (o_orderstatus = 'F') AS n_raster, count(*) FILTER (o_orderstatus = 'O') AS n_diagram, count(*) FILTER (o_orderstatus = 'P') AS n_equation FROM orders GROUP BY ALL""")
def visual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE o_orderstatus WHEN 'F' THEN 'raster' WHEN 'O' THEN 'diagram' WHEN 'P' THEN 'equation' END")
    return sections.visual_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("book_id"), F.col("o_orderpriority").alias("section_id"), kind.alias("kind")))
