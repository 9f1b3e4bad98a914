"""Layout queries: spans, blocks, drawings and captions made from the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import blocks, outline, visuals
from lectern.plans.register import query
from lectern.plans.sqltext import strip_html
from lectern.sources.tables import table

_SPANS = """SELECT user_id AS book_id, CAST(event_id // 100 AS INTEGER) AS page, 0 AS block, CAST(event_id // 2 AS INTEGER) AS line, CAST(event_id % 2 AS INTEGER) AS span,
  CASE event_type WHEN 'error' THEN ' 3 ' || event_type || '  ' ELSE event_type END AS text, 8 + (event_id % 23) * 0.25 AS size, CASE WHEN event_type = 'click' THEN 20 ELSE 4 END AS flags,
  CASE event_id % 5 WHEN 0 THEN 'CMMI10' WHEN 1 THEN 'Arial-Black' ELSE 'Times' END AS font FROM events"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "user_id as book_id", "cast(event_id div 100 as int) as page", "0 as block", "cast(event_id div 2 as int) as line", "cast(event_id % 2 as int) as span",
        "case event_type when 'error' then ' 3 ' || event_type || '  ' else event_type end as text", "cast(8 + (event_id % 23) * 0.25 as double) as size", "case when event_type = 'click' then 20 else 4 end as flags",
        "case event_id % 5 when 0 then 'CMMI10' when 1 then 'Arial-Black' else 'Times' end as font",
    )


_BODY = f"""spans AS ({_SPANS}), sized AS (SELECT *, round(CAST(size AS DOUBLE) * 2) / 2 AS half FROM spans),
per AS (SELECT book_id, half, CAST(sum(length(text)) AS BIGINT) AS chars, min(page::BIGINT * 1000000000 + line * 10 + span) AS seen FROM sized GROUP BY ALL),
body AS (SELECT book_id, half AS body_size, chars FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chars DESC, seen) AS r FROM per) WHERE r = 1)"""


@query(f"WITH {_BODY} SELECT book_id, body_size, chars FROM body")
def body_font_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.body_size(spans(spark, sf_dir))


@query(f"""WITH {_BODY},
big AS (SELECT s.*, size / body_size AS ratio FROM spans s JOIN body USING (book_id)),
heads AS (SELECT book_id, page, line, string_agg(text, ' ' ORDER BY span) AS raw, max(ratio) AS ratio FROM big
          WHERE ratio >= 1.2 OR ((flags & 16 <> 0 OR regexp_matches(lower(font), 'bold|black|heavy')) AND ratio >= 1.05) GROUP BY ALL)
SELECT book_id, page, line, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS title, CAST(CASE WHEN ratio >= 1.6 THEN 1 WHEN ratio >= 1.3 THEN 2 ELSE 3 END AS INTEGER) AS level FROM heads""")
def font_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.font_headings(spans(spark, sf_dir)).select("book_id", "page", "line", "title", "level")


@query(f"""WITH spans AS ({_SPANS}),
per AS (SELECT book_id, page, line, string_agg(text, '' ORDER BY span) AS text, sum(length(trim(text))) AS chars, sum(CASE WHEN font = 'CMMI10' THEN length(trim(text)) ELSE 0 END) AS m FROM spans GROUP BY ALL)
SELECT book_id, page, line, text FROM per WHERE m / chars > 0.5""")
def math_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visuals.math_lines(spans(spark, sf_dir)).select("book_id", "page", "line", "text")


@query("""
WITH b AS (SELECT user_id AS book_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'SectionHeader' WHEN 'purchase' THEN 'Table' WHEN 'click' THEN 'Text' WHEN 'view' THEN 'Picture' ELSE 'Equation' END AS kind,
             CASE WHEN event_type = 'signup' OR event_id % 4 > 0 THEN CAST(event_id // 50 AS INTEGER) END AS page, CAST(1 + event_id % 3 AS INTEGER) AS level, event_type || ' ' || props AS text FROM events),
n AS (SELECT *, count(*) FILTER (kind = 'SectionHeader') OVER (PARTITION BY book_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section_no FROM b),
g AS (SELECT book_id, section_no, CASE WHEN section_no = 0 THEN 'Front Matter' ELSE min_by(text, seq) END AS title, CASE WHEN section_no = 0 THEN 1 ELSE min_by(level, seq) END AS level,
        CASE WHEN section_no = 0 THEN 0 ELSE min_by(page, seq) END AS start_page, max(page) AS max_page, min_by(page, seq) AS head,
        coalesce(string_agg(CASE WHEN kind = 'Table' THEN chr(10) || '[Table]' || chr(10) || text || chr(10) WHEN kind IN ('Text', 'Equation') THEN text END, chr(10) ORDER BY seq), '') AS text,
        count(*) FILTER (kind = 'Picture') AS n_images, count(*) FILTER (kind = 'Equation') AS n_equations FROM n GROUP BY book_id, section_no)
SELECT book_id, section_no, title, level, start_page, greatest(start_page, max_page, coalesce(lead(head) OVER (PARTITION BY book_id ORDER BY section_no), start_page)) AS end_page,
  regexp_replace(text, '^\\s+|\\s+\\z', '', 'g') AS text, n_images, n_equations FROM g""")
def sectionize_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    own = e.selectExpr(
        "user_id as book_id", "event_id as seq",
        "case event_type when 'signup' then 'SectionHeader' when 'purchase' then 'Table' when 'click' then 'Text' when 'view' then 'Picture' else 'Equation' end as block_type",
        "case when event_type = 'signup' or event_id % 4 > 0 then cast(event_id div 50 as int) end as page", "cast(1 + event_id % 3 as int) as level", "event_type || ' ' || props as text",
    )
    return blocks.sectionize(own)


@query(rf"""
WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, turn, coalesce(text, '') AS html, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS seq FROM conversations)
SELECT DISTINCT book_id, 0::BIGINT AS seq, 'ListGroup' AS block_type, NULL::INTEGER AS page, 2 AS level, '' AS text FROM c
UNION ALL SELECT book_id, seq, 'ListItem', CAST(turn AS INTEGER), coalesce(CAST(nullif(regexp_extract(html, '<[hH](\d)', 1), '') AS INTEGER), 2), {strip_html("html")} FROM c""")
def flatten_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a tree: a page with a list of its turns."""
    block = F.to_json(F.named_struct(F.lit("block_type"), F.lit("ListItem"), F.lit("id"), F.concat(F.lit("/page/"), "turn"), F.lit("html"), F.col("text")))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("book_id")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("l"))
    tree = F.concat(F.lit('{"children": [{"type": "ListGroup", "children": ['), F.array_join(F.transform("l", lambda x: x["b"]), ", "), F.lit("]}]}"))
    return blocks.read_blocks(blocks.flatten(c.select("book_id", F.lit(0).alias("part"), tree.alias("json"))))


@query("""
SELECT o_orderkey, o_custkey AS book_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1 AND o_orderkey % 101 >= 50""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderstatus").alias("xref"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 101).alias("width"), F.lit(80).alias("height"))
    return visuals.first_images(o).select(F.col("pos").alias("o_orderkey"), "book_id")


_RECT = "CAST(o_custkey AS VARCHAR) AS book_id, 0 AS page, CAST(o_orderkey AS INTEGER) AS idx, CAST(o_orderkey % 500 AS DOUBLE) AS x0, CAST(o_orderkey % 700 AS DOUBLE) AS y0, CAST(o_orderkey % 500 + 10 + o_orderkey % 90 AS DOUBLE) AS x1, CAST(o_orderkey % 700 + 20 AS DOUBLE) AS y1"


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_RECT.replace("VARCHAR", "STRING").split(", "))


@query()
def cluster_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visuals.cluster_rects(rects(spark, sf_dir))


@query(f"""
WITH r AS (SELECT {_RECT} FROM orders), l AS (SELECT book_id, idx, idx % 3 = 0 AS labelled, y0 + 100 AS y0, y0 + 110 AS y1 FROM r),
n AS (SELECT r.book_id, r.idx, min_by('Fig. ' || l.idx || '.1a', l.idx) AS caption FROM r JOIN l ON labelled AND r.book_id = l.book_id AND least(abs(l.y0 - r.y1), abs(r.y0 - l.y1)) <= 50 GROUP BY ALL)
SELECT r.book_id, r.idx, caption FROM r LEFT JOIN n USING (book_id, idx)""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rects(spark, sf_dir)
    text = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("x Fig. "), "idx", F.lit(".1a y"))).otherwise("plain words")
    text_lines = r.select("book_id", "page", F.col("idx").alias("pos"), text.alias("text"), (F.col("y0") + 100).alias("y0"), (F.col("y0") + 110).alias("y1"))
    return visuals.nearest_caption(r.withColumnRenamed("idx", "cluster"), text_lines).select("book_id", F.col("cluster").alias("idx"), "caption")


@query("""
SELECT o_custkey AS q_id, o_orderkey AS pos, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderstatus <> 'F' AS INTEGER) ELSE 0 END, o_orderkey % 5, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderkey) AS r
  FROM orders WHERE o_totalprice <= 200000) WHERE r <= 2""")
def visual_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("q_id"), F.when(F.col("o_custkey") % 2 == 0, "Calculate it").otherwise("Tell me").alias("question"), (F.col("o_orderkey") % 5).alias("section_pos"),
        F.when(F.col("o_orderstatus") == "F", "equation").otherwise("figure").alias("kind"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("size"),
    )
    return visuals.select_visuals(o, n=2, max_bytes=200_000).select("q_id", "pos", "rank")


@query("""
SELECT o_orderkey AS section_id, kind, i - 1 AS pos, kind || i || '.png' AS path
FROM (SELECT o_orderkey, unnest(range(1, o_custkey % 3 + 1)) AS i, 'figure' AS kind FROM orders UNION ALL SELECT o_orderkey, unnest(range(1, o_custkey % 2 + 1)), 'equation' FROM orders)""")
def visual_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with up to two figures and an equation, and such as have none."""

    def some(kind: str, n: int):
        numbers = F.when(F.col("o_custkey") % n > 0, F.sequence(F.lit(1), (F.col("o_custkey") % n).cast("int")))
        return F.transform(numbers, lambda i: F.struct(F.concat(F.lit(kind), i, F.lit(".png")).alias("path")))

    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id"), some("figure", 3).alias("images"), some("equation", 2).alias("equations"))
    return visuals.entries(s).withColumn("pos", F.col("pos").cast("long"))


@query("""
SELECT o_custkey AS book_id, o_orderkey AS part, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1 THEN '' ELSE 'part_' || o_orderkey || '_' END || o_orderpriority || '.png' AS file FROM orders""")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("part"), F.concat("o_orderpriority", F.lit(".png")).alias("name"))
    return blocks.image_names(o).drop("name")
