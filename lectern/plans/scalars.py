"""Scalar text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import outline, routing, visuals
from lectern.plans import sqltext as S
from lectern.plans.register import query
from lectern.sources.tables import table


@query(f"""
SELECT p_partkey, slug || CASE WHEN n = 1 THEN '' ELSE '-' || (n - 1) END AS section_id
FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) AS n
      FROM (SELECT p_partkey, p_brand, {S.slug("'Ch. ' || p_size % 3 || ': ' || p_name || '—!'")} AS slug FROM part))""")
def slugify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("title", F.concat(F.lit("Ch. "), F.col("p_size") % 3, F.lit(": "), "p_name", F.lit("—!")))
    return outline.unique_slugs(part, "p_brand", "p_partkey").select("p_partkey", "section_id")


@query(f"SELECT page_id, {S.strip_html('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html("html").alias("text"))


@query(f"SELECT line, count(*) AS n FROM (SELECT {S.normal_line('raw')} AS line FROM (SELECT unnest({S.lines('text')}) AS raw FROM documents)) WHERE length(line) >= 3 GROUP BY ALL")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = table(spark, sf_dir, "documents").select(F.explode(X.lines("text")).alias("raw")).select(X.normal_line("raw").alias("line"))
    return flat.where(F.length("line") >= 3).groupBy("line").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {S.abstract('text')} AS abstract FROM documents")
def text_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.abstract("text").alias("abstract"))


@query(f"SELECT doc_id, {S.snippet('text')} AS snippet FROM documents")
def catalog_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet("text").alias("snippet"))


@query(f"""
SELECT p_partkey, '[' || p_partkey || '] Chapter: ' || p_brand || ' | ' || title || CASE WHEN regexp_matches(title, '{X.SUPPLEMENTARY}') THEN ' [SUPPLEMENTARY]' ELSE '' END
       || chr(10) || '  Abstract: ' || {S.snippet("repeat(p_name || ' ', p_size)")} || CASE WHEN p_size % 2 = 0 THEN chr(10) || '  Keywords: ' || replace(p_name, ' ', ', ') ELSE '' END || chr(10) AS entry
FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'Solving Problems' ELSE p_name END AS title FROM part)""")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_partkey").alias("section_id"),
        F.col("p_brand").alias("chapter_title"),
        F.when(F.col("p_size") % 4 == 0, "Solving Problems").otherwise(F.col("p_name")).alias("title"),
        F.expr("repeat(concat(p_name, ' '), p_size)").alias("abstract"),
        F.when(F.col("p_size") % 2 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("tfidf_keywords"),
    )
    return part.withColumn("is_deprioritized", outline.supplementary("title")).select("p_partkey", routing.catalog_entry().alias("entry"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN (p_size + 1) || '' ELSE (p_size + 1) || '-' || (p_size + p_size % 3 + 1) END AS page_range,
  CASE WHEN p_size % 3 = 0 THEN 'p. ' || p_size ELSE 'pp. ' || p_size || '–' || (p_size + p_size % 3) END AS cited FROM part""")
def page_range_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.col("p_size") + F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", X.page_range("p_size", last).alias("page_range"), X.citation_pages("p_size", last).alias("cited"))


_HEADING = "CASE o_custkey % 7 WHEN 0 THEN o_custkey || '.2.1 Deep ' || o_orderpriority WHEN 1 THEN ' ' || o_custkey || '.4 Shallow' WHEN 2 THEN 'CHAPTER ' || o_custkey WHEN 3 THEN 'part 3' WHEN 4 THEN o_custkey || ' Alpha' WHEN 5 THEN o_custkey || ' b' ELSE o_orderpriority END"


@query(f"SELECT o_orderkey, CAST({S.heading_level('line')} AS INTEGER) AS level FROM (SELECT o_orderkey, {_HEADING} AS line FROM orders)")
def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_HEADING).alias("line")).select("o_orderkey", X.heading_level("line").alias("level"))


@query("""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority END AS answer FROM orders""")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_custkey % 3 WHEN 0 THEN concat(' <think>so\nand so</think>\n ', o_orderpriority) WHEN 1 THEN o_orderpriority ELSE concat('<think>', o_orderpriority) END")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.final_answer(raw).alias("answer"))


_RAW = """CASE o_custkey % 6
 WHEN 0 THEN '```json' || chr(10) || '{"sections": [{"section_id": "s' || o_custkey || '", "confidence": "high", "reason": "r"}, {"section_id": "t"}]}' || chr(10) || '```'
 WHEN 1 THEN '[{"section_id": "s' || o_custkey || '", "confidence": "low"}]'
 WHEN 2 THEN 'Sure. {"sections": [{"section_id": "s' || o_custkey || '", "reason": "why"}]} Done.'
 WHEN 3 THEN '{"sections": [{"confidence": "high"}]}' WHEN 4 THEN '{"answer": 1}' ELSE '' END"""


@query(rf"""
WITH raw AS (SELECT o_orderkey, {_RAW} AS s FROM orders),
clean AS (SELECT o_orderkey, CASE WHEN starts_with(s, '```') THEN regexp_replace(s, '^```(?:json)?\s*|\s*```\z', '', 'g') ELSE s END AS s FROM raw),
parsed AS (SELECT o_orderkey, coalesce(TRY_CAST(nullif(s, '') AS JSON), TRY_CAST(nullif(regexp_extract(s, '(?s)\{{.*\}}'), '') AS JSON)) AS j FROM clean),
picks AS (SELECT o_orderkey, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE json_extract(j, '$.sections[*]') END) AS p FROM parsed)
SELECT o_orderkey, p ->> 'section_id' AS section_id, coalesce(p ->> 'confidence', 'unknown') AS confidence, coalesce(p ->> 'reason', '') AS reason
FROM picks WHERE p ->> 'section_id' IS NOT NULL""")
def llm_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RAW).alias("raw"))
    return raw.select("o_orderkey", F.explode(routing.parse_picks("raw")).alias("p")).select("o_orderkey", "p.*")


_LINE = "CASE o_custkey % 4 WHEN 0 THEN 'E = mc (' || o_custkey || '.' || o_orderkey || ')  ' WHEN 1 THEN 'see fig ' || o_custkey || '.2b and on' WHEN 2 THEN 'FIGURE 3-' || o_custkey ELSE '(3.1) is not last' END"


@query(rf"SELECT o_orderkey, nullif(regexp_extract(line, '{X.EQUATION_NUMBER}', 1), '') AS equation, nullif(regexp_extract(line, '{X.FIGURE_CAPTION}', 1), '') AS figure FROM (SELECT o_orderkey, {_LINE} AS line FROM orders)")
def captions_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_LINE).alias("line")).select("o_orderkey", X.equation_label("line").alias("equation"), X.figure_number("line").alias("figure"))


@query(rf"""
SELECT conv_id, turn, array_to_string(w[1:6], ' ') || CASE WHEN len(w) > 6 THEN '…' ELSE '' END AS title
FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array({S.strip('text')}, '{X.SPACE}+'), lambda x: x <> '') AS w FROM conversations)""")
def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.short_title("text").alias("title"))


@query("SELECT p_partkey, replace(lower(replace(p_name, ' ', '-') || '-' || p_type), '-', '_') AS book_id FROM part")
def book_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", X.book_name(stem).alias("book_id"))


@query(r"""SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey AS INTEGER) END AS page, CAST(CASE o_custkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 1 + o_custkey % 4 ELSE 2 END AS INTEGER) AS level FROM orders""")
def block_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    block = F.expr("CASE WHEN o_custkey % 5 <> 0 THEN concat('/page/', o_custkey, '/SectionHeader/3') ELSE 'x' END")
    html = F.expr("CASE WHEN o_custkey % 3 = 1 THEN concat('<H', 1 + o_custkey % 4, '>t</H1>') ELSE '<p>t</p>' END")
    given = F.expr("CASE WHEN o_custkey % 3 = 0 THEN 7 END")
    return o.select("o_orderkey", X.block_page(block).alias("page"), X.block_level(html, given).alias("level"))


@query("""SELECT o_orderkey, (o_custkey % 3 = 0 OR o_custkey % 4 = 0) AS has_visuals, o_custkey % 5 = 0 AS computational, (o_custkey % 3 = 0 OR o_custkey % 4 = 0) AS attach, o_custkey % 5 = 0 AS asks_for_visuals,
  CASE o_custkey % 4 WHEN 0 THEN false WHEN 1 THEN false ELSE true END AS routable, 's' || o_custkey || '_fig_' || o_custkey || '-2.png' AS file FROM orders""")
def section_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ids = F.expr("CASE o_custkey % 4 WHEN 0 THEN 'q' WHEN 1 THEN 'contents' WHEN 2 THEN 'q2' ELSE '1' END")
    few = lambda k: F.when(F.col("o_custkey") % k == 0, F.array(F.lit(1)))
    asked = F.when(F.col("o_custkey") % 5 == 0, "Derive it").otherwise("Tell me")
    choice = visuals.attachment(asked, visuals.has_visuals(few(3), few(4)))
    return o.select(
        "o_orderkey", choice["has_visuals"].alias("has_visuals"), visuals.computational(asked).alias("computational"), choice["attach"].alias("attach"), choice["asks_for_visuals"].alias("asks_for_visuals"), outline.routable(ids).alias("routable"),
        X.visual_name(F.concat(F.lit("s"), "o_custkey"), "fig", F.concat("o_custkey", F.lit(".2"))).alias("file"),
    )
