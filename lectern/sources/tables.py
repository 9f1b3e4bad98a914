"""Reading and writing what operators exchange. Paths go to Spark's readers, so any store that Spark reaches will do."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern import schemas
from lectern.functions import text as X


#: Rows of a batch that a parser's results go back in.
ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def sections_json(spark: SparkSession, path: str, book_id: str) -> DataFrame:
    """A folder with one JSON document a section; rows carry ord, their place by start_page (missing: 0), then by id. A
    folder that isn't there has no sections; a document that isn't JSON is left out."""
    try:
        raw = spark.read.schema(schemas.SECTION).option("multiLine", True).option("mode", "DROPMALFORMED").json(path, pathGlobFilter="*.json")
    except AnalysisException as e:
        if not _missing(e):
            raise
        raw = spark.createDataFrame([], schemas.SECTION)
    order = Window.partitionBy("book_id").orderBy(F.coalesce("start_page", F.lit(0)), "section_id")
    return raw.withColumn("book_id", F.lit(book_id)).withColumn("ord", (F.row_number().over(order) - 1).cast("int"))


def section(sections: DataFrame, book_id: str, section_id: str) -> DataFrame:
    """One section; raises LookupError if there is none."""
    found = sections.where((F.col("book_id") == book_id) & (F.col("section_id") == section_id))
    if found.isEmpty():
        raise LookupError(f"no section {section_id!r} in {book_id!r}")
    return found


def sections_by_id(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (q_id, ids) to the sections in the order asked for (pos); unknown ids are passed over."""
    return wanted.select("q_id", F.posexplode("ids").alias("pos", "section_id")).join(sections, "section_id")


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """Question sets, a JSON array a book; book_id is the file's name."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return spark.read.schema(schemas.QUESTION).option("multiLine", True).json(path, pathGlobFilter="*.json").withColumn("book_id", X.book_name(stem))


def confusable_json(spark: SparkSession, path: str) -> DataFrame:
    """Pairs as written; none where the file is missing or broken."""
    try:
        return spark.read.schema(schemas.CONFUSABLE_PAIR).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schemas.CONFUSABLE_PAIR)


def block_texts(spark: SparkSession, path: str) -> DataFrame:
    """Recognised block trees as texts (book_id, part, json), one part a file in order of name, for blocks.flatten()."""
    raw = spark.read.option("wholetext", True).text(path, pathGlobFilter="*.json", recursiveFileLookup=True).withColumn("f", F.input_file_name())
    book = F.element_at(F.split("f", "/"), -2)
    return raw.select(book.alias("book_id"), (F.dense_rank().over(Window.partitionBy(book).orderBy("f")) - 1).cast("int").alias("part"), F.col("value").alias("json"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """book_id, display_name, path, content of the PDF files below a folder; content is read only where it's used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    return files.select(X.book_name(stem).alias("book_id"), X.display_name(X.book_name(stem)).alias("display_name"), "path", "content")


def parsed(files: DataFrame, make_parser: Callable[[], Callable[[bytes], Iterable[tuple]]], schema: str) -> DataFrame:
    """Pages, spans, bookmarks or images of files (book_id, content), as schema has them after its first column, book_id.

    The parser, made once a task, takes a file's bytes and gives tuples. Whatever it raises is that file's error: a row with
    book_id and error alone, and no others of that file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = make_parser()
        for batch in batches:
            for book, content in zip(batch["book_id"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = [(book, *x, None) for x in parser(content.as_py())]
                except Exception as e:  # noqa: BLE001  one file's failure, of any kind, is its own
                    rows = [(book, *[None] * (len(kinds) - 2), f"{type(e).__name__}: {e}")]
                for at in range(0, len(rows), ROWS):
                    yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows[at : at + ROWS], strict=True), kinds, strict=True)], names=[k.name for k in kinds])

    ddl = f"{schema}, error string"
    kinds = list(to_arrow_schema(files.sparkSession.createDataFrame([], ddl).schema))
    return files.select("book_id", "content").mapInArrow(run, ddl)


def image_data_urls(files: DataFrame, kind: str = "png") -> DataFrame:
    return files.select("path", F.concat(F.lit(f"data:image/{kind};base64,"), F.base64("content")).alias("url"))


def within(root: str, path: str = "path"):
    """A relative path that stays below root: resolved without touching any disk."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("least")))
    safe = ~F.col(path).startswith("/") & (depth["least"] >= 0) & (depth["at"] > 0)
    return F.when(safe, F.concat(F.lit(root.rstrip("/") + "/"), F.col(path)))


def write_sections(sections: DataFrame, path: str) -> None:
    """Sections by book; books that are written replace what was there, others stay (dynamic overwrite)."""
    sections.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def write_index(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Confusable pairs, evaluation results, misses: always overwritten, an empty result too."""
    df.write.mode("overwrite").json(path)


def qa_report(outliers: DataFrame) -> DataFrame:
    """A line of text an outlier."""
    return outliers.select("book_id", F.format_string("[%s] %s: %d chars (%s x median)", "section_id", "kind", "n_chars", F.col("ratio").cast("string")).alias("line"))
