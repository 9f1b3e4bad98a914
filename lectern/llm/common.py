"""What the training-data operators share: table access, staging in the cluster's shared folder, shipping and word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of a batch that a Python worker has at once, unless the session says otherwise: it is held there several times over,
#: and again by the JVM.
BATCH_BYTES = 8 << 20
#: A value is frequent that more than so many rows have, and more than a share 1 / FREQUENT of all rows.
FEW, FREQUENT = 256, 10_000
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Separators of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ mapped to spaces, and A-Z to a-z, for bytes.translate.
ALNUM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


#: Workers are used again by later stages: what one frees should go back to the machine, not into pools.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def ship(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package; on a cluster it's installed or passed with --py-files.
    Bounds the batches that they get, once for the session."""
    env = spark.sparkContext.environment
    env.update({k: v for k, v in WORKER_ENV.items() if k not in env})
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session (tests, say) gets one of its own; executors
    elsewhere would not share it, so a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that lost executors cost no recomputation and
    non-deterministic columns (partition numbers, row ids) are the same for all readers."""
    path = f"{shared_dir(df.sparkSession)}/lectern/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*staged_: DataFrame) -> None:
    """Deletes what staged() wrote, once nothing reads it any more."""
    for df in staged_:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(df._staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ranged(df: DataFrame, label: str, *keys: Column) -> DataFrame:
    """df staged in the order of keys over range partitions, sorted within them, with their numbers as ``part``. The keys
    should tell rows apart, so that a boundary can fall between any two."""
    dealt = df.repartitionByRange(parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return staged(dealt.withColumn("part", F.spark_partition_id()), label)


def bases(df: DataFrame, **sums: Column) -> DataFrame:
    """part, and for each sum x of the rows of a part (see ranged): x, x_base (over the parts before it) and x_all. A row a
    part, so it may be broadcast."""
    totals = df.groupBy("part").agg(*[c.alias(x) for x, c in sums.items()])
    earlier, whole = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    out = [c for x in sums for c in (x, F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_base"), F.sum(x).over(whole).alias(f"{x}_all"))]
    return totals.select("part", *out)


def spread(rows: DataFrame, keys: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """rows.join(keys, by, how), where keys has one row a value at most and any number of rows may have the same one. For
    values that many rows have, keys go to the rows; each has at least a share 1 / FREQUENT of them, so there are at most
    FREQUENT. rows should be cheap to read again. how: inner or left."""
    often = max(FEW, rows.count() // FREQUENT)
    hot = [r[0] for r in rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("m")).where(F.col("m") > often).select(by).collect()]  # at most FREQUENT values
    if not hot:
        return rows.join(keys, by, how)
    frequent = F.coalesce(F.col(by).isin(*hot), F.lit(False))
    return rows.where(frequent).join(F.broadcast(keys.where(frequent)), by, how).unionByName(rows.where(~frequent).join(keys, by, how))


def wrapped(docs: DataFrame) -> DataFrame:
    """doc (all columns but text) and text: names of helper columns can't clash with those of docs."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select((F.struct(*[F.col(_quoted(c)) for c in rest]) if rest else F.lit(None).cast("string")).alias("doc"), "text")


def unwrapped(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of a table whose rows carry doc and text (see wrapped)."""
    return df.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def parts(spark: SparkSession) -> int:
    """Partitions for an exchange that is asked for by number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def thinned(df: DataFrame, total: int, want: int, *by: str) -> DataFrame:
    """About twice ``want`` of ``total`` rows, chosen by a hash, so that a sorted sample of ``want`` moves no more than that
    however many tasks there are. All rows where there are few."""
    every = max(1, total // (2 * want))
    return df.where(F.pmod(F.xxhash64(*by), F.lit(every)) == 0) if every > 1 else df


def blank_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ as an array."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")
