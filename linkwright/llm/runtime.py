"""Session settings, shared intermediate tables and column helpers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode without one, as in tests, a folder of this machine is made; on
    a cluster that raises ValueError, as executors would write where nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes (one long text may be more), frees shuffle files when a statement ends (results are held in written tables), and lets
    Python workers on this machine import the package; a cluster has it installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/linkwright-{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns a scan of it: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that no later step reads."""
    for name in df.inputFiles()[:1]:
        for spark, path in _written:
            if path.rpartition("/")[2] in name:
                remove(spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            remove(spark, path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table; texts that lie in fewer partitions than there are cores, as in one small file, are spread over all."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table == "documents" and df.rdd.getNumPartitions() < cores else df


#: The 26 letters that contracts lower-case, and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column):
    return F.translate(column, UPPER, UPPER.lower())


def fold_of(doc_id):
    """crc32 of doc_id as text, mod 5; 0 is held out of every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_sample(docs: DataFrame, labelled: DataFrame, rows: int) -> DataFrame:
    """(labelled's columns, text) of at most `rows` labelled documents outside the held-out fold.

    The sample is the `rows` smallest hashes of doc_id, so it is the same on every run. labelled holds doc_id and label
    columns, a row per doc_id. Only ids and labels are ranked; the join that fetches texts broadcasts at most `rows` ids. Where a
    doc_id repeats, its distinct texts are samples each, and the `rows` smallest hashes of them all are taken.
    """
    picked = labelled.where(fold_of(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return found
    found = found.dropDuplicates(["doc_id", "text"]).withColumn("text_hash", F.xxhash64("text"))
    picked = found.select("doc_id", "text_hash").orderBy("text_hash", "doc_id").limit(rows).distinct()
    return found.join(F.broadcast(picked), ["doc_id", "text_hash"]).drop("text_hash")
