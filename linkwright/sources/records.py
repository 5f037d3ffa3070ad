"""Readers and writers of records, id lists and pairs. Schemas are explicit and all text is read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sampling import drawn
from ..functions.text import id_list

RAW = "entity_id string, business_name string, business_address string, country string"
LISTS = "source1_entity_id string, ids string"
#: Texts that a raw file means as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _tsv(spark: SparkSession, paths, schema: str) -> DataFrame:
    return spark.read.csv(paths, schema=schema, sep="\t", header=True, quote='"', escape='"', nullValue="\0", emptyValue="")


def read_raw(spark: SparkSession, paths) -> DataFrame:
    """Raw records of one or more files; the usual spellings of a missing value become null in name and address."""
    known = lambda c: F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c)
    return _tsv(spark, paths, RAW).select("entity_id", known("business_name"), known("business_address"), "country")


def read_source(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Normalised records, Parquet or tab-separated by the path's ending; nulls as '', country trimmed and in lower case."""
    df = _tsv(spark, path, "entity_id string, clean_name string, core_name string, legal_suffix string, clean_address string, country string, postal_code string") if path.endswith((".tsv", ".csv")) else spark.read.parquet(path)
    return df.select(*(columns or df.columns)).fillna("").withColumn("country", F.lower(F.trim("country")))


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(q, t) of an id-list file: truth, candidates or matches."""
    return exploded(_tsv(spark, path, LISTS))


def exploded(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("source1_entity_id").alias("q"), F.explode(id_list("ids")).alias("t"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids in the first column, blanks left out."""
    return _tsv(spark, path, "id string").where(F.trim(F.coalesce("id", F.lit(""))) != "").select("id").distinct()


def pairs_of_country(spark: SparkSession, path: str, country: str, columns: list[str]) -> DataFrame:
    """Projected scored pairs of one country; the filter prunes partitions of a table written by write_pairs."""
    return spark.read.parquet(path).where(F.col("country") == country).select(*columns)


def id_lists(queries: DataFrame, pairs: DataFrame, score: str) -> DataFrame:
    """(q, ids): a comma list for every query, best score first, ties by id; '' if there is none."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "t")))
    listed = pairs.groupBy("q").agg(F.array_join(F.transform(ordered, lambda x: x.t), ",").alias("ids"))
    return queries.select("q").join(listed, "q", "left").select("q", F.coalesce("ids", F.lit("")).alias("ids"))


def write_lists(lists: DataFrame, path: str, header: str = "matched_entity_ids") -> None:
    lists.toDF("source1_entity_id", header).write.csv(path, sep="\t", header=True, emptyValue="", quote="")


def write_records(df: DataFrame, path: str) -> None:
    df.write.partitionBy("country").parquet(path, compression="zstd")


def write_pairs(df: DataFrame, path: str) -> None:
    floats = [c for c, kind in df.dtypes if kind == "double"]
    df.withColumns({c: F.col(c).cast("float") for c in floats}).write.partitionBy("country").parquet(path, compression="zstd")


def validation_split(queries: DataFrame, truth: DataFrame, targets: DataFrame, n_queries: int, n_distractors: int, singleton_share: float = 0.056, seed: int = 42, on: str = "t") -> tuple[DataFrame, DataFrame]:
    """(queries, targets) of a small copy: that share of singletons, the rest matched, all their true targets and some others of each source.
    truth(q, on) and targets(t, on) meet by `on`: the target itself, or a class that true pairs share."""
    order = lambda c: (drawn(c, seed), c)
    matched = queries.join(truth, "q", "left_semi").orderBy(*order("q")).limit(round(n_queries * (1 - singleton_share)))
    single = queries.join(truth, "q", "left_anti").orderBy(*order("q")).limit(round(n_queries * singleton_share))
    picked = matched.unionByName(single)
    true = targets.join(truth.join(picked, "q", "left_semi"), on, "left_semi")
    other = targets.join(true, "t", "left_anti").orderBy(*order("t")).limit(n_distractors)
    return picked, true.unionByName(other).select("t")
