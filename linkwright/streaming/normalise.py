"""Normalisation of a stream of raw records: a projection without state, so it is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import preprocess
from ..sources.records import RAW


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RAW).csv(path, sep="\t", header=True, quote='"', escape='"')


def normalised(stream: DataFrame, india: bool = True) -> DataFrame:
    return preprocess(stream, india)


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch to Parquet; files are committed once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
