"""Exact duplicates by deterministic block naming, with DataFrame functions only.

Texts are cut into blocks of BLOCK characters. The distinct blocks are sorted and numbered, then adjacent pairs of names are
numbered in the same way, level by level, until each text has one integer name. Equal names mean equal texts: names stand for
contents, never for hashes of them. A text is left out of further levels as soon as no other text shares its name so far
(its length with the name of its first characters), as its identity is then settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, forget, tune, written

BLOCK = 2048
HEAD = 48


def named(contents: DataFrame, columns: list[str], tag: str) -> DataFrame:
    """The distinct rows of `columns` with an integer `name`. Rows are sorted in their partitions, so names follow the contents and not
    the order of arrival; which integers they are depends on the number of partitions, that they tell contents apart doesn't. The
    table is written, so names can't change afterwards."""
    ordered = contents.select(*columns).distinct().sortWithinPartitions(*columns)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), tag)


def _joined(left: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    return left.join(names, columns).drop(*columns)


def text_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """texts(row, text) -> (row, name): equal texts, and only they, have equal names. row is any key of a row."""
    count = F.greatest(F.ceil(F.length("text") / F.lit(float(block))), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    blocks = texts.select("row", F.posexplode(cut).alias("at", "block"))
    level = written(_joined(blocks, named(blocks, ["block"], "blocks"), ["block"]), "level")
    while True:
        deepest = level.agg(F.max("at")).first()[0]
        if not deepest:  # None: no rows
            return level.select("row", "name")
        side = lambda i: F.max(F.when(F.col("at") % 2 == i, F.col("name")))
        pairs = written(level.groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("half")).agg(side(0).alias("first"), F.coalesce(side(1), F.lit(-1)).alias("second")), "pairs")
        names = named(pairs, ["first", "second"], "names")
        forget(level)
        level = written(_joined(pairs, names, ["first", "second"]).withColumnRenamed("half", "at"), "level")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, text_sha256), a row for every row of docs.

    Texts are equal if identical after A-Z are lower-cased; null counts as empty. Of equal texts the row with the largest doc_id
    stays; a row without doc_id ranks below all others. Rows that repeat both doc_id and text share one identity: all of them count
    in group_size and show the same kept, and `deduplicated` keeps one. Other columns are ignored; an empty table gives none.
    text_sha256 only tells rows of one doc_id apart; groups are formed by names.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    start = docs.select("doc_id", F.length("text").alias("size"), F.substring("text", 1, head).alias("head"), F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))
    start = written(start, "start")
    # Level 0: length and first characters. Groups of one are settled.
    open_ = written(start.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1").select("size", "head"), "open")
    unsettled = start.join(open_, ["size", "head"], "left_semi").select("doc_id", "text_sha256").distinct()
    unsettled = written(unsettled, "unsettled")
    key = F.struct(F.col("doc_id"), F.col("text_sha256"))
    fetched = docs.join(unsettled.select("doc_id").distinct().withColumnRenamed("doc_id", "d").hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    fetched = fetched.withColumn("text_sha256", F.sha2(F.encode("text", "utf-8"), 256)).withColumn("row", key).select("row", "text")
    fetched = written(fetched, "fetched")
    if unsettled.count() < fetched.count():  # a doc_id repeats
        fetched = fetched.dropDuplicates(["row"])
    names = written(text_names(fetched, block).select(F.col("row.doc_id").alias("d"), F.col("row.text_sha256").alias("s"), "name"), "identity")
    match = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("s"))
    rows = written(start.select("doc_id", "text_sha256").join(names, match, "left").select("doc_id", "text_sha256", "name"), "rows")
    groups = written(rows.where("name is not null").groupBy("name").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")), "groups")
    for table in (start, open_, unsettled, fetched):
        forget(table)
    # Settled rows have no name; they go past the join, where they would be one key.
    result = rows.join(groups, "name").select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
    settled = rows.where("name is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return result.union(settled).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat doc_id and text, one.

    A null text equals an empty one. Of equal texts the row with the largest doc_id stays, one without doc_id only if all are. Other
    columns, whatever their names, come along and decide nothing. An empty table stays empty.
    """
    kept = exact_duplicates(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).toDF("kept_id", "kept_text", "times")
    kept = written(kept, "kept")
    sha = F.sha2(F.encode(ascii_lower(F.coalesce(docs["text"], F.lit(""))), "utf-8"), 256)
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (sha == kept["kept_text"]), "left_semi")
    if kept.where("times > 1").isEmpty():
        return rows
    name = "same_text" + "_" * max(map(len, docs.columns))  # no column of docs has it
    return rows.withColumn(name, sha).dropDuplicates(["doc_id", name]).drop(name)
