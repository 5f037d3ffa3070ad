"""Both output files of a run, with statistics by country, and the checks that such files have to pass."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import id_lists, read_ids, write_lists

HEADERS = {"matching": "matched_entity_ids", "candidate": "candidate_entity_ids"}
FINDINGS = "file string, level string, rule string, n long, examples array<string>"
SHOWN = 5


def output_statistics(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """queries(q, country), pairs(q, t, selected) -> a row per country: queries with candidates and without, pairs, share of empty
    predictions and mean matches among queries with candidates."""
    per = queries.select("q", "country").distinct().join(pairs.groupBy("q").agg(F.count("*").alias("n"), F.count_if("selected").alias("m")), "q", "left")
    has = F.col("n").isNotNull()
    return per.groupBy("country").agg(F.count_if(has).alias("queries"), F.count_if(~has).alias("without_candidates"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.avg(F.when(has, (F.col("m") == 0).cast("double"))).alias("predicted_empty_share"), F.avg("m").alias("mean_matches"))


def write_outputs(queries: DataFrame, pairs: DataFrame, matching: str, candidate: str, score: str = "p") -> DataFrame:
    """Writes a row for every query to both folders, selected pairs to one and all to the other, best first; returns the statistics."""
    pairs = pairs.select("q", F.col("t").cast("string").alias("t"), score, "selected")
    write_lists(id_lists(queries.select("q").distinct(), pairs.where("selected"), score), matching)
    write_lists(id_lists(queries.select("q").distinct(), pairs, score), candidate, HEADERS["candidate"])
    return output_statistics(queries, pairs)


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException:  # no such path
        return None


def check_file(spark: SparkSession, path: str, kind: str, required: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(findings, lists(id, ids) or null) of one output. A file that is missing, empty or has another header is one error and read no
    further. Every rule is one error with a count and a few examples; unknown ids are looked for if `known` is given."""
    error = lambda rule: spark.createDataFrame([(kind, "error", rule, 1, [path])], FINDINGS)
    lines = _lines(spark, path)
    if lines is None:
        return error("file not found"), None
    head = lines.limit(1).collect()
    if not head:
        return error("file is empty"), None
    if "\t" not in head[0][0]:
        return error("comma-separated" if "," in head[0][0] else "unexpected header"), None
    header = [c.strip().lower() for c in head[0][0].split("\t")]
    if header != ["source1_entity_id", HEADERS[kind]]:
        return error("unexpected header"), None
    rows = lines.where((F.col("value") != head[0][0]) & (F.trim("value") != ""))
    tab = F.instr("value", "\t")
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    lists = rows.where(tab > 0).select(F.substring_index("value", "\t", 1).alias("id"), ids.alias("ids"))
    malformed = rows.where(tab == 0).select(F.lit("malformed row").alias("rule"), F.col("value").alias("x"))
    return _summed(malformed.union(offenders(lists, required, known)), kind, "error"), lists


def offenders(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, x): each id that breaks a rule, from one pass over rows, one over listed ids, and joins for what other tables know."""
    by_row = lists.groupBy("id").agg(F.count("*").alias("n"), F.max((F.size(F.array_distinct("ids")) < F.size("ids")).cast("int")).alias("repeats"))
    marked = by_row.join(required.select("id").distinct().withColumn("asked", F.lit(1)), "id", "full")
    rules = F.array(*(F.when(c, F.lit(rule)) for rule, c in (("duplicate rows", F.col("n") > 1), ("repeated ids", F.col("repeats") == 1), ("missing query", F.col("n").isNull()), ("extra query", F.col("asked").isNull()))))
    found = marked.select(F.explode(F.array_compact(rules)).alias("rule"), F.col("id").alias("x"))
    listed = lists.select(F.explode("ids").alias("x")).distinct()
    form = F.when(F.col("x").startswith("S1-"), "self match").when(~F.col("x").rlike("^S[23]-"), "wrong prefix")
    found = found.union(listed.select(form.alias("rule"), "x").where("rule is not null"))
    if known is not None:
        found = found.union(listed.where(form.isNull()).join(known.select(F.col("id").alias("x")), "x", "left_anti").select(F.lit("unknown id"), "x"))
    return found


def _summed(found: DataFrame, kind: str, level: str) -> DataFrame:
    few = F.slice(F.array_sort(F.collect_list("x")), 1, SHOWN)
    one = found.withColumn("at", F.pmod(F.xxhash64("x"), F.lit(997))).groupBy("rule", "at").agg(F.count("*").alias("n"), F.min("x").alias("x"))
    return one.groupBy("rule").agg(F.sum("n").alias("n"), few.alias("examples")).select(F.lit(kind).alias("file"), F.lit(level).alias("level"), "rule", "n", "examples")


def check_outputs(spark: SparkSession, matching: str, candidate: str | None, source1: str, others: list[str] = ()) -> DataFrame:
    """(file, level, rule, n, examples) of both outputs. source1 is the raw file of queries; others, the raw files of targets, turn on
    the check that listed ids exist. A missing candidate file or target file is a warning, and so are matches that aren't candidates."""
    warn = lambda kind, rule, path: spark.createDataFrame([(kind, "warning", rule, 1, [path])], FINDINGS)
    if _lines(spark, source1) is None:
        return spark.createDataFrame([("source1", "error", "file not found", 1, [source1])], FINDINGS)
    required, out, known = read_ids(spark, source1), [], None
    for path in others:
        if _lines(spark, path) is None:
            out, known = [*out, warn("targets", "no check of unknown ids", path)], None
            break
        known = read_ids(spark, path) if known is None else known.union(read_ids(spark, path))
    found, matched = check_file(spark, matching, "matching", required, known)
    out.append(found)
    held = None
    if candidate is not None and _lines(spark, candidate) is not None:
        found, held = check_file(spark, candidate, "candidate", required, known)
        out.append(found)
    elif candidate is not None:
        out.append(warn("candidate", "file not found", candidate))
    if matched is not None and held is not None:
        pair = lambda lists: lists.select("id", F.explode("ids").alias("t")).distinct()
        stray = pair(matched).join(pair(held), ["id", "t"], "left_anti").select(F.lit("match is no candidate").alias("rule"), F.col("id").alias("x")).distinct()
        out.append(_summed(stray, "matching", "warning"))
    total = out[0]
    for one in out[1:]:
        total = total.union(one)
    return total
