"""Reports on candidates and matches: one row or one row a group each, as DataFrames, and as text for people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import f_beta, per_query


def candidate_statistics(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: mean, median, p95 and max of candidates a query, and how many queries have none. Queries without pairs count as 0;
    percentiles are exact and interpolated, from one count per distinct number."""
    n = queries.select("q").distinct().join(pairs.groupBy("q").agg(F.count("*").alias("n")), "q", "left").fillna(0, ["n"])
    return n.agg(F.count("*").alias("n_queries"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.95).alias("p95"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("zero_candidate_queries"))


def _found(truth: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    kept = pairs.groupBy("q", "t").agg(F.lit(1).alias("hit"), *(F.max(c).alias(c) for c in columns))
    return truth.select("q", "t").distinct().join(kept, ["q", "t"], "left")


def recall_by_source(pairs: DataFrame, truth: DataFrame, source=None) -> DataFrame:
    """(source, n_true, recall) of true pairs by the target's source; by default the two characters its id begins with."""
    source = F.substring("t", 1, 2) if source is None else source
    return _found(truth, pairs).groupBy(source.alias("source")).agg(F.count("*").alias("n_true"), F.avg(F.col("hit").isNotNull().cast("double")).alias("recall"))


def recall_by_country(pairs: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(country, n_true, recall) of true pairs; queries(q, country) is unique in q."""
    return _found(truth, pairs).join(queries.select("q", "country"), "q").groupBy("country").agg(F.count("*").alias("n_true"), F.avg(F.col("hit").isNotNull().cast("double")).alias("recall"))


def pass_recall(pairs: DataFrame, truth: DataFrame, passes: list[str]) -> DataFrame:
    """(pass, recall, unique_recall): true pairs that a pass scored above 0, and those that no other pass did. pairs hold score_<pass>."""
    scores = [f"score_{p}" for p in passes]
    by = [(F.coalesce(F.col(s), F.lit(0.0)) > 0).cast("int") for s in scores]
    n = sum(by[1:], by[0])
    each = F.array(*(F.struct(F.lit(p).alias("pass"), (b == 1).alias("found"), ((b == 1) & (n == 1)).alias("only")) for p, b in zip(passes, by, strict=True)))
    rows = _found(truth, pairs, *scores).select(F.explode(each).alias("x")).select("x.*")
    return rows.groupBy("pass").agg(F.avg(F.col("found").cast("double")).alias("recall"), F.avg(F.col("only").cast("double")).alias("unique_recall"))


def match_report(queries: DataFrame, predicted: DataFrame, truth: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """queries(q, country) -> a row per country and one for all (country null): macro F0.5 and its ceiling among the candidates, pair
    precision and recall, singleton share and accuracy, F0.5 of matched queries, share of empty predictions, mean predictions.

    A query without prediction counts 1 if it is a singleton, else 0. Without candidates the ceiling is null. One aggregation
    by country feeds both levels.
    """
    per = per_query(queries.select("q").distinct(), predicted, truth).join(queries.select("q", "country").dropDuplicates(["q"]), "q")
    if candidates is None:
        per = per.withColumn("ceiling", F.lit(None).cast("double"))
    else:
        hits = candidates.select("q", "t").distinct().join(truth.select("q", "t").distinct(), ["q", "t"]).groupBy("q").agg(F.count("*").alias("n_found"))
        r = F.coalesce(F.col("n_found") / F.col("n_true"), F.lit(0.0))
        per = per.join(hits, "q", "left").withColumn("ceiling", F.when(F.col("n_true") == 0, 1.0).when(r == 0, 0.0).otherwise(f_beta(F.lit(1.0), r)))
    single, empty = F.col("n_true") == 0, F.col("n_pred") == 0
    sums = per.groupBy("country").agg(
        F.count("*").alias("n_queries"), F.sum("f05").alias("f05"), F.sum("ceiling").alias("ceiling"), F.sum("n_hit").alias("hit"), F.sum("n_pred").alias("pred"), F.sum("n_true").alias("true"), F.count_if(single).alias("single"), F.count_if(single & empty).alias("right"), F.sum(F.when(~single, F.col("f05")).otherwise(0.0)).alias("matched"), F.count_if(empty).alias("empty")
    )
    rows = sums.union(sums.groupBy().agg(F.lit(None).cast("string"), *(F.sum(c) for c in sums.columns[1:])))
    share = lambda a, b, none=0.0: F.coalesce(F.try_divide(a, b), F.lit(none))
    n, several = F.col("n_queries"), F.col("n_queries") - F.col("single")
    return rows.where("n_queries > 0").select("country", "n_queries", (F.col("f05") / n).alias("macro_f05"), (F.col("ceiling") / n).alias("macro_f05_ceiling"), share("hit", "pred").alias("pair_precision"), share("hit", "true").alias("pair_recall"), (F.col("single") / n).alias("singleton_share"), share("right", "single", 1.0).alias("singleton_accuracy"), share("matched", several, 1.0).alias("matched_query_f05"), (F.col("empty") / n).alias("predicted_empty_share"), (F.col("pred") / n).alias("mean_predictions"))


def truth_for(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """The true pairs of given queries."""
    return truth.select("q", "t").distinct().join(queries.select("q").distinct(), "q", "left_semi")


def format_report(report: DataFrame) -> str:
    """A report of a few rows as aligned text."""
    lines = []
    for row in report.collect():
        for name, value in row.asDict().items():
            shown = "all" if value is None and name == "country" else "-" if value is None else f"{value:.5f}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value)
            lines.append(f"{name:<26}: {shown}")
        lines.append("")
    return "\n".join(lines[:-1])
