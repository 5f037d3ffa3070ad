"""Evaluation of candidates and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_beta(precision, recall, beta: float = 0.5) -> Column:
    b = beta**2
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def per_query(queries: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, n_pred, n_true, n_hit, f05) of every query; repeated pairs count once, and nothing predicted where nothing is true is 1."""
    predicted, truth = predicted.select("q", "t").distinct(), truth.select("q", "t").distinct()
    count = lambda pairs, name: pairs.groupBy("q").agg(F.count("*").alias(name))
    out = queries.select("q").join(count(predicted, "n_pred"), "q", "left").join(count(truth, "n_true"), "q", "left").join(count(predicted.join(truth, ["q", "t"]), "n_hit"), "q", "left").fillna(0)
    f = f_beta(F.coalesce(F.try_divide("n_hit", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("n_hit", "n_true"), F.lit(0.0)))
    return out.withColumn("f05", F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), 1.0).otherwise(f))


def evaluate(queries: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: macro F0.5, pair precision and recall, singleton share and accuracy, empty share, mean predictions."""
    q = per_query(queries, predicted, truth)
    single = F.col("n_true") == 0
    return q.agg(F.count("*").alias("n_queries"), F.avg("f05").alias("macro_f05"), F.try_divide(F.sum("n_hit"), F.sum("n_pred")).alias("precision"), F.try_divide(F.sum("n_hit"), F.sum("n_true")).alias("recall"), F.avg(single.cast("double")).alias("singleton_share"), F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))).alias("singleton_accuracy"), F.avg((F.col("n_pred") == 0).cast("double")).alias("empty_share"), F.avg("n_pred").alias("mean_predictions"))


def threshold_sweep(queries: DataFrame, scored: DataFrame, truth: DataFrame, start: float = 0.30, stop: float = 0.90, step: float = 0.02) -> DataFrame:
    """(threshold, macro_f05). A pair is counted once, at the greatest threshold up to its p; what a lower threshold selects is a
    running sum over the query's few counts, and a query's score at every threshold is an element of one array."""
    cuts = [round(start + i * step, 2) for i in range(round((stop - start) / step) + 1)]
    true = truth.select("q", "t").distinct().withColumn("hit", F.lit(1))
    marked = scored.groupBy("q", "t").agg(F.max("p").alias("p")).join(true, ["q", "t"], "left")
    # Pairs below the first threshold are never selected.
    marked = marked.where(F.col("p") >= cuts[0]).withColumn("at", sum(((F.col("p") >= c).cast("int") for c in cuts[1:]), F.lit(0)))
    per = marked.groupBy("q").agg(*(x for i in range(len(cuts)) for x in (F.count_if(F.col("at") >= i).alias(f"p{i}"), F.count_if((F.col("at") >= i) & F.col("hit").isNotNull()).alias(f"h{i}"))))
    every = queries.select("q").join(true.groupBy("q").agg(F.count("*").alias("n_true")), "q", "left").join(per, "q", "left").fillna(0)

    def score(i: int) -> Column:
        pred, hit = F.col(f"p{i}"), F.col(f"h{i}")
        f = f_beta(F.coalesce(F.try_divide(hit, pred), F.lit(0.0)), F.coalesce(F.try_divide(hit, "n_true"), F.lit(0.0)))
        return F.avg(F.when((pred == 0) & (F.col("n_true") == 0), 1.0).otherwise(f)).alias(f"f{i}")

    means = every.agg(*map(score, range(len(cuts))))
    return means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("threshold"), F.col(f"f{i}").alias("macro_f05")) for i, c in enumerate(cuts)))).alias("x")).select("x.*")


def candidate_report(queries: DataFrame, pairs: DataFrame, truth: DataFrame, n_targets: int, ks=(1, 5, 10, 15)) -> DataFrame:
    """One row over pairs(q, t, source_rank): pair recall, recall at k, F0.5 ceiling (all predictions right), shares, reduction ratio."""
    found = truth.select("q", "t").distinct().join(pairs.select("q", "t", "source_rank").withColumn("hit", F.lit(1)), ["q", "t"], "left")
    at = [F.avg((F.coalesce(F.col("source_rank"), F.lit(1 << 30)) < k).cast("double")).alias(f"recall_at_{k}") for k in ks]
    recall = found.agg(F.avg(F.when(F.col("hit") == 1, 1.0).otherwise(0.0)).alias("pair_recall"), *at)
    by_q = found.groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    r = F.coalesce(F.try_divide("h", "n"), F.lit(1.0))
    ceiling = queries.select("q").join(by_q, "q", "left").agg(F.avg(F.when(r == 0, 0.0).otherwise(f_beta(F.lit(1.0), r))).alias("f05_ceiling"), F.avg(F.when(F.col("n").isNotNull(), (r == 1).cast("double"))).alias("full_recall_share"), F.avg(F.when(F.col("n").isNotNull(), (r == 0).cast("double"))).alias("zero_recall_share"), F.count("*").alias("n_queries"))
    total = pairs.agg(F.count("*").alias("n_pairs"))
    return recall.crossJoin(ceiling).crossJoin(total).withColumn("reduction_ratio", 1 - F.col("n_pairs") / (F.col("n_queries") * F.lit(float(n_targets))))


def recall_at_budgets(pairs: DataFrame, n_true: int, budgets: list[int]) -> DataFrame:
    """One row: share of n_true that pairs(label, source_rank) keep within each budget."""
    return pairs.agg(*(F.try_divide(F.sum((F.col("label") & (F.col("source_rank") < b)).cast("long")), F.lit(n_true)).alias(f"recall_{b}") for b in budgets))
