"""Context features and the choice of matches: windows over a pair table by query q and by target t."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def _margin(df: DataFrame, keys: list[str], score: str, ties: str, prefix: str) -> DataFrame:
    """Score less the best other of the group (null if alone), rank, size and best of the group."""
    ordered = Window.partitionBy(*keys).orderBy(F.desc(score), ties)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumn(f"{prefix}_rank", F.row_number().over(ordered) - 1).withColumn(f"{prefix}_best", F.first(score).over(whole)).withColumn(f"{prefix}_second", F.nth_value(score, 2).over(whole)).withColumn(f"{prefix}_size", F.count("*").over(whole))
    return out.withColumn(f"{prefix}_margin", F.col(score) - F.when(F.col(f"{prefix}_rank") == 0, F.col(f"{prefix}_second")).otherwise(F.col(f"{prefix}_best"))).drop(f"{prefix}_second")


def context_features(pairs: DataFrame) -> DataFrame:
    """pairs(q, t, src, score, name_sim) with the eleven context columns."""
    out = _margin(_margin(_margin(pairs, ["q"], "score", "t", "q"), ["q", "src"], "score", "t", "qs"), ["t"], "score", "q", "t")
    out = out.withColumn("q_rel_score", F.col("score") / F.when(F.col("q_best") > 0, F.col("q_best")).otherwise(1.0))
    by_q, by_t = Window.partitionBy("q"), Window.partitionBy("t")
    alike = (F.col("name_sim") >= 0.9).cast("int")
    out = out.withColumn("q_n_strong", F.sum((F.col("q_rel_score") >= 0.9).cast("int")).over(by_q)).withColumn("q_n_name_dupes", F.sum(alike).over(by_q)).withColumn("t_n_name_dupes", F.sum(alike).over(by_t))
    return out.withColumnRenamed("t_size", "t_competitors").drop("q_best", "qs_best", "t_best", "qs_rank", "qs_size")


def probability_context(pairs: DataFrame) -> DataFrame:
    """pairs(q, t, p) with ten columns of the second stage."""
    out = _margin(_margin(pairs, ["q"], "p", "t", "pq"), ["t"], "p", "q", "pt")
    clipped = F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6))
    by_q, by_t = Window.partitionBy("q"), Window.partitionBy("t")
    out = out.withColumn("logit", F.log(clipped / (1 - clipped))).withColumn("pq_sum", F.sum("p").over(by_q)).withColumn("pt_sum", F.sum("p").over(by_t)).withColumn("pq_likely", F.sum((F.col("p") >= 0.5).cast("int")).over(by_q))
    return out.drop("pq_best", "pt_best")


def owner_normalized(pairs: DataFrame, name: str, p: str = "p") -> DataFrame:
    """pairs with, as `name`, the probability over what all queries claim of the target, if that is more than one. Claims are summed
    before the shuffle, so that a target which many queries claim isn't one task; only targets claimed more than once are joined."""
    claims = pairs.groupBy("t").agg(F.sum(p).alias("_claimed")).where("_claimed > 1")
    return pairs.join(claims, "t", "left").withColumn(name, F.col(p) / F.coalesce("_claimed", F.lit(1.0))).select(*pairs.columns, name)


def select_expected_f(pairs: DataFrame, p: str = "p", beta: float = 0.5, missing_mass: float = 0.05) -> DataFrame:
    """pairs with `selected`: of each query's pairs by probability the shortest prefix of the greatest expected F, if that beats
    choosing none."""
    by_q = Window.partitionBy("q")
    ordered = by_q.orderBy(F.desc(p), "t")
    out = pairs.withColumn("_k", F.row_number().over(ordered)).withColumn("_prefix", F.sum(p).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_e", (1 + beta**2) * F.col("_prefix") / (F.col("_k") + beta**2 * (F.sum(p).over(by_q) + missing_mass)))
    none = F.exp(F.sum(F.log1p(-F.least(F.col(p), F.lit(1 - EPSILON)))).over(by_q)) * F.exp(F.lit(-missing_mass))
    out = out.withColumn("_none", none).withColumn("_best", F.max("_e").over(by_q))
    out = out.withColumn("_cut", F.min(F.when(F.col("_e") >= F.col("_best") - EPSILON, F.col("_k"))).over(by_q))
    return out.withColumn("selected", (F.col("_k") <= F.col("_cut")) & (F.col("_best") > F.col("_none"))).drop("_k", "_prefix", "_e", "_none", "_best", "_cut")


def exclusive(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Of the selected pairs of a target, the best stays; ties by q. Pairs are distinct. The best is found before the shuffle."""
    best = pairs.where("selected").groupBy("t").agg(F.min(F.struct((-F.col(p)).alias("p"), "q")).alias("_best"))
    owners = best.select("t", F.col("_best.q").alias("q"), F.lit(True).alias("_owner"))
    return pairs.join(owners, ["q", "t"], "left").withColumn("selected", F.col("selected") & F.col("_owner").isNotNull()).select(*pairs.columns)


def apply_rule(pairs: DataFrame, kind: str = "expected_f", threshold: float = 0.5, missing_mass: float = 0.05, normalize: bool = True, single_owner: bool = True, beta: float = 0.5) -> DataFrame:
    out = owner_normalized(pairs, "p_used") if normalize else pairs.withColumn("p_used", F.col("p"))
    out = select_expected_f(out, "p_used", beta, missing_mass) if kind == "expected_f" else out.withColumn("selected", F.col("p_used") >= threshold)
    return exclusive(out, "p_used") if single_owner else out
