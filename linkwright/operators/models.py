"""Matchers: boosted trees out of fold, isotonic calibration, a stacked second stage, rescoring weights and rule tuning."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sampling import drawn, drawn_number
from ..plans.tables import written
from .decision import apply_rule, probability_context
from .metrics import per_query

MISSING = -999.0
STACKED = ["p", "logit", "pq_margin", "pq_rank", "pq_size", "pq_sum", "pq_likely", "pt_margin", "pt_rank", "pt_size", "pt_sum"]


def fold(q: str = "q", n: int = 2) -> Column:
    """The fold of a query, by hash: all pairs of a query share it."""
    return (drawn_number(q, 0) % n).cast("int")


def sample_roles(queries: DataFrame, per_fold: int, early_share: float = 0.1, seed: int = 42) -> DataFrame:
    """(q, fold, role): per_fold queries of each fold are `train` or `stop` (for early stopping), the others `rest`. queries(q) are
    distinct. Only the per_fold queries of a fold are ever ranked in one task."""
    marked = queries.select("q", fold().alias("fold"), drawn("q", seed).alias("draw"))
    first = [marked.where(F.col("fold") == f).orderBy("draw", "q").limit(per_fold) for f in (0, 1)]
    place = F.row_number().over(Window.partitionBy("fold").orderBy("draw", "q"))
    role = F.when(place <= int(per_fold * early_share), "stop").otherwise("train")
    picked = first[0].union(first[1]).select("q", role.alias("role"))
    return marked.join(picked, "q", "left").select("q", "fold", F.coalesce("role", F.lit("rest")).alias("role"))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with `features` as a vector: nulls below every range, with flags, since trees take no nulls."""
    filled = df.withColumns({f"{f}_v": F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features} | {f"{f}_null": F.col(f).isNull().cast("double") for f in features})
    columns = [f"{f}_v" for f in features] + [f"{f}_null" for f in features]
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled).drop(*columns)


class Matcher:
    """A fitted model with the features it reads. Called on a DataFrame it adds a probability."""

    def __init__(self, model, features: list[str]):
        self.model, self.features = model, features

    def __call__(self, df: DataFrame, name: str = "p") -> DataFrame:
        """Features are taken by name; a column that is missing is an error of the plan."""
        return self.model.transform(assembled(df, self.features)).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def importances(self) -> list[tuple[str, float]]:
        """(feature, share of the trees' gain), greatest first; a feature's null flag counts for it."""
        gains = self.model.featureImportances.toArray()
        both = [(f, float(gains[i] + gains[i + len(self.features)])) for i, f in enumerate(self.features)]
        return sorted(both, key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        """Writes the model and the order of its features to a folder that driver and executors share."""
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.getActiveSession().createDataFrame(list(enumerate(self.features)), "at int, feature string").coalesce(1).write.mode("overwrite").json(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Matcher:
        features = spark.read.schema("at int, feature string").json(f"{path}/features").orderBy("at").collect()
        return Matcher(GBTClassificationModel.load(f"{path}/model"), [r["feature"] for r in features])


def train_matcher(train: DataFrame, features: list[str], trees: int = 40, depth: int = 5) -> Matcher:
    """train holds `label` and perhaps `stop`, which marks rows for early stopping."""
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42, labelCol="label")
    if "stop" in train.columns:
        gbt = gbt.setValidationIndicatorCol("stop")
    return Matcher(gbt.fit(assembled(train.withColumn("label", F.col("label").cast("double")), features)), features)


def mean_of(models: list[Matcher], df: DataFrame, name: str = "p") -> DataFrame:
    """df with the mean probability of the models, for rows that none of them was trained on."""
    names = [f"{name}_{i}" for i in range(len(models))]
    for model, n in zip(models, names, strict=True):
        df = model(df, n)
    return df.withColumn(name, sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def apply_stack(models: list[Matcher], scored: DataFrame) -> DataFrame:
    """scored(q, t, p) with p2, the second-stage models' mean over the probabilities of competing pairs."""
    context = probability_context(scored)
    return mean_of(models, context, "p2").select(*scored.columns, "p2")


def out_of_fold(pairs: DataFrame, features: list[str], **kw) -> DataFrame:
    """pairs(q, t, label, features) with p from the model of the other fold."""
    marked = pairs.withColumn("fold", fold())
    models = [train_matcher(marked.where(F.col("fold") == f), features, **kw) for f in (0, 1)]
    return models[1](marked.where("fold = 0")).unionByName(models[0](marked.where("fold = 1")))


def stacked(scored: DataFrame, **kw) -> DataFrame:
    """scored(q, t, label, p) with p2 from a second stage over the probabilities of competing pairs, out of fold."""
    return scored.join(_second(probability_context(scored), **kw), ["q", "t"])


def _second(context: DataFrame, trees: int = 20) -> DataFrame:
    marked = context.withColumn("fold", fold())
    models = [train_matcher(marked.where(F.col("fold") == f), STACKED, trees=trees, depth=4) for f in (0, 1)]
    return models[1](marked.where("fold = 0"), "p2").unionByName(models[0](marked.where("fold = 1"), "p2")).select("q", "t", "p2")


def calibrator(scored: DataFrame, p: str = "p", bins: int = 10_000):
    """An isotonic fit of label by p; returns a function that adds `calibrated` between 0 and 1.

    Spark pools the points of a fit on the driver, so they are first summed in `bins` bins of p by weight: at most so many points,
    however many pairs there are."""
    points = scored.groupBy(F.floor(F.col(p) * bins).alias("bin")).agg(F.avg(p).alias(p), F.avg(F.col("label").cast("double")).alias("y"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(featuresCol=p, labelCol="y", weightCol="weight").fit(points)
    return lambda df: model.transform(df).withColumn("calibrated", F.greatest(F.least("prediction", F.lit(1.0)), F.lit(0.0))).drop("prediction")


def rescore_weights(pairs: DataFrame, views: list[str], c: float = 1.0) -> dict[str, float]:
    """Balanced logistic coefficients of sim_<view>, on pairs(label, missing_address, sim_*) whose sides both have an address."""
    return _rounded_weights(views, _balanced(pairs.where(~F.col("missing_address")), views, c))


def _rounded_weights(views: list[str], theta: list[float]) -> dict[str, float]:
    return {v: round(float(x), 3) for v, x in zip(views, theta, strict=False)}


def _balanced(known: DataFrame, views: list[str], c: float) -> list[float]:
    """The coefficients and the intercept; zeros where only one label occurs."""
    known = known.withColumn("y", F.col("label").cast("double"))
    n, positive = known.agg(F.count("*"), F.sum("y")).first()
    if not positive or positive == n:
        return [0.0] * (len(views) + 1)
    weighted = known.withColumn("weight", F.when(F.col("y") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive))))
    rows = VectorAssembler(inputCols=[f"sim_{v}" for v in views], outputCol="features").transform(weighted)
    model = LogisticRegression(labelCol="y", weightCol="weight", standardization=False, regParam=1 / (c * n)).fit(rows)
    return [*map(float, model.coefficients), float(model.intercept)]


def rescore_weights_streamed(pairs, c: float = 1.0, start: int = 20_000, step: float = 1e-3) -> dict[str, float]:
    """rescore_weights of blocking.LabelledPairs. Of at most `start` queries the pairs are written and fitted as a table. Of more,
    a sample's fit is only where Newton's method begins: each of its steps goes over all pairs, until the last one moves no coefficient
    by more than `step`; by then the error is about the square of that. One row of sums reaches the driver."""
    one_in = -(-pairs.queries // start) or 1
    theta = np.array(_balanced(written(pairs.rows(one_in)), pairs.views, c))
    before = None
    while one_in > 1:
        loss, gradient, second = _objective(pairs.sums(theta.tolist()), theta, c)
        if loss is None:
            return dict.fromkeys(pairs.views, 0.0)
        if before is not None and loss > before[0] + 1e-9 * abs(before[0]) and np.abs(theta - before[1]).max() > 1e-6:
            theta = (theta + before[1]) / 2  # the step was too long
            continue
        move = np.linalg.solve(second, gradient)
        before, theta = (loss, theta), theta - move
        if np.abs(move).max() <= step:
            break
    return _rounded_weights(pairs.views, theta.tolist())


def _objective(sums: list[float], theta: np.ndarray, c: float):
    """Loss, gradient and second derivatives of the balanced loss with its penalty, which the intercept doesn't have."""
    k, halves = len(theta), np.array(sums).reshape(2, -1)
    n = halves[:, 0]
    if not n.all():
        return None, None, None
    loss, rest = (halves[:, 1:] * (n.sum() / (2 * n))[:, None]).sum(axis=0)[0], (halves[:, 2:] * (n.sum() / (2 * n))[:, None]).sum(axis=0)
    penalty = np.append(np.full(k - 1, 1 / c), 0.0)
    return loss + (penalty * theta**2).sum() / 2, rest[:k] + penalty * theta, rest[k:].reshape(k, k) + np.diag(penalty)


def rule_grid(missing_mass: float) -> list[dict]:
    masses, thresholds = sorted({0.0, missing_mass / 2, missing_mass, 2 * missing_mass}), (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
    variants = [{"normalize": n, "single_owner": s} for n in (True, False) for s in (True, False)]
    return [{"kind": "expected_f", "missing_mass": m} | v for v in variants for m in masses] + [{"kind": "threshold", "threshold": x} | v for v in variants for x in thresholds]


def tune_rule(queries: DataFrame, scored: DataFrame, truth: DataFrame, rules: list[dict]) -> tuple[dict, float]:
    """The rule of the greatest macro F0.5; the first wins ties. One number a rule comes to the driver."""
    scored = scored.persist()
    results = [(per_query(queries, apply_rule(scored, **r).where("selected"), truth).agg(F.avg("f05")).first()[0], r) for r in rules]
    scored.unpersist()
    best = max(range(len(rules)), key=lambda i: (results[i][0] or 0.0, -i))
    return results[best][1], results[best][0]
