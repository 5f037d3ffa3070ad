"""End to end: raw records to candidates, features, probabilities and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preprocess, source_of
from ..operators.blocking import Config, candidates
from ..operators.decision import apply_rule
from ..operators.features import FEATURES, match_records, pair_features
from ..operators.models import calibrator, out_of_fold
from .tables import written


def blocking_records(raw: DataFrame, india: bool = True) -> DataFrame:
    clean = preprocess(raw, india)
    return clean.select(F.col("entity_id").alias("id"), "country", source_of("entity_id").alias("src"), F.col("clean_name").alias("name"), F.col("clean_address").alias("address"))


def labelled_features(records: DataFrame, truth: DataFrame, config: Config = Config()) -> DataFrame:
    records = written(records)
    pairs = written(candidates(records, config))
    true = truth.select("q", "t").distinct().withColumn("label", F.lit(True))
    return pair_features(pairs, written(match_records(records))).join(true, ["q", "t"], "left").fillna(False, ["label"])


def matches(records: DataFrame, truth: DataFrame, config: Config = Config(), trees: int = 20, **rule) -> DataFrame:
    """(q, t, p, selected) of every candidate pair: out-of-fold boosted trees, isotonic calibration, then the decision rule."""
    scored = out_of_fold(written(labelled_features(records, truth, config)), FEATURES, trees=trees)
    scored = written(scored.select("q", "t", "src", "label", "p"))
    calibrated = calibrator(scored)(scored).drop("p").withColumnRenamed("calibrated", "p")
    return apply_rule(calibrated, **rule)
