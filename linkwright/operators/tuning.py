"""Fitting on one fold and reporting on the other: rules, the second stage's adoption, query splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import drawn, drawn_number
from ..plans.tables import written
from .decision import apply_rule
from .models import calibrator, fold, rule_grid, tune_rule
from .reports import match_report

PLAIN = {"kind": "threshold", "threshold": 0.5, "normalize": False, "single_owner": False}


def split_queries(queries: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """(q, held_out): about that share of queries, by hash."""
    return queries.select("q").distinct().withColumn("held_out", drawn_number("q", seed) < share * (1 << 32))


def missing_mass(queries: DataFrame, scored: DataFrame, truth: DataFrame) -> float:
    """True pairs a query that aren't among the candidates."""
    missed = truth.select("q", "t").distinct().join(queries.select("q"), "q", "left_semi").join(scored.select("q", "t"), ["q", "t"], "left_anti").count()
    return missed / max(queries.count(), 1)


def tune_and_report(queries: DataFrame, scored: DataFrame, truth: DataFrame, rules: list[dict] | None = None) -> dict:
    """queries(q, country), scored(q, t, src, label, p), truth(q, t): calibration and rule from fold 0, reports on both folds and of a
    plain threshold. Returns the rule, its score on fold 0, the missing mass and the report (a DataFrame with `part`)."""
    queries = queries.withColumn("fold", fold())
    tune, rest = queries.where("fold = 0"), queries.where("fold = 1")
    marked = scored.withColumn("fold", fold())
    fitted = calibrator(marked.where("fold = 0"))
    scored = written(fitted(marked).drop("p", "fold").withColumnRenamed("calibrated", "p"))
    mass = missing_mass(tune, scored, truth)
    mine = scored.join(tune.select("q"), "q", "left_semi")
    rule, score = tune_rule(tune, mine, truth, rules or rule_grid(mass))
    # Owners of a target compete over all folds, so rules run on all pairs.
    chosen, plain = written(apply_rule(scored, **rule).where("selected")), written(apply_rule(scored, **PLAIN).where("selected"))
    report = None
    for part, of, selected in (("fold1", rest, chosen), ("fold1_threshold", rest, plain), ("fold0", tune, chosen)):
        one = match_report(of, _of(selected, of), _of(truth, of), _of(scored, of)).withColumn("part", F.lit(part))
        report = one if report is None else report.union(one)
    return {"rule": rule, "score": score, "missing_mass": mass, "report": report}


def _of(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    return pairs.join(queries.select("q"), "q", "left_semi")


def adopt(first: dict, second: dict) -> bool:
    """Whether the second stage's tuned score on fold 0 is better than the first's."""
    return (second["score"] or 0.0) > (first["score"] or 0.0)


def query_set(queries: DataFrame, split: str, validation: DataFrame | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """The queries of a split: all for `test`; those of validation(q) for `val`; the others for `train`, of which n by hash if n is given."""
    if split == "test":
        return queries
    if validation is None and split == "val":
        raise ValueError("the val split needs its queries; make them with validation_split")
    if split == "val":
        return queries.join(validation.select("q").distinct(), "q", "left_semi")
    rest = queries if validation is None else queries.join(validation.select("q").distinct(), "q", "left_anti")
    return rest if n is None else rest.orderBy(drawn("q", seed), "q").limit(n)
