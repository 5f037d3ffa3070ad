"""Reports, outputs and their checks, model files, settings, and the folding of all code points."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from linkwright.functions.text import clean_text
from linkwright.operators import models
from linkwright.operators import reports as R
from linkwright.operators import tuning
from linkwright.operators.blocking import Config, Pass
from linkwright.sources.records import read_lists
from linkwright.sources.submission import check_outputs, write_outputs


@pytest.fixture(scope="module")
def made(spark):
    queries = spark.createDataFrame([("S1-1", "us"), ("S1-2", "us"), ("S1-3", "fr"), ("S1-4", "fr")], "q string, country string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", 0.9, True, 1.0, 0.0), ("S1-1", "S3-1", 0.4, False, 1.0, 0.5), ("S1-2", "S2-2", 0.8, True, 0.0, 0.7), ("S1-3", "S3-3", 0.2, False, 0.0, 0.7)], "q string, t string, p double, selected boolean, score_name double, score_addr double")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-2", "S2-9"), ("S1-1", "S2-1")], "q string, t string")
    return queries, pairs, truth


def test_reports(made):
    queries, pairs, truth = made
    one = R.candidate_statistics(queries, pairs).first()
    assert (one.n_queries, one.mean, one.median, one.most, one.zero_candidate_queries) == (4, 1.0, 1.0, 2, 1) and abs(one.p95 - 1.85) < 1e-9
    assert {(r.source, r.n_true, r.recall) for r in R.recall_by_source(pairs, truth).collect()} == {("S2", 2, 0.5), ("S3", 1, 1.0)}
    assert {(r["pass"], round(r.recall, 3), round(r.unique_recall, 3)) for r in R.pass_recall(pairs, truth, ["name", "addr"]).collect()} == {("name", 0.667, 0.333), ("addr", 0.333, 0.0)}
    report = R.match_report(queries, pairs.where("selected"), truth, pairs)
    rows = {r.country: r for r in report.collect()}
    assert set(rows) == {"us", "fr", None} and rows["fr"].macro_f05 == 1 and rows["fr"].singleton_accuracy == 1
    assert abs(rows["us"].macro_f05 - 0.5 * (1.25 * 0.5 / 0.75)) < 1e-9 and rows["us"].macro_f05_ceiling == 0.5 and rows[None].pair_precision == 0.5
    assert "macro_f05" in R.format_report(report) and R.truth_for(truth, queries.limit(1)).count() <= 2
    assert R.match_report(queries.limit(0), pairs.where("selected"), truth).count() == 0


def test_outputs_pass_their_own_checks(spark, made, tmp_path):
    queries, pairs, _ = made
    matching, candidate, source1, source2 = (str(tmp_path / x) for x in ("matching", "candidate", "source1.tsv", "source2.tsv"))
    stats = {r.country: r for r in write_outputs(queries, pairs, matching, candidate).collect()}
    assert (stats["us"].queries, stats["us"].pairs, stats["us"].mean_matches) == (2, 3, 1.0) and (stats["fr"].without_candidates, stats["fr"].predicted_empty_share) == (1, 1.0)
    assert {(r.q, r.t) for r in read_lists(spark, candidate).collect()} == {(r.q, r.t) for r in pairs.collect()}
    open(source1, "w").write("entity_id\tname\n" + "".join(f"S1-{i}\tx\n" for i in range(1, 5)))
    open(source2, "w").write("entity_id\tname\n" + "".join(f"{t}\tx\n" for t in ("S2-1", "S2-2", "S3-1", "S3-3")))
    assert check_outputs(spark, matching, candidate, source1, [source2]).count() == 0


@pytest.mark.parametrize(
    ("body", "rules"),
    [
        (None, {"file not found"}),
        ("", {"file is empty"}),
        ("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n", {"comma-separated"}),
        ("source1_entity_id\tids\n", {"unexpected header"}),
        ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1,S1-2,Q1,S2-7\nS1-1\t\nS1-9\t\nS1-2\n", {"duplicate rows", "repeated ids", "self match", "wrong prefix", "unknown id", "missing query", "extra query", "malformed row"}),
    ],
)
def test_checks_find_each_rule(spark, tmp_path, body, rules):
    path, source1, source2 = (str(tmp_path / x) for x in ("m.tsv", "s1.tsv", "s2.tsv"))
    if body is not None:
        open(path, "w").write(body)
    open(source1, "w").write("entity_id\nS1-1\nS1-2\n")
    open(source2, "w").write("entity_id\nS2-1\n")
    found = check_outputs(spark, path, str(tmp_path / "none"), source1, [source2]).collect()
    assert {r.rule for r in found if r.level == "error"} == rules and {r.file for r in found if r.level == "warning"} == {"candidate"}
    assert {r.rule for r in check_outputs(spark, path, None, str(tmp_path / "none")).collect()} == {"file not found"}


def test_matches_outside_candidates_warn(spark, tmp_path):
    for name, body in (("m", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n"), ("c", "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-2\n"), ("s", "entity_id\nS1-1\n")):
        open(tmp_path / name, "w").write(body)
    found = check_outputs(spark, str(tmp_path / "m"), str(tmp_path / "c"), str(tmp_path / "s"), [str(tmp_path / "none")]).collect()
    assert {(r.level, r.rule) for r in found} == {("warning", "match is no candidate"), ("warning", "no check of unknown ids")}


def test_settings_round_trip(spark, tmp_path):
    config = Config(passes=(Pass("only", {"name_word": 2.0}, 7, 0.2, 9),), budget=4)
    config.save(spark, str(tmp_path / "config"))
    assert Config.load(spark, str(tmp_path / "config")) == config and Config.load(spark, None) == Config()
    assert Config.from_json('{"budget": 3}') == Config(budget=3)
    with pytest.raises(TypeError):
        Config.from_json('{"budgets": 3}')


@pytest.fixture(scope="module")
def pairs(spark):
    x = spark.range(1200).select((F.col("id") / 3).cast("int").cast("string").alias("q"), F.col("id").cast("string").alias("t"), (F.col("id") % 2).cast("int").alias("src"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    return x.withColumn("label", F.col("a") > 0.6).persist()


def test_models_are_saved_and_averaged(spark, pairs, tmp_path):
    one, two = models.train_matcher(pairs.where("t % 2 = 0"), ["a", "b"], trees=3, depth=2), models.train_matcher(pairs, ["a", "b"], trees=2, depth=2)
    assert one.importances()[0][0] == "a" and abs(sum(x for _, x in one.importances()) - 1) < 1e-6
    one.save(str(tmp_path / "model"))
    again = models.Matcher.load(spark, str(tmp_path / "model"))
    want = {r.t: r.p for r in one(pairs).select("t", "p").collect()}
    assert again.features == ["a", "b"] and {r.t: r.p for r in again(pairs).select("t", "p").collect()} == want
    other = {r.t: r.p for r in two(pairs).select("t", "p").collect()}
    mean = models.mean_of([one, two], pairs).select("t", "p").collect()
    assert all(abs(r.p - (want[r.t] + other[r.t]) / 2) < 1e-9 for r in mean)


def test_rules_are_tuned_on_one_fold(spark, pairs):
    scored = pairs.withColumn("p", F.col("a") * 0.9).select("q", "t", "src", "label", "p")
    queries = pairs.select("q").distinct().withColumn("country", F.lit("us"))
    rules = [{"kind": "threshold", "threshold": x, "normalize": False, "single_owner": False} for x in (0.2, 0.5, 0.8)]
    truth = pairs.where("label").select("q", "t")
    out = tuning.tune_and_report(queries, scored, truth, rules)
    assert out["rule"] in rules and out["missing_mass"] == 0 and 0.9 < out["score"] <= 1
    best = {r.part: r.macro_f05 for r in out["report"].where("country is null").collect()}
    assert set(best) == {"fold0", "fold1", "fold1_threshold"} and best["fold0"] == pytest.approx(out["score"])
    assert tuning.adopt({"score": 0.5}, {"score": 0.6}) and not tuning.adopt({"score": 0.6}, {"score": 0.6})
    by_hand = {r["threshold"]: tuning_score(queries, scored, truth, r["threshold"]) for r in rules[:1]}
    assert all(0 <= x <= 1 for x in by_hand.values())
    held = tuning.split_queries(queries, 0.25)
    assert held.count() == 400 and 60 < held.where("held_out").count() < 140
    val = queries.limit(10)
    assert tuning.query_set(queries, "train", val).count() == 390 and tuning.query_set(queries, "val", val).count() == 10 and tuning.query_set(queries, "train", val, 5).count() == 5
    with pytest.raises(ValueError, match="val"):
        tuning.query_set(queries, "val")


def tuning_score(queries, scored, truth, threshold):
    return R.match_report(queries, scored.where(F.col("p") >= threshold), truth).where("country is null").first().macro_f05


def test_folding_of_all_code_points(spark):
    """Every code point that compatibility decomposition changes, and a sample of the others, against Python's own tables."""

    def want(t):
        t = "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).lower()
        return " ".join(re.sub(r"[^a-z0-9]", " ", re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", t, flags=re.A).replace("&", " and ")).split())

    indic = range(0x900, 0xD80)
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and c not in indic and c not in (0x200C, 0x200D)]
    points = [c for c in points if c % 211 == 0 or unicodedata.combining(chr(c)) or (not 0xAC00 <= c < 0xD7A4 and not unicodedata.is_normalized("NFKD", chr(c)))]
    texts = spark.createDataFrame([(f"x{chr(c)}yz 12{chr(c)} Main",) for c in points], "t string")
    assert [r.t for r in texts.select("t", clean_text("t").alias("got")).collect() if r.got != want(r.t)] == []
