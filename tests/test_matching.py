import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkwright import catalog
from linkwright.operators import blocking, index
from linkwright.operators import decision as D
from linkwright.operators import metrics as M
from linkwright.operators import models
from linkwright.operators.blocking import Config, candidates, top_k, union_passes
from linkwright.operators.features import FEATURES, match_records, pair_features
from linkwright.plans.matching import blocking_records, matches
from linkwright.plans.tables import written
from linkwright.sources.records import RAW, id_lists, read_lists, read_raw, write_lists
from linkwright.streaming import normalise

TOY = """S1-1|Complete Property Solutions LLC|10528 Cedar Falls Loop, Hillsboro, OR|US|
S1-2|Shiv Enterprises Private Limited|Wework Embassy Techvillage, Bellandur, Bangalore|India|
S1-3|Pharmacie du Madeleine|37 Rue des Augustins, Bordeaux|France|
S1-4|Lonely Singleton Widgets Inc|1 Nowhere Road, Nome, AK|US|
S1-5|Supreme Interiors Inc|9122 Duane Street, Houston, TX|US|
S1-6|Kiwi Imports Ltd|5 Queen Street, Auckland|New Zealand|
S2-1|LLC Complete Property Soluiscos|#10528 Cedar Falls Loop, Hillsboro, Oregon|US|S1-1
S2-2|ಶಿವ್ ಎಂಟರ್‌ಪ್ರೈಸಸ್ ಪ್ರೈವೇಟ್ ಲಿಮಿಟೆಡ್|WEWORK EMBASSY TECHVILLAGE, BELLANDUR, Karnataka|India|S1-2
S2-3|Tavowex|9122 DUANE STREET, HOUSTON, TX|US|S1-5
S2-4|Unrelated Bakery LLC|77 Elm St, Dayton, OH|US|
S2-5|Complete Property Solutions LLC|10528 Cedar Falls Loop, Hillsboro, OR|India|
S2-6|Kiwi Imports Limited|5 Queen St, Auckland|Australia|S1-6
S3-1|Pharmacie Madeleine SARL|37 R des Augustins, Bordeaux, Nouvelle-Aquitaine|France|S1-3
S3-2|shiventerprises.com|Bellandur, Bangalore South, ಕರ್ನಾಟಕ|India|S1-2
S3-3|Supreme Interi0rs|#9122 Duane St, Texas, Houston|US|S1-5
S3-4|Random Unrelated Name|12 Other Ave, Paris|France|"""


@pytest.fixture(scope="module")
def toy(spark):
    rows = [line.split("|") for line in TOY.splitlines()]
    raw = spark.createDataFrame([r[:4] for r in rows], RAW)
    records = written(blocking_records(raw))
    pairs = candidates(records).persist()
    return records, pairs, {(r[4], r[0]) for r in rows if r[4]}


def test_blocking_finds_true_pairs_and_keeps_countries_apart(toy):
    _, pairs, true = toy
    got = {(r.q, r.t) for r in pairs.collect()}
    assert true <= got
    assert ("S1-1", "S2-5") not in got
    assert {t for q, t in got if q == "S1-3"} <= {"S3-1", "S3-4"}
    assert ("S1-6", "S2-6") in got  # no targets of its country: all of the source


def test_pair_features(toy):
    records, pairs, _ = toy
    found = {(r.q, r.t): r for r in pair_features(pairs, match_records(records)).collect()}
    assert set(FEATURES) <= set(next(iter(found.values())).asDict()) and len(FEATURES) == 52 and len(found) == pairs.count()
    row = found["S1-1", "S2-1"]
    assert row.house_eq == 1 and row.addr_jaccard > 0.8 and row.num_conflict == 0


def test_union_and_top_k(spark):
    one = spark.createDataFrame([(0, 10, 2, 0.9, 0), (0, 11, 2, 0.8, 1)], "q int, t int, src int, score double, rank int")
    two = spark.createDataFrame([(0, 11, 2, 0.7, 0), (1, 12, 2, 0.6, 0)], "q int, t int, src int, score double, rank int")
    got = {(r.q, r.t): (r.score_a, r.score_b, r.best_rank) for r in union_passes({"a": one, "b": two}).collect()}
    assert got == {(0, 11): (0.8, 0.7, 0), (0, 10): (0.9, 0, 0), (1, 12): (0, 0.6, 0)}
    s = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.9), (0, 3, 0.5), (1, 4, 0.3), (1, 5, 0.05)], "q int, t int, score double")
    assert {(r.t, r["rank"]) for r in top_k(s, 2, 0.1, ("q",)).collect()} == {(2, 0), (3, 1), (4, 0)}


def joined_search(records, passes, rescore, budget):
    """What search returns, by joins over all keys."""
    q, t = catalog.shared_sides(records, list(dict.fromkeys([v for p in passes for v in p.weights] + list(rescore))))
    every = blocking.union_passes({p.name: blocking.retrieve(q, t, p) for p in passes})
    scored = blocking.pair_cosines(every, q, t, list(rescore)).withColumn("candidate_score", F.round(blocking.candidate_score(rescore, F.lit(False)), 6))
    return every, top_k(scored, budget, 0.0, score="candidate_score").withColumnRenamed("rank", "source_rank")


@pytest.mark.parametrize("held", [500_000, 70, 0])
def test_search_in_memory_equals_joins(spark, monkeypatch, held):
    rng = random.Random(5)
    words = [a + b for a in "bcdfglmnprst" for b in ("ar", "el", "il", "on", "um")] + ["12", "7b", "007", "the", "inc"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(f"S{i % 3 + 1}-{i}", rng.choice(["us", "us", "fr", "", None, "jp" if i % 3 == 0 else "us"]), i % 3 + 1, text(6), text(8)) for i in range(400)]
    records = written(spark.createDataFrame(rows + [("S2-x", "us", 2, *rows[0][3:])], "id string, country string, src int, name string, address string"))
    monkeypatch.setattr(blocking.index, "HELD", held)
    passes = [blocking.Pass("name", {"name_word": 1.0, "name_pair": 0.5}, 6, 0.05, 25), blocking.Pass("addr", {"addr_word": 1.0, "addr_bigram": 1.0, "name_addr": 0.5}, 4, 0.1, 9)]
    every, best = joined_search(records, passes, catalog.RESCORE, 3)
    plain = lambda df, columns: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(columns).collect())
    columns = ["q", "t", "src", "score_name", "score_addr", "best_rank"]
    assert plain(blocking.search(records, passes), columns) == plain(every, columns) != []
    columns += ["sim_name_word", "sim_addr_word", "candidate_score", "source_rank"]
    assert plain(blocking.search(records, passes, catalog.RESCORE, 3), columns) == plain(best, columns) != []


def expected_f(ps, mass, beta=0.5):
    order = sorted(range(len(ps)), key=lambda i: (-ps[i], i))
    total, prefix, best, keep = sum(ps), 0.0, -1.0, 0
    for k, i in enumerate(order, 1):
        prefix += ps[i]
        e = (1 + beta**2) * prefix / (k + beta**2 * (total + mass))
        if e > best + 1e-12:
            best, keep = e, k
    none = math.prod(1 - min(p, 1 - 1e-12) for p in ps) * math.exp(-mass)
    return {order[i] for i in range(keep)} if best > none else set()


def test_expected_f(spark):
    rows = [(0, 0, 0.95), (0, 1, 0.9), (0, 2, 0.1), (1, 3, 0.05), (1, 4, 0.02), (2, 5, 0.6)]
    got = {r.t: r.selected for r in D.select_expected_f(spark.createDataFrame(rows, "q int, t int, p double")).collect()}
    assert [got[i] for i in range(6)] == [True, True, False, False, False, True]
    rng = random.Random(3)
    many = [(q, 100 * q + j, round(rng.random() ** 3, 4)) for q in range(60) for j in range(rng.randint(1, 6))]
    got = {(r.q, r.t) for r in D.select_expected_f(spark.createDataFrame(many, "q int, t int, p double")).where("selected").collect()}
    want = {(q, 100 * q + j) for q in range(60) for j in expected_f([p for a, _, p in many if a == q], 0.05)}
    assert got == want


def test_owner_and_exclusivity(spark):
    df = spark.createDataFrame([(0, 7, 0.9), (1, 7, 0.6), (2, 8, 0.5)], "q int, t int, p double").withColumn("selected", F.lit(True))
    assert {r.q: round(r.o, 6) for r in D.owner_normalized(df, "o").collect()} == {0: 0.6, 1: 0.4, 2: 0.5}
    assert {r.q: r.selected for r in D.exclusive(df).collect()} == {0: True, 1: False, 2: True}


def test_context(spark):
    df = spark.createDataFrame([(0, 5, 2, 3.0, 0.5), (0, 6, 2, 1.0, 0.95), (1, 5, 2, 2.0, 0.5)], "q int, t int, src int, score double, name_sim double")
    got = {(r.q, r.t): (r.q_margin, r.t_margin, r.t_competitors) for r in D.context_features(df).collect()}
    assert got == {(0, 5): (2.0, 1.0, 2), (0, 6): (-2.0, None, 1), (1, 5): (None, -1.0, 2)}


def test_f_beta(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "q string")
    pred = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 3), ("c", 1)], "q string, t int")
    true = spark.createDataFrame([("a", 1), ("a", 2), ("d", 4)], "q string, t int")
    got = {r.q: round(r.f05, 6) for r in M.per_query(q, pred, true).collect()}
    assert got == {"a": round(0.7142857, 6), "b": 1.0, "c": 0.0, "d": 0.0}


def test_lists_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("S1-1",), ("S1-2",)], "q string")
    pairs = spark.createDataFrame([("S1-1", "S2-9", 0.1), ("S1-1", "S3-1", 0.8)], "q string, t string, p double")
    lists = id_lists(q, pairs, "p")
    assert {r.q: r.ids for r in lists.collect()} == {"S1-1": "S3-1,S2-9", "S1-2": ""}
    write_lists(lists, str(tmp_path / "lists"))
    assert {(r.q, r.t) for r in read_lists(spark, str(tmp_path / "lists")).collect()} == {("S1-1", "S3-1"), ("S1-1", "S2-9")}


def test_raw_reader_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Foo ""Bar"" Inc"\tNA\t US \nS1-2\tnull\t5 Main St 02139\tus\n')
    rows = {r.entity_id: r for r in read_raw(spark, str(tmp_path / "in")).collect()}
    assert rows["S1-1"].business_name == 'Foo "Bar" Inc' and rows["S1-1"].business_address is None and rows["S1-2"].business_name is None
    query = normalise.write_stream(normalise.normalised(normalise.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    got = {r.entity_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["S1-1"].clean_name == "foo bar inc" and got["S1-1"].legal_suffix == "inc" and got["S1-2"].postal_code == "02139" and got["S1-1"].country == "us"


def test_all_stages(spark):
    rows = []
    for i in range(40):
        country, street = ("US", "Street") if i < 25 else ("France", "Rue")
        word = "".join(chr(97 + (i * 7 + j * 5) % 26) for j in range(7))
        rows += [(f"S1-{i}", f"{word} trading {i} inc", f"{100 + i} {word} {street}", country), (f"S2-{i}", f"{word} trading {i}", f"{100 + i} {word} {street}", country), (f"S3-{i}", f"{word} other bakery", f"{900 - i} nowhere {street}", country)]
    rows.append(("S1-99", "lonely", "1 road", "Japan"))
    records = written(blocking_records(spark.createDataFrame(rows, RAW), india=False))
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(40)], "q string, t string")
    found = matches(records, truth, trees=5).where("selected")
    queries = records.where("src = 1").select(F.col("id").alias("q"))
    result = M.evaluate(queries, found, truth).first()
    assert result.n_queries == 41 and result.macro_f05 > 0.9


def test_all_copies_count_as_true(spark, tmp_path):
    texts = ["one text in many copies"] * 30 + [f"another text {i}" for i in range(300)]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    classes = catalog.text_classes(spark, str(tmp_path))
    pairs = spark.createDataFrame([("S1-0-0", "S2-1-0"), ("S1-0-0", "S2-28-0"), ("S1-3-0", "S3-29-0"), ("S1-0-0", "S2-31-0")], "q string, t string")
    assert {(r.q, r.t): r.label for r in catalog.labelled(pairs, classes).collect()} == {("S1-0-0", "S2-1-0"): True, ("S1-0-0", "S2-28-0"): True, ("S1-3-0", "S3-29-0"): True, ("S1-0-0", "S2-31-0"): False}
    got = {r.id for r in catalog.QUERIES["val_split"](spark, str(tmp_path)).where("kind = 'target'").collect()}
    assert {f"S{i % 3 + 1}-{i}-0" for i in range(30) if i % 3} <= got and len(got) == 80


def test_rescoring_weights_are_of_the_default_passes(spark):
    got = catalog.QUERIES["rescore_weights"](spark, "/root/testdata/sf0.001").collect()
    assert {r.view for r in got} == set(Config().rescore)


def plan(spark, name):
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_budget_ranks_where_pairs_are_made(spark):
    found = plan(spark, "candidate_budget")
    assert "MapInArrow" in found and "Window" not in found.split("MapInArrow")[0]


def test_passes_meet_without_a_shuffle_of_pairs(spark):
    assert "Aggregate" not in plan(spark, "union_passes").split("MapInArrow")[0]


def test_split_cleans_texts_once(spark):
    assert "text#" not in plan(spark, "val_split")


def test_structure_of_true_pairs_reads_documents_once_a_side(spark):
    assert plan(spark, "jaccard_tokens").count("Relation [") == 2


def test_pair_structure_reads_documents_once_a_side(spark):
    found = plan(spark, "pair_structure")
    assert found.count("Relation [") == 2 and found.count("Join") == 1


def test_default_blocking_makes_pairs_in_memory(spark):
    found = plan(spark, "blocking_default")
    assert "MapInArrow" in found and "Window" not in found.split("MapInArrow")[0]


def test_blocking_in_memory_equals_joins(spark, monkeypatch):
    rng = random.Random(7)
    words = [a + b + c for a in "bcdfgt" for b in ("ar", "el", "schi", "ow") for c in ("", "k", "anter")] + ["12", "7b", "007", "the", "a", "naïve", "ⓧ9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(f"S{i % 3 + 1}-{i}", rng.choice(["us", "us", "fr", None, "jp" if i % 3 == 0 else "us"]), i % 3 + 1, text(6), rng.choice(["", text(8)])) for i in range(300)]
    rows += [("S1-z", "us", 1, "жук ж" + "x" * 70, "12 ёж"), ("S2-x", "us", 2, *rows[0][3:]), ("S2-y", "us", 2, "a " * 40 + "bar cel " * 9, "12 row " * 30)]
    records = written(spark.createDataFrame(rows, "id string, country string, src int, name string, address string"))
    plain = lambda: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in candidates(records).select(columns).collect())
    columns = ["q", "t", "src", "score_name", "score_addr", "score_name_addr", "best_rank", *(f"sim_{v}" for v in Config().rescore), "missing_address", "candidate_score", "source_rank"]
    monkeypatch.setattr(blocking.index, "BLOCK", 50)
    held = plain()
    monkeypatch.setattr(blocking.index, "HELD", 0)
    assert held == plain() != [] and {r[-3] for r in held} == {True, False}


def test_weights_streamed_equal_those_of_written_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = [a + b for a in "bcdfglmnprst" for b in ("ar", "el", "schi", "on", "um")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    rows = [(f"S{i % 3 + 1}-{i}", rng.choice(["us", "fr"]), i % 3 + 1, text(5), text(6), f"{i}") for i in range(240)]
    near = lambda x: " ".join(w for w in x.split() if rng.random() < 0.8)
    rows += [(f"S2-c{i}", r[1], 2, near(r[3]), near(r[4]), r[5]) for i, r in enumerate(rows) if r[2] == 1]
    records = written(spark.createDataFrame(rows, "id string, country string, src int, name string, address string, tag string"))
    config, views = Config(), list(Config().rescore)
    pairs = blocking.LabelledPairs(records, config.passes, views)
    q, t = catalog.shared_sides(records, config.views)
    classes = records.select("id", F.col("tag").alias("h"))
    joined = catalog.labelled(blocking.pair_cosines(union_passes({p.name: blocking.retrieve(q, t, p) for p in config.passes}), q, t, views), classes)
    plain = lambda df: sorted(tuple(round(x, 6) for x in r) for r in df.select(*(f"sim_{v}" for v in views), "label").collect())
    assert plain(pairs.rows()) == plain(joined) and {r[-1] for r in plain(joined)} == {0, 1}
    want = models.rescore_weights(written(joined).withColumn("missing_address", F.lit(False)), views)
    assert models.rescore_weights_streamed(pairs) == want
    close = lambda got: all(abs(got[v] - want[v]) < 0.01 for v in views)
    assert close(models.rescore_weights_streamed(pairs, start=40))
    monkeypatch.setattr(blocking.index, "HELD", 90)
    assert close(models.rescore_weights_streamed(blocking.LabelledPairs(records, config.passes, views), start=40))


def packed_records(rng, kind, name, n):
    words = [a + b + c for a in "bcdfgt" for b in ("ar", "el", "schi", "ow") for c in ("", "k", "anter")] + ["12", "7b", "007", "the", "a", "naïve", "ⓧ9"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(f"{name}-{i}", text(6), rng.choice(["", text(8)]), text(5), f"{i % 50}") for i in range(n)]
    rows += [(f"{name}-x", "жук ж" + "x" * 70, "12 ёж", "gg tt", ""), (f"{name}-y", "a " * 40 + "bar cel " * 9, "12 row " * 30, "gr " * 20, "")]
    rng.shuffle(rows)
    for at in range(0, len(rows), 97):
        some = rows[at : at + 97]
        fixed = [pa.array([x] * len(some), pa.int32()) for x in (0, 1, kind, 2)]
        batch = pa.RecordBatch.from_arrays([*fixed, *map(pa.array, zip(*some))], names=["g", "copies", "kind", "src", *index.TEXTS])
        yield from index._packed(iter([batch]))


SEARCHES = {
    "retrieve_name_addr": ((catalog.MIX_PASS,), {}, 0, 0.0, 6, False),
    "retrieve_addr": ((catalog.ADDR_PASS,), {}, 0, 0.0, 6, False),
    "retrieve_name": ((catalog.NAME_PASS,), {}, 0, 0.0, 6, False),
    "union_passes": ((catalog.NAME_PASS, catalog.ADDR_PASS), {}, 0, 0.0, 6, False),
    "candidate_budget": ((catalog.NAME_PASS, catalog.ADDR_PASS), catalog.RESCORE, 15, 0.0, 6, False),
    "blocking_default": (Config().passes, Config().rescore, 15, 0.0, 0, True),
    "rescore_weights": (Config().passes, Config().rescore, 0, 0.0, 0, False, True),
    "rare": ((blocking.Pass("name", {"name_word": 1.0, "name_pair": 1.0}, 6, 0.05, 25), blocking.Pass("addr", {"addr_bigram": 1.0, "name_addr": 0.5}, 4, 0.1, 9)), catalog.RESCORE, 3, 0.0, 6, False),
}


@pytest.mark.parametrize("name", SEARCHES)
def test_search_of_many_targets_equals_that_of_few(monkeypatch, name):
    """Many: keys are made for a block of queries at a time, sorted in ranges or counted."""
    rng = random.Random(3)
    rows = [*packed_records(rng, 0, "S2", 400), *packed_records(rng, 1, "S1", 120)]
    plain = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r.values()) for b in index._searched(*SEARCHES[name])(iter(rows)) for r in b.to_pylist())
    few = plain()
    monkeypatch.setattr(index, "NARROW", 0)
    for sizes in ({}, {"SORTED": 300, "COUNTED": 50, "ASKED": 200, "QUERIES": 32}, {"SORTED": 100_000, "COUNTED": 0, "ASKED": 1, "QUERIES": 20}):
        for k, v in sizes.items():
            monkeypatch.setattr(index, k, v)
        assert plain() == few != []


@pytest.mark.parametrize("views, blank", [(["name_word"], "addresses"), (["addr_word"], "names")])
def test_words_that_no_view_reads_are_not_written(spark, views, blank):
    records = spark.createDataFrame([("S1-1", "us", 1, "one two", "3 four")], "id string, country string, src int, name string, address string")
    row = blocking.searched_texts(records, views)[0].first()
    assert row[blank] == "" and {row.names, row.addresses} != {""}
    assert "" not in blocking.searched_texts(records, ["name_word"], missing=True)[0].first()


def test_many_targets_are_searched_everywhere_for_a_country_without_any(spark, monkeypatch):
    words = ["bar", "cel", "dow", "fan", "gil", "tor"]
    rows = [(f"S{i % 3 + 1}-{i}", "es" if i % 3 == 0 else ["fr", "us"][i % 2], i % 3 + 1, f"{words[i % 6]} {words[i // 6 % 6]} n{i % 11}", "") for i in range(120)]
    records = written(spark.createDataFrame(rows, "id string, country string, src int, name string, address string"))
    found = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in blocking.search(records, [catalog.NAME_PASS]).collect())
    few = found()
    monkeypatch.setattr(index, "NARROW", 0)
    assert found() == few != []
