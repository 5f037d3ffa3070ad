"""The 52 features of a candidate pair: strings, tokens, structure, blocking and context. No feature uses the country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import similarity
from ..functions.text import house_number, phonetic_name
from .blocking import with_tokens
from .decision import context_features

NAME_METRICS = {"name_ratio": "ratio", "name_token_sort": "token_sort", "name_token_set": "token_set", "name_partial": "partial", "name_jw": "jw"}
ADDRESS_METRICS = {"addr_ratio": "ratio", "addr_token_set": "token_set", "addr_token_sort": "token_sort", "addr_partial_token_set": "partial_token_set"}
STRINGS = [*NAME_METRICS, "name_phon_ratio", *ADDRESS_METRICS]
TOKENS = [f"{v}_{x}" for v in ("name", "addr", "num") for x in ("inter", "jaccard", "count_q", "count_c")]
STRUCTURE = ["num_conflict", "house_eq", "house_prefix", "first_token_eq", "name_len_q", "name_len_c", "has_addr_q", "has_addr_c"]
BLOCKING = ["score_name", "score_addr", "score_name_addr", "candidate_score", "source_rank", "sim_name_char", "sim_name_phon", "sim_addr_word", "sim_addr_bigram", "sim_name_addr"]
CONTEXT = ["q_margin", "q_rank", "q_size", "qs_margin", "t_margin", "t_rank", "t_competitors", "q_rel_score", "q_n_strong", "q_n_name_dupes", "t_n_name_dupes"]
FEATURES = [*STRINGS, *TOKENS, *STRUCTURE, *BLOCKING, *CONTEXT, "is_s2"]


def match_records(records: DataFrame, columns=()) -> DataFrame:
    """One row a record with all that pairs read of it, so that it is derived once a record and not once a pair, and further columns."""
    r = with_tokens(records)
    name = F.array_join("nt", " ")
    numbers = F.array_distinct(F.filter("at", lambda x: x.rlike(r"^\d+$")))
    return r.select("id", name.alias("name"), phonetic_name("nt").alias("phon"), F.array_join("at", " ").alias("addr"), F.array_distinct("nt").alias("names"), F.array_distinct("at").alias("addrs"), numbers.alias("nums"), house_number("at").alias("house"), F.try_element_at("nt", F.lit(1)).alias("first"), F.length(F.array_join("nt", "")).alias("len"), (F.size("at") > 0).alias("has"), *columns)


def sides(records: DataFrame, c: str) -> DataFrame:
    """The columns of match_records as those of one side, q or c, of pairs."""
    return records.select(*(F.col(x).alias(f"{c}_{x}") for x in records.columns))


def compared() -> dict[str, Column]:
    """TOKENS, STRUCTURE and is_s2 of pairs that hold both sides and src."""
    both, columns = F.col("q_has") & F.col("c_has"), {}
    for v, field in (("name", "names"), ("addr", "addrs"), ("num", "nums")):
        inter, nq, nc = F.size(F.array_intersect(f"q_{field}", f"c_{field}")), F.size(f"q_{field}"), F.size(f"c_{field}")
        jaccard = F.try_divide(inter.cast("double"), (nq + nc - inter).cast("double"))
        columns |= {f"{v}_inter": F.when(both, inter) if v == "addr" else inter, f"{v}_jaccard": F.when(both, jaccard) if v == "addr" else jaccard, f"{v}_count_q": nq, f"{v}_count_c": nc}
    columns["num_conflict"] = F.when((F.size("q_nums") > 0) & (F.size("c_nums") > 0), (F.size(F.array_intersect("q_nums", "c_nums")) == 0).cast("int"))
    columns["house_eq"] = (F.col("q_house") == F.col("c_house")).cast("int")
    columns["house_prefix"] = (F.col("q_house").startswith(F.col("c_house")) | F.col("c_house").startswith(F.col("q_house"))).cast("int")
    columns["first_token_eq"] = F.coalesce((F.col("q_first") == F.col("c_first")).cast("int"), F.lit(0))
    columns |= {"name_len_q": F.col("q_len"), "name_len_c": F.col("c_len"), "has_addr_q": F.col("q_has").cast("int"), "has_addr_c": F.col("c_has").cast("int"), "is_s2": (F.col("src") == 2).cast("int")}
    return columns


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs(q, t, src and BLOCKING columns) with FEATURES. What can't be known is null: addresses unless both sides have one, house
    numbers unless both do, margins of a lone pair."""
    side = lambda c, key: records.select(F.col("id").alias(key), *(F.col(x).alias(f"{c}_{x}") for x in records.columns if x != "id"))
    out = pairs.join(side("q", "q"), "q").join(side("c", "t"), "t")
    both = F.col("q_has") & F.col("c_has")
    known = {c: F.when(both, F.col(f"{c}_addr")) for c in "qc"}
    columns = {n: similarity(m, F.col("q_name"), F.col("c_name")) for n, m in NAME_METRICS.items()}
    columns["name_phon_ratio"] = similarity("ratio", F.col("q_phon"), F.col("c_phon"))
    columns |= {n: similarity(m, known["q"], known["c"]) for n, m in ADDRESS_METRICS.items()}
    columns |= compared()
    context = context_features(pairs.select("q", "t", "src", F.col("candidate_score").alias("score"), F.greatest("sim_name_char", "sim_name_phon").alias("name_sim"))).select("q", "t", *CONTEXT)
    return out.withColumns(columns).select(*pairs.columns, *(f for f in FEATURES if f not in pairs.columns and f not in CONTEXT)).join(context, ["q", "t"])
