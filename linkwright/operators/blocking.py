"""Candidate generation: weighted TF-IDF over rare keys with a top k per query, then exact rescoring under a budget.

Records are (id, country, src, name, address) with cleaned text; src 1 holds the queries. Nothing crosses a country, except that
a country without targets in a source is searched in all of that source.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import derived, view
from ..functions.text import address_tokens, name_tokens, phonetic_key, words
from ..plans.tables import written
from . import index

EVERYWHERE = "*"


@dataclass(frozen=True)
class Pass:
    name: str
    weights: dict[str, float]
    k: int = 20
    min_score: float = 0.1
    max_df: int = 3000


@dataclass(frozen=True)
class Config:
    """The default passes, rescoring weights and budget."""

    passes: tuple[Pass, ...] = (
        Pass("name", {"name_word": 1.0, "name_pair": 1.0, "name_pkey_pair": 1.0, "name_compact": 0.5}, 50, 0.05, 1000),
        Pass("addr", {"addr_word": 1.0, "addr_bigram": 1.0}, 50, 0.05, 1000),
        Pass("name_addr", {"name_addr": 1.0, "name_pair": 0.5, "addr_bigram": 0.5}, 50, 0.05, 1000),
    )
    rescore: dict[str, float] = field(default_factory=lambda: {"name_char": 2.81, "name_phon": 4.33, "addr_word": 8.45, "addr_bigram": 2.14, "name_addr": 2.95})
    budget: int = 15
    min_score: float = 0.0

    @property
    def views(self) -> list[str]:
        return list(dict.fromkeys([v for p in self.passes for v in p.weights] + list(self.rescore)))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Config:
        """Settings that are left out keep their defaults; an unknown one is a TypeError."""
        found = json.loads(text)
        if "passes" in found:
            found["passes"] = tuple(Pass(**p) for p in found["passes"])
        return Config(**found)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\0").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str | None) -> Config:
        """The settings in a JSON file or a folder made by save; the defaults without a path."""
        return Config.from_json(spark.read.text(path, wholetext=True).first()[0].rstrip("\0")) if path else Config()


def with_tokens(records: DataFrame) -> DataFrame:
    return records.withColumn("nt", name_tokens("name")).withColumn("at", address_tokens("address"))


def record_keys(tokens: DataFrame, views: list[str]) -> DataFrame:
    """(id, country, src, view, key): one pass over the records, whatever the number of views."""

    def named(v: str) -> Column:
        return F.transform(view(v), lambda key: F.struct(F.lit(v).alias("view"), key.alias("key")))

    both = [named(v) for v in views]
    return derived(tokens, views).select("id", "country", "src", F.explode(F.flatten(F.array(*both))).alias("x")).select("id", "country", "src", "x.view", "x.key")


def search_parts(queries: DataFrame, targets: DataFrame, columns=()) -> tuple[DataFrame, DataFrame]:
    """(id, src, part) of queries and of targets: part is the country, or EVERYWHERE for a country that the source lacks. columns of
    both go with them."""
    there = targets.select("src", "country").distinct()
    sources = F.broadcast(targets.select("src").distinct())
    wanted = queries.select("id", "country", *columns).crossJoin(sources).join(F.broadcast(there.withColumn("found", F.lit(True))), ["src", "country"], "left")
    asked = wanted.select("id", "src", F.when(F.col("found"), F.col("country")).otherwise(EVERYWHERE).alias("part"), *columns)
    lacking = F.broadcast(asked.where(F.col("part") == EVERYWHERE).select("src").distinct())
    held = targets.select("id", "src", F.col("country").alias("part"), *columns)
    return asked, held.union(targets.select("id", "src", *columns).join(lacking, "src", "left_semi").select("id", "src", F.lit(EVERYWHERE), *columns))


def document_frequency(target_keys: DataFrame, target_parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, src, view, key, df) and (part, src, n)."""
    sizes = target_parts.groupBy("part", "src").agg(F.count("*").alias("n"))
    keyed = target_keys.select("id", "src", "view", "key").join(target_parts, ["id", "src"])
    return keyed.groupBy("part", "src", "view", "key").agg(F.count("*").alias("df")), sizes


def idf(n, df) -> Column:
    return F.log((F.col(n) + 1) / (F.coalesce(F.col(df), F.lit(0)) + 1)) + 1


def weighted(keys: DataFrame, parts: DataFrame, df: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, part, src, view, key, w, df): TF-IDF rows of unit length in each view; a key that no target holds counts in the length."""
    rows = keys.drop("country", "src").join(parts, "id").join(F.broadcast(sizes), ["part", "src"]).join(df, ["part", "src", "view", "key"], "left")
    rows = rows.withColumn("idf", idf("n", "df"))
    length = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("id", "part", "src", "view")))
    return rows.select("id", "part", "src", "view", "key", (F.col("idf") / length).alias("w"), "df")


def top_k(scored: DataFrame, k: int, min_score: float, group=("q", "src"), score: str = "score") -> DataFrame:
    """The k best of each group with rank from 0; ties by t."""
    # Rounded, so that the order in which a shuffle sums can't change ranks. The limit is on row_number itself: so Spark drops what
    # is beyond it in each partition before the shuffle.
    best = Window.partitionBy(*group).orderBy(F.desc(F.round(score, 9)), "t")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.where(F.col(score) >= min_score).withColumn("rank", F.col("rank") - 1)


def retrieve(q: DataFrame, t: DataFrame, p: Pass) -> DataFrame:
    """(q, t, src, score, rank): an inverted index. Keys of more than max_df targets are dropped before the join, so that no key
    pairs a query with more than max_df targets.

    The targets of a key, at most max_df, are one array of a written table: the join still sees two plain shuffles, which AQE
    can split where many queries share a key, and arrays go to their queries before they are unfolded, so that sums and ranks
    need no further shuffle.
    """
    weight = F.create_map(*(F.lit(x) for kv in p.weights.items() for x in kv))
    key = ["part", "src", "view", "key"]
    rare = lambda side: side.where(F.col("view").isin(*p.weights)).where(F.col("df") <= p.max_df)
    left = rare(q).select(*key, F.col("id").alias("q"), (F.col("w") * weight[F.col("view")]).alias("qw"))
    postings = written(rare(t).groupBy(*key).agg(F.collect_list(F.struct(F.col("id").alias("t"), F.col("w").alias("tw"))).alias("held")))
    found = left.join(postings, key).select("q", "src", "qw", "held").repartition("q", "src")
    scored = found.select("q", "src", "qw", F.inline("held")).groupBy("q", "t", "src").agg(F.sum(F.col("qw") * F.col("tw")).alias("score"))
    return top_k(scored, p.k, p.min_score)


def search(records: DataFrame, passes, rescore: dict[str, float] | None = None, budget: int = 15, min_score: float = 0.0, digits: int = 6, missing: bool = False) -> DataFrame:
    """(q, t, src, score_<pass>, best_rank): union_passes of retrieve for each pass. With rescore also sim_<view> and candidate_score of
    `digits` digits (0: all), of which the budget's best stay, with source_rank; with missing also missing_address, with which names
    alone count.

    Where a source has at most index.HELD targets of a part, these are held in memory; the others go by joins, as do views that are not
    in index.VIEWS.
    """
    few, joined, q, t, tokens = _sides(records, passes, rescore, missing=missing)
    if joined is None:
        return index.search(*few, passes, rescore, budget, min_score, digits, missing)
    if rescore:
        scored = pair_cosines(written(joined), q, t, list(rescore)).withColumn("missing_address", F.lit(False))
        if missing:
            bare = lambda x: tokens.select(F.col("id").alias(x), (F.size(words("addresses")) == 0).alias(f"{x}_bare"))
            scored = scored.join(bare("q"), "q").join(bare("t"), "t").withColumn("missing_address", F.col("q_bare") | F.col("t_bare"))
        score = candidate_score(rescore, F.col("missing_address"))
        scored = scored.withColumn("candidate_score", F.round(score, digits) if digits else score)
        joined = top_k(scored, budget, min_score, score="candidate_score").withColumnRenamed("rank", "source_rank")
    if few is None:
        return joined.drop("q_bare", "t_bare", *([] if missing else ["missing_address"]))
    found = index.search(*few, passes, rescore, budget, min_score, digits, missing)
    return found.unionByName(joined.select(*found.columns))


def _sides(records: DataFrame, passes, rescore, columns=(), missing: bool = False) -> tuple:
    """((asked, held) for index.search, or None; the union of the passes by joins, or None, with both weighted sides; tokens)."""
    views = list(dict.fromkeys([v for p in passes for v in p.weights] + list(rescore or {})))
    tokens, texts = searched_texts(records, views, columns, missing)
    queries, targets = tokens.where("src = 1"), tokens.where("src <> 1")
    asked, held = search_parts(queries, targets, texts)
    sizes = held.groupBy("part", "src").agg(F.count("*").alias("n"))
    most = index.HELD if set(views) <= set(index.VIEWS) else 0
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most:
        return (asked, held), None, None, None, tokens
    many = F.broadcast(sizes.where(F.col("n") > most).select("part", "src"))
    few = [x.join(many, ["part", "src"], "left_anti") for x in (asked, held)]
    asked, held = (x.select("id", "src", "part").join(many, ["part", "src"], "left_semi") for x in (asked, held))
    split = lambda side: side.withColumns({"nt": words("names"), "at": words("addresses")})
    keys = record_keys(split(targets), views)
    df, sizes = document_frequency(keys, held)
    df = written(df)
    q, t = written(weighted(record_keys(split(queries), views), asked, df, sizes)), written(weighted(keys, held, df, sizes))
    return few if most else None, union_passes({p.name: retrieve(q, t, p) for p in passes}), q, t, tokens


class LabelledPairs:
    """All candidate pairs of some passes, with exact cosines and whether both records are of one class, for fitting. records have a
    class as `tag`. Pairs of targets that are held in memory are made again whenever they are read, those by joins once."""

    def __init__(self, records: DataFrame, passes, views: list[str]):
        self.passes, self.views = passes, views
        self.few, joined, q, t, tokens = _sides(records, passes, dict.fromkeys(views, 1.0), ["tag"])
        self.joined = None
        if joined is not None:
            tag = lambda x: tokens.select(F.col("id").alias(x), F.col("tag").alias(f"{x}_tag"))
            pairs = pair_cosines(written(joined), q, t, views).join(tag("q"), "q").join(tag("t"), "t")
            self.joined = written(pairs.select("q", *(f"sim_{v}" for v in views), (F.col("q_tag") == F.col("t_tag")).alias("label")))
        self.queries = tokens.where("src = 1").count()

    def rows(self, one_in: int = 1) -> DataFrame:
        """(sim_<view>, label) of the pairs of one query in so many, by hash."""
        mine = lambda df, c: df if one_in == 1 else df.where(F.pmod(F.xxhash64(c, F.lit(1)), F.lit(one_in)) == 0)
        out = None if self.few is None else index.labelled(mine(self.few[0], "id"), self.few[1], self.passes, self.views)
        joined = None if self.joined is None else mine(self.joined, "q").drop("q")
        return out if joined is None else joined if out is None else out.unionByName(joined)

    def sums(self, theta: list[float]) -> list[float]:
        """Sums of index.logistic over all pairs, at coefficients and intercept theta."""
        out = [] if self.few is None else [index.labelled(*self.few, self.passes, self.views, theta)]
        out += [] if self.joined is None else [index.logistic_sums(self.joined, self.views, theta)]
        size = 2 * index.logistic_size(len(self.views))
        found = [df.agg(*(F.sum(F.col("sums")[i]) for i in range(size))).first() for df in out]
        return [sum(x or 0.0 for x in xs) for xs in zip(*found, strict=True)]


def searched_texts(records: DataFrame, views: list[str], columns=(), missing: bool = False) -> tuple[DataFrame, list[str]]:
    """A written table of (id, country, src, names, addresses, perhaps sounds, columns), and the names of all columns that search_parts
    is to carry: texts of words, and of sounds if views read these. What no view reads (and missing doesn't ask for) is ''."""
    read = {"nt": any(v.startswith("name") for v in views), "at": missing or any(v.startswith("addr") or v == "name_addr" for v in views)}
    text = lambda c: (F.coalesce(F.array_join(c, " "), F.lit("")) if read[c] else F.lit("")).alias({"nt": "names", "at": "addresses"}[c])
    tokens = with_tokens(records).select("id", "country", "src", text("nt"), text("at"), *columns)
    if {"name_phon", "name_pkey", "name_pkey_pair"} & set(views):
        tokens = tokens.withColumn("sounds", phonetic_key("names"))
    tokens = written(tokens)
    return tokens, [c for c in tokens.columns if c not in ("id", "country", "src")]


def posting_stats(t: DataFrame, p: Pass) -> DataFrame:
    kept = t.where(F.col("view").isin(*p.weights)).where(F.col("df") <= p.max_df)
    per = kept.groupBy("part", "src", "view", "key").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("keys"), F.sum("n").alias("postings"), F.max("n").alias("longest"))


def union_passes(results: dict[str, DataFrame]) -> DataFrame:
    """(q, t, src, score_<pass>, best_rank): a pass that missed a pair scores 0."""
    rows = None
    for name, r in results.items():
        one = r.select("q", "t", "src", F.lit(name).alias("pass"), "score", "rank")
        rows = one if rows is None else rows.unionByName(one)
    scores = [F.coalesce(F.max(F.when(F.col("pass") == n, F.col("score"))), F.lit(0.0)).alias(f"score_{n}") for n in results]
    return rows.groupBy("q", "t", "src").agg(*scores, F.min("rank").alias("best_rank"))


def pair_cosines(pairs: DataFrame, q: DataFrame, t: DataFrame, views: list[str]) -> DataFrame:
    """pairs with sim_<view>: exact cosines of given pairs, 0 where nothing is shared. All keys count, however frequent."""
    left = q.where(F.col("view").isin(*views)).select("src", "view", "key", F.col("id").alias("q"), "part", F.col("w").alias("qw"))
    right = t.where(F.col("view").isin(*views)).select("src", "view", "key", F.col("id").alias("t"), "part", F.col("w").alias("tw"))
    shared = pairs.select("q", "t", "src").join(left, ["q", "src"]).join(right, ["t", "src", "part", "view", "key"])
    sims = [F.sum(F.when(F.col("view") == v, F.col("qw") * F.col("tw")).otherwise(0.0)).alias(f"sim_{v}") for v in views]
    return pairs.join(shared.groupBy("q", "t", "src").agg(*sims), ["q", "t", "src"], "left").fillna(0.0, [f"sim_{v}" for v in views])


def candidate_score(weights: dict[str, float], missing_address: Column) -> Column:
    """Weighted similarities; without an address on either side the name part stands for all, scaled to the same range."""
    names = {v: w for v, w in weights.items() if not v.startswith(("addr_", "name_addr"))}
    total = lambda ws: sum((F.col(f"sim_{v}") * w for v, w in ws.items()), F.lit(0.0))
    return F.when(missing_address, total(names) * (sum(weights.values()) / sum(names.values()))).otherwise(total(weights))


def candidates(records: DataFrame, config: Config = Config()) -> DataFrame:
    """(q, t, src, score_<pass>, best_rank, sim_<view>, missing_address, candidate_score, source_rank): the whole of blocking."""
    return search(records, config.passes, config.rescore, config.budget, config.min_score, digits=0, missing=True)


def dense_top_k(queries: DataFrame, targets: DataFrame, k: int = 10, min_score: float = 0.5, block: int = 100_000) -> DataFrame:
    """(q, t, src, score, rank) by exact cosine within a part. queries(q, part, v) are a stated set, targets(t, src, part, v) of any
    number; part bounds the comparisons. A record that is on both sides isn't its own match.

    Targets of a part are dealt over blocks of about `block`, and its queries go to each, so that a part isn't one task; the best
    k of each task are taken before the shuffle by query.
    """
    unit = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    dot = F.aggregate(F.zip_with("v", "u", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    blocks = targets.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    left = queries.withColumn("vn", unit("v")).join(blocks, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = targets.withColumnRenamed("v", "u").withColumn("un", unit("u")).join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("t"), "blocks").cast("int")).drop("blocks")
    scored = left.join(right, ["part", "block"]).where("q <> t").select("q", "t", "src", (dot / (F.col("vn") * F.col("un"))).alias("score"))
    return top_k(scored, k, min_score)
