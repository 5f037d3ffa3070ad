"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding homoglyphs and digit substitutions.

The lexicon is learned: whole words and word beginnings whose document frequency differs most between toxic and other labelled
documents, weighted by log odds. Phrases of a lexicon entry and a neighbouring word that occur in documents labelled clean are
exceptions and hits in them don't count. The weight of all hits is normalised by length and mapped to a probability.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import fold_of, forget, training_sample, tune, written

#: Labelled documents used to learn the lexicon, and its entries, at most.
SAMPLE_ROWS, MOST_ENTRIES, MOST_PHRASES = 20_000, 1_000, 1_000
#: Digits and signs that stand for letters, and look-alike letters of other scripts.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ԁ": "d", "ո": "n", "м": "m", "т": "t", "к": "k", "ο": "o", "α": "a", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k"}
_TABLE = str.maketrans(SIGNS | LOOKALIKES | dict.fromkeys("​‌‍⁠﻿­") | dict.fromkeys("\t\n\v\f\r!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”’‘…–—¡¿", " "))
_WIDE = {0xFEE0 + c: c for c in range(0x21, 0x7F)}


def fold(text: str | None) -> str:
    """Lower case, look-alikes and signs as letters, punctuation as spaces, with a space at either end."""
    text = text or ""
    if not text.isascii():
        text = text.translate(_WIDE)
    return f" {text.lower().translate(_TABLE)} "


def entries(words: list[str]) -> set[str]:
    """What a text offers to the lexicon: " word " and the beginnings " wor"."""
    distinct = {w for w in words if 3 <= len(w) <= 40}
    return {f" {w} " for w in distinct} | {f" {w[:k]}" for w in distinct for k in (4, 5, 6) if len(w) >= k}


def _counts(only: frozenset[str] | None):
    """Documents with an entry by label, of all entries or of some. contexts: the words that follow it, so that
    copies of one passage, where it always stands before the same word, count once."""

    def run(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = fold(text).split()
                of_text = entries(words)
                for e in of_text if only is None else of_text & only:
                    found.setdefault(e, [0, 0, set()])[toxic] += 1
                if only is None:
                    for word, following in zip(words, [*words[1:], ""], strict=True):
                        for e in entries([word]):
                            found[e][2].add(following)
        columns = [[c for c, _, _ in found.values()], [t for _, t, _ in found.values()], [sorted(x) for _, _, x in found.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True))], ["entry", "clean", "toxic", "contexts"])

    return run


def evidence(clean: int, toxic: int, share: float) -> float:
    """How far the documents of an entry are from the sample's share of toxic ones, as a log likelihood ratio."""
    n = clean + toxic
    terms = ((toxic, share), (clean, 1 - share))
    return sum(k * float(np.log(k / n / q)) for k, q in terms if k)


def weights_of(counts: dict[str, tuple[int, int]], clean: int, toxic: int, least: float = 2.0, surely: float = 10.0) -> dict[str, float]:
    """Log odds of the entries that tell toxic from clean, beyond what so many entries show by chance; an entry goes if its own
    beginning does as well."""
    if not clean or not toxic:
        return {}
    share = toxic / (clean + toxic)
    counts = {e: (c, t) for e, (c, t) in counts.items() if evidence(c, t, share) >= surely}
    odds = {e: float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))) for e, (c, t) in counts.items()}
    picked = sorted((e for e, w in odds.items() if w >= least), key=lambda e: (-odds[e] * counts[e][1] ** 0.5, e))[: 4 * MOST_ENTRIES]
    kept: dict[str, float] = {}
    for e in sorted(picked, key=lambda e: (len(e), e)):
        if not any(e[:k] in kept and kept[e[:k]] >= odds[e] - 1 for k in range(5, len(e))):
            kept[e] = odds[e]
    return {e: kept[e] for e in [e for e in picked if e in kept][:MOST_ENTRIES]}


class Lexicon:
    """Entries with weights, exception phrases, and the two numbers that map a weight per length to a probability."""

    def __init__(self, weights: dict[str, float], phrases: frozenset[str] = frozenset(), slope: float = 1.0, offset: float = -2.0):
        self.weights, self.phrases, self.slope, self.offset = weights, phrases, slope, offset

    def __reduce__(self):
        return Lexicon, (self.weights, self.phrases, self.slope, self.offset)

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for e, w in self.weights.items():
            found.add_word(e, (len(e), w, e in self.phrases))
        for p in self.phrases - self.weights.keys():
            found.add_word(p, (len(p), 0.0, True))
        if len(found):
            found.make_automaton()
        return found if len(found) else None

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries outside exception phrases; of entries that begin at one place, the weightiest."""
        if self.automaton is None:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for end, (size, weight, exception) in self.automaton.iter(folded):
            start = end - size + 1
            if exception:
                spared.append((start, end + 1))
            elif start not in best or weight > best[start][1]:
                best[start] = (end + 1, weight)
        found, exceptions, reach, i = [], sorted(spared), 0, 0
        for start, (end, weight) in sorted(best.items()):
            while i < len(exceptions) and exceptions[i][0] <= start:
                reach, i = max(reach, exceptions[i][1]), i + 1
            if start >= reach:
                found.append((start, end, weight))
        return found

    def rate(self, text: str | None) -> float:
        """Weight of all hits by the square root of the number of words."""
        folded = fold(text)
        hits = self.hits(folded)
        return sum(w for _, _, w in hits) / (10 + folded.count(" ")) ** 0.5 if hits else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(8 * self.rate(text)) + self.offset, -30, 30))))


def _contexts(lexicon: Lexicon):
    """Phrases of a hit and the word before or after it, with counts of documents by label."""

    def run(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, phrases = fold(text), set()
                for start, _, _ in lexicon.hits(folded):
                    word = folded.find(" ", start + 1)
                    following = folded[word + 1 : folded.find(" ", word + 1)] if 0 <= word < len(folded) - 1 else ""
                    before = folded[:start].rsplit(" ", 1)[-1] if start < 60 else folded[start - 60 : start].rsplit(" ", 1)[-1]
                    phrases |= {f"{folded[start : word + 1]}{following} "} if following else set()
                    phrases |= {f" {before}{folded[start : word + 1]}"} if before else set()
                for p in phrases:
                    found.setdefault(p, [0, 0])[toxic] += 1
        counts = [pa.array([n[i] for n in found.values()], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *counts, pa.array([[]] * len(found), pa.list_(pa.string()))], ["entry", "clean", "toxic", "contexts"])

    return run


def _rates(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.rate(t) for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], ["rate", "toxic"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of a balanced logistic fit, slightly regularised."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    rows, beta = np.stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ rows, -30, 30)))
        gradient = rows @ (w * (p - y)) + 1e-3 * beta
        beta -= np.linalg.solve((rows * (w * p * (1 - p))) @ rows.T + 1e-3 * np.eye(2), gradient)
    return float(beta[0]), float(beta[1])


COUNTS = "entry string, clean long, toxic long, contexts array<string>"


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from at most `rows` documents that labels(doc_id, toxic) marks, outside the held-out fold. Nulls are no labels.

    Texts stay on the executors; the driver gets counts of at most a few thousand entries and one number a sampled document.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = written(training_sample(docs, marked, rows), "sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    total = lambda counted: counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = max(3, round(0.004 * toxic))
    contexts = F.size(F.array_distinct(F.flatten(F.collect_list("contexts"))))
    often = sample.where("toxic = 1").mapInArrow(_counts(None), COUNTS).groupBy("entry").agg(F.least(F.sum("toxic"), contexts).alias("toxic"))
    often = often.where(F.col("toxic") >= least).orderBy(F.desc("toxic"), "entry").limit(40 * MOST_ENTRIES)
    counted = {r["entry"]: r["toxic"] for r in often.collect()}
    in_clean = {r["entry"]: r["clean"] for r in total(sample.where("toxic = 0").mapInArrow(_counts(frozenset(counted)), COUNTS)).collect()}
    weights = weights_of({e: (in_clean.get(e, 0), t) for e, t in counted.items()}, clean, toxic)
    phrases = total(sample.mapInArrow(_contexts(Lexicon(weights)), COUNTS)).where("clean >= 3 and clean > 4 * toxic").orderBy(F.desc("clean"), "entry").limit(MOST_PHRASES)
    lexicon = Lexicon(weights, frozenset(r["entry"] for r in phrases.collect()) - weights.keys())
    got = sample.mapInArrow(_rates(lexicon), "rate double, toxic int").toPandas()
    if toxic and clean:
        lexicon.slope, lexicon.offset = logistic(np.log1p(8 * got["rate"].to_numpy()), got["toxic"].to_numpy())
    forget(sample)
    return lexicon


def _scores(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([lexicon.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), a row for every row of docs.

    labels(doc_id, toxic) are learned from outside the held-out fold only; without usable labels of both kinds every score is that of
    a text without hits. Null and empty texts have no hits. A null doc_id is not held out. Rows that repeat are scored each.
    Other columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    lexicon = learn(docs, labels, rows)
    scored = docs.select("doc_id", "text").mapInArrow(_scores(lexicon), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose text is not predicted toxic. The text is scored in place, so nothing is joined.

    Null and empty texts stay, as do all rows if nothing can be learned from labels. Rows that repeat are judged each; a score of
    exactly 0.5 is toxic. Texts are scored whole, in time linear in their length. An empty table stays empty.
    """
    tune(docs.sparkSession)
    lexicon = learn(docs, labels)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([lexicon.score(t) < 0.5 for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
