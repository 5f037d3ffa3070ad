"""Language by rank-order profiles: the out-of-place distance between a text's most frequent n-grams and each language's."""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import fold_of, training_sample, tune

#: Documents that profiles are learned from at most, and the n-grams in a profile.
SAMPLE_ROWS, PROFILE = 8_000, 400
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_B = np.uint64(21)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the lower-cased letters, with one boundary for each run of other characters, and their counts.
    A gram is three code points of 21 bits."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    if not points.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    points = np.pad(points, 1)
    points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
    pairs = points[:-1] << _B | points[1:]
    triples = pairs[:-1] << _B | points[2:]
    return np.unique(np.concatenate([points[points != 0], pairs | np.uint64(1 << 63), triples]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The `most` most frequent codes, ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        kept = counts >= least
        codes, counts = codes[kept], counts[kept]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles:
    def __init__(self, ranks: dict[str, list[int]]):
        self.ranks = {lang: np.array(codes, np.uint64) for lang, codes in sorted(ranks.items())}
        self.order = {lang: np.argsort(codes) for lang, codes in self.ranks.items()}

    def distances(self, codes: np.ndarray) -> dict[str, int]:
        """Sum over the text's ranks of how far a gram is from its rank in the profile; a gram that isn't in it counts as a full profile."""
        out, own = {}, np.arange(len(codes))
        for lang, profile in self.ranks.items():
            order = self.order[lang]
            at = order[np.minimum(np.searchsorted(profile, codes, sorter=order), len(profile) - 1)]
            out[lang] = int(np.where(profile[at] == codes, np.abs(at - own), PROFILE).sum())
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(*grams(text))
        if not len(codes) or not self.ranks:
            return UNKNOWN, 0.0
        by = sorted((d, lang) for lang, d in self.distances(codes).items())
        best, lang = by[0]
        second = by[1][0] if len(by) > 1 else len(codes) * PROFILE
        return lang, second / (best + second) if best + second else 0.5


def _counts(batches):
    found: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            codes, counts = grams(text)
            found.setdefault(lang, Counter()).update(dict(zip(codes.view(np.int64).tolist(), counts.tolist(), strict=True)))
    rows = [(lang, code, n) for lang, counts in found.items() for code, n in counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "code", "n"])


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles of every lang in at most `rows` documents outside the held-out fold whose lang and doc_id aren't null."""
    labelled = docs.where("lang is not null and doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    counts = training_sample(docs, labelled, rows).mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PROFILE)
    ranks: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        ranks.setdefault(r["lang"], []).append(r["code"] & (1 << 64) - 1)
    return Profiles(ranks)


def _predictions(profiles: Profiles):
    def run(batches):
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> (doc_id, held_out, lang_pred, score), a row for every row of docs.

    A null text, one without letters, or any text if no language could be learned, is `und` with score 0. score is the runner-up's share
    of the two least distances: from 0.5, a tie, to 1. Ties go to the first language by name. A null doc_id is not held out. Rows
    that repeat are predicted each. Other columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    profiles = learn(docs, rows)
    found = docs.select("doc_id", "text").mapInArrow(_predictions(profiles), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
