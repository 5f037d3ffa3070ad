"""Quality rules as a learned decision list.

Sequential covering grows threshold conjunctions that catch documents labelled low quality, prunes each on rows it was not grown on,
and removes what it covers before the next. The list becomes one ordered Spark conditional expression over text statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import training_sample, tune
from .words import covered, ngram_hashes, word_hashes, words_of

SAMPLE_ROWS = 20_000
WINDOW = 5
COUNTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: rates, so that a threshold means the same for every length.
TESTED = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate", "mark_rate"]
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in [*COUNTED, "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_chars_all"])


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of STATS; null has no words and no lines with a word."""
    text = text or ""
    words = words_of(text)
    hashes = word_hashes(words)
    windows = ngram_hashes(hashes, WINDOW)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    repeats = covered(np.flatnonzero(times[which] > 1), WINDOW, len(words)).sum() if len(windows) else 0
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    starts = int(((raw & 0xC0) != 0x80).sum())
    space = int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    marks = int(((raw > 32) & (raw < 127)).sum()) - upper - digits - int(((raw >= 97) & (raw <= 122)).sum())
    return len(words), starts - space, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), int(repeats), len(lines), len(np.unique(hashes)), upper, digits, marks, starts


def _stats(batches):
    for batch in batches:
        rows = [statistics(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 11)]
        others = [n for n in batch.schema.names if n not in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *map(batch.column, others)], [*(x.split()[0] for x in STATS.split(", ")), *others])


def text_statistics(docs: DataFrame, label: str = "") -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, counts and the rates that rules test, and the column that `label` declares, if any; a
    rate without words or lines is 0."""
    stats = docs.select("doc_id", "text", *label.split()[:1]).mapInArrow(_stats, f"{STATS}, {label}" if label else STATS)
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_chars_all", F.lit(1))
    return stats.select("*", (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbol_rate"), (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_rate"), (F.col("n_repeat_words") / words).alias("repeat_rate"), (F.col("n_distinct") / words).alias("distinct_rate"), (F.col("n_upper") / chars).alias("upper_rate"), (F.col("n_digits") / chars).alias("digit_rate"), (F.col("n_marks") / chars).alias("mark_rate"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def rows(self, table: np.ndarray) -> np.ndarray:
        x = table[:, TESTED.index(self.feature)]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Rule = tuple[Test, ...]


def matched(rule: Rule, table: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([t.rows(table) for t in rule]) if rule else np.ones(len(table), bool)


def _grow(table: np.ndarray, bad: np.ndarray, most: int = 4) -> Rule:
    """Adds the test of the greatest information gain (FOIL) until no good row is left."""
    rule: Rule = ()
    inside = np.ones(len(table), bool)
    while len(rule) < most and (bad & inside).any() and (~bad & inside).any():
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        best = (1e-9, None)
        for j, feature in enumerate(TESTED):
            values = table[inside, j]
            order = np.argsort(values, kind="stable")
            x, hit = values[order], bad[inside][order]
            ends = np.flatnonzero(np.diff(x) > 0)
            if not len(ends):
                continue
            below, bad_below = ends + 1, np.cumsum(hit)[ends]
            for above, tp, total in ((False, bad_below, below), (True, p - bad_below, p + n - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(np.maximum(tp, 1) / total) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Test(feature, above, float((x[ends[k]] + x[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].rows(table)
    return rule


def _worth(rule: Rule, table: np.ndarray, bad: np.ndarray) -> float:
    hit = matched(rule, table)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(table: np.ndarray, bad: np.ndarray, precision: float = 0.9, most: int = 12, seed: int = 7) -> list[Rule]:
    """Ordered rules for rows of TESTED columns that are bad. A rule stays if, of the rows it catches in the part it was pruned on and
    in all, at least `precision` are bad; the first that doesn't ends the list."""
    rules: list[Rule] = []
    left = np.ones(len(table), bool)
    part = np.random.default_rng(seed).random(len(table)) < 2 / 3
    for _ in range(most):
        grow, prune = left & part, left & ~part
        if not (bad & grow).any():
            break
        rule = _grow(table[grow], bad[grow])
        while len(rule) > 1 and _worth(rule[:-1], table[prune], bad[prune]) >= _worth(rule, table[prune], bad[prune]):
            rule = rule[:-1]
        hit = matched(rule, table) & left
        if not rule or not hit.any() or bad[hit].mean() < precision or (hit & ~part).any() and bad[hit & ~part].mean() < precision or (hit & bad).sum() < 3:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for a kept row: WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true."""
    case = None
    for rule in rules:
        condition = rule[0].column()
        for test in rule[1:]:
            condition &= test.column()
        case = F.when(condition, False) if case is None else case.when(condition, False)
    return F.lit(True) if case is None else case.otherwise(True)


def failed_base() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most `rows` documents that labels(doc_id, quality) marks, outside the held-out fold; only numbers reach the driver.
    Rows that the base rules reject are left out, as the list decides about the others."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    stats = text_statistics(training_sample(docs, marked, rows), "quality int").where(~failed_base())
    got = stats.select("doc_id", *TESTED, "quality").toPandas().sort_values(["doc_id", *TESTED])
    return learn_rules(got[TESTED].to_numpy(float), (got["quality"] == 0).to_numpy())


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail the base rules. Without usable labels the list is empty and the base rules decide. Rows
    that repeat are judged each. Other columns are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    rules = learn(docs, labels, rows)
    judged = text_statistics(docs).select("doc_id", *COUNTED, failed_base().alias("base_failed"), verdict(rules).alias("passed"))
    return judged.select("doc_id", *COUNTED, "base_failed", (~F.col("base_failed") & F.col("passed")).alias("kept"))
