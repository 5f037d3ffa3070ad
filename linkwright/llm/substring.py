"""Substring dedup: words covered by a 13-word window that also starts in a document with a smaller doc_id are removed.

Two operators. `remove_reference_spans` is the suffix-automaton form: shards of a reference of checked size are broadcast as
automata, documents are streamed for matching statistics, and maximal spans above the threshold go. `remove_repeats` finds
repeats among all documents, where the reference is the corpus itself: its automata grow with the data and each document would
have to be streamed through all of them, so it joins window hashes instead. Windows are filed under the least 5-word hash
in them (a minimiser, so equal windows have equal anchors and about a fifth of the positions are filed); only windows whose anchor
occurs in two documents are compared, and those by 64-bit hashes of all 13 words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import forget, tune, written
from .words import covered, ngram_hashes, word_hashes, words_of

WINDOW, ANCHOR = 13, 5


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    size, n = 1, len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """For each window, the least 5-word hash in it."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.uint64)
    return sliding_min(ngram_hashes(hashes, ANCHOR), WINDOW - ANCHOR + 1)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchors(batches):
    for batch in batches:
        found = [np.unique(window_anchors(word_hashes(words_of(t)))).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "anchors"])


CANDIDATES = "doc_id long, n_words long, text string, windows array<long>, kept_sha256 string"


def _candidates(batches):
    """Windows whose anchor occurs elsewhere too. A document without any is finished here."""
    for batch in batches:
        rows = []
        for doc_id, text, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "shared")), strict=True):
            words = words_of(text)
            windows = np.empty(0, np.int64)
            if shared:
                hashes = word_hashes(words)
                hit = np.isin(window_anchors(hashes), np.array(shared, np.int64).view(np.uint64))
                windows = np.unique(ngram_hashes(hashes, WINDOW)[hit]).view(np.int64)
            rows.append((doc_id, len(words), text if len(windows) else None, windows, None if len(windows) else _sha(words)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()), strict=True)], ["doc_id", "n_words", "text", "windows", "kept_sha256"])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _removed(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n, text, sha, repeats in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "text", "kept_sha256", "repeats")), strict=True):
                words, gone = words_of(text), None
                if repeats:
                    hit = np.isin(ngram_hashes(word_hashes(words), WINDOW), np.array(repeats, np.int64).view(np.uint64))
                    gone = covered(np.flatnonzero(hit), WINDOW, n)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words).decode() if with_text else None
                rows.append((doc_id, n, int(gone.sum()) if gone is not None else 0, sha or _sha(words), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256[, kept_text]), a row for every row of docs.

    Windows are judged on the input. A null text has no words; texts of fewer than 13 words lose none. Rows that share a doc_id
    don't remove each other's words. A row without doc_id removes nothing and loses nothing. kept_text is the words left, joined by
    one space; with_text carries all texts to the end. Other columns are ignored; an empty table gives an empty result.
    A false match needs two windows of equal 64-bit hash: with 10^13 candidate windows about one window in two million.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    anchors = written(docs.where("doc_id is not null").mapInArrow(_anchors, "doc_id long, anchors array<long>"), "anchors")
    filed = anchors.select("doc_id", F.explode("anchors").alias("anchor"))
    twice = F.min("doc_id") < F.max("doc_id")
    shared = written(filed.groupBy("anchor").agg(twice.alias("twice")).where("twice").select("anchor"), "shared")
    of_doc = written(filed.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared")), "of_doc")
    forget(anchors)
    candidates = docs.join(of_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "shared").mapInArrow(_candidates, CANDIDATES)
    candidates = written(candidates, "candidates")
    if with_text:
        candidates = candidates.drop("text").join(docs.where("doc_id is not null"), "doc_id", "left")
    forget(shared)
    forget(of_doc)
    windows = candidates.select("doc_id", F.explode("windows").alias("window"))
    repeated = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeated = written(repeated.select("window", "first"), "repeated")
    repeats = windows.join(repeated, "window").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("window").alias("repeats"))
    repeats = written(repeats, "repeats")
    forget(repeated)
    final = candidates.select("doc_id", "n_words", "text", "kept_sha256").join(repeats.hint("merge"), "doc_id", "left").mapInArrow(_removed(with_text), RESULT)
    return final if with_text else final.drop("kept_text")


class SuffixAutomaton:
    """All runs of words of some sequences. A state is a set of runs that end at the same places; `link` is the longest
    run of other ends that is a suffix of them."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)

    def _state(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state that `word` leads to from `at`, holding no run longer than at's and the word."""
        to = self.next[at][word]
        if self.length[to] == self.length[at] + 1:
            return to
        copy = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, at = self._state(self.length[last] + 1, {}, 0), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, word)
        return new

    def statistics(self, words: list[bytes]) -> np.ndarray:
        """For each word, how many words up to and with it are a run of the reference at most."""
        at, size, out = 0, 0, np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            while at and word not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if word in self.next[at]:
                at, size = self.next[at][word], size + 1
            out[i] = size
        return out


def _dealt(texts: list[str | None], most_words: int) -> list[list[list[bytes]]]:
    """Texts as words, in shards that end with the text that brings them to most_words."""
    shards: list[list[list[bytes]]] = []
    room = 0
    for words in map(words_of, texts):
        if room <= 0:
            shards.append([])
            room = most_words
        shards[-1].append(words)
        room -= len(words)
    return shards


SPANS = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_reference_spans(docs: DataFrame, reference: DataFrame, threshold: int = WINDOW, shard_words: int = 200_000, most_words: int = 2_000_000, most_bytes: int = 32 << 20, held_bytes: int = 64 << 20) -> DataFrame:
    """docs(doc_id, text, ...) without all spans of `threshold` or more words that one text of reference(text, ...) holds:
    (doc_id, n_words, n_removed, kept_sha256, kept_text), a row for every row of docs.

    The reference's words and bytes are counted first; beyond most_words or most_bytes this raises ValueError, and `remove_repeats`
    over the union is the way. Its texts are broadcast. A task reads up to held_bytes of documents, streams them through the
    automaton of one shard of about shard_words after the other, and drops each before it builds the next. Nulls have no words
    and lose none. Rows that repeat are searched each. Other columns are ignored; an empty table gives an empty result, an empty
    reference removes nothing.
    """
    tune(docs.sparkSession)
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    size = reference.agg(F.coalesce(F.sum(count), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["words"] > most_words or size["bytes"] > most_bytes:
        raise ValueError(f"the reference has {size['words']} words in {size['bytes']} bytes; automata of at most {most_words} words in {most_bytes} bytes are broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(_dealt([r[0] for r in reference.select("text").collect()], shard_words))

    def spared(held):
        texts = [(i, words_of(t)) for batch in held for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        gone = [np.zeros(len(words), bool) for _, words in texts]
        for shard in sent.value:
            automaton = SuffixAutomaton(shard)
            for (_, words), mark in zip(texts, gone, strict=True):
                found = automaton.statistics(words)
                ends = np.flatnonzero(found >= threshold)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, ends - found[ends] + 1, 1)
                np.add.at(edge, ends + 1, -1)
                mark |= np.cumsum(edge)[:-1] > 0
        rows = []
        for (doc_id, words), mark in zip(texts, gone, strict=True):
            kept = b" ".join(w for w, g in zip(words, mark.tolist(), strict=True) if not g)
            rows.append((doc_id, len(words), int(mark.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [c.split()[0] for c in SPANS.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield spared(held)
                held, size = [], 0
        if any(b.num_rows for b in held):
            yield spared(held)

    return docs.select("doc_id", "text").mapInArrow(run, SPANS)
