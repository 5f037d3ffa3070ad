"""Best-fit packing by bin completion over the histogram of piece lengths.

Pieces of one length are interchangeable, so the packing problem is a table of at most `capacity` lengths with counts: that is all
the driver gets. `bin_completion` solves it into patterns (how often each length occurs in a sequence) with copies. A
piece's place follows from its rank among the pieces of its length, which is counted per shard where pieces are made.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import forget, tune, written
from .tokenbin import byte_letters

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
Packing = list[tuple[dict[int, int], int]]


class ByteEncoder:
    """Ids equal to the tokenizer's own, about four times as fast: its vocabulary and merge order drive tiktoken's merge loop. Texts
    that hold a special token's string go to the tokenizer, and so do those with a run of white space of LONG_RUN characters:
    the pattern's lookahead keeps the whole run on a stack."""

    LONG_RUN = re.compile(r"\s{10000}")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = byte_letters()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(s in text for s in self.special) or (len(text) >= 10_000 and self.LONG_RUN.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@functools.cache
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def best_fit(counts: Counter, capacity: int) -> Packing:
    """Best fit decreasing, whole groups of equal bins at a time."""
    groups: list[list] = []  # pattern, copies, room
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = [g for g in groups if g[2] >= length and g[1]]
            group = min(fitting, key=lambda g: g[2]) if fitting else [{}, -(-left // (capacity // length)), capacity]
            if not fitting:
                groups.append(group)
            each = min(group[2] // length, left)
            bins = min(group[1], left // each)
            groups.append([group[0] | {length: each}, bins, group[2] - each * length])
            group[1] -= bins
            left -= bins * each
    return [(pattern, copies) for pattern, copies, _ in groups if copies and pattern]


def fillings(room: int, counts: Counter, most: int):
    """Undominated fillings of `room`, fullest first: at most `most` of those found, in which no item can give way to a longer one."""
    found: list[tuple[int, dict[int, int]]] = []
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    visits = 0

    def search(i: int, room: int, taken: dict[int, int]) -> bool:
        nonlocal visits
        visits += 1
        if counts.get(room, 0) > taken.get(room, 0):
            found.append((0, taken | {room: taken.get(room, 0) + 1}))
            return len(found) >= most
        while i < len(lengths) and (lengths[i] > room or taken.get(lengths[i], 0) >= counts[lengths[i]]):
            i += 1
        if i == len(lengths):
            open_ = [x for x in lengths if counts[x] > taken.get(x, 0)]
            if not any(x < y <= x + room for x in taken for y in open_):
                found.append((room, dict(taken)))
            return visits > 60 * most
        for j in range(i, min(len(lengths), i + most)):
            x = lengths[j]
            if taken.get(x, 0) < counts[x] and x <= room and search(j, room - x, taken | {x: taken.get(x, 0) + 1}):
                return True
        return visits > 60 * most

    if not lengths:
        return [(room, {})]
    search(0, room, {})
    return sorted(found or [(room - lengths[0], {lengths[0]: 1})], key=lambda f: f[0])[:most]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, branches: int = 6, nodes: int = 20_000) -> Packing:
    """Few bins for counts[length] items of each length, as (pattern, copies).

    Depth first around the longest item left, over undominated fillings from the fullest on; a filling is used for as many bins as
    the counts allow. A branch ends when its waste rules out a packing better than the incumbent, which at first is best fit
    decreasing. It stops at the bound ceil(total / capacity), or after `nodes` steps with the best packing found.
    """
    counts = Counter({x: n for x, n in counts.items() if n > 0})
    total = sum(x * n for x, n in counts.items())
    bound = -(-total // capacity)
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    spent = 0
    stack: list[tuple[Counter, Packing, int, int]] = [(counts, [], 0, 0)]
    while stack and bins > bound and spent < nodes:
        left, done, used, waste = stack.pop()
        spent += 1
        if waste > (bins - 1) * capacity - total:
            continue
        if not left:
            if used < bins:
                best, bins = done, used
            continue
        longest = max(left)
        rest = left - Counter({longest: 1})
        for gap, filling in reversed(fillings(capacity - longest, rest, branches)):
            pattern = dict(Counter(filling) + Counter({longest: 1}))
            copies = min(left[x] // n for x, n in pattern.items())
            stack.append((left - Counter({x: n * copies for x, n in pattern.items()}), [*done, (pattern, copies)], used + copies, waste + gap * copies))
    return best


PIECES = "shard int, doc_id long, piece int, start long, length long, ids_crc32 long, place long, ids array<int>"


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        from pyspark import TaskContext

        shard, seen, ids_of = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(path).encode
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            rows, kept = [], [np.empty(0, "<u4")]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(ids_of(text), np.uint32(end)).astype("<u4")
                kept.append(ids)
                first = (len(ids) - 1) % capacity + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    rows.append((shard, doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), int(seen[stop - start])))
                    seen[stop - start] += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, (pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)]
            # Pieces follow each other as their ids do.
            ends = np.cumsum([0, *(r[4] for r in rows)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "piece", "start", "length", "ids_crc32", "place", "ids"])

    return run


RANKS = 44


def layout(packing: Packing) -> np.ndarray:
    """Rows (length and first rank as one key, items a bin, first sequence, offset in it), by key: where pieces of a length go."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, copies in packing:
        offset = 0
        for length, each in sorted(pattern.items(), reverse=True):
            rows.append(((length << RANKS) + ranks[length], each, sequence, offset))
            ranks[length] += each * copies
            offset += each * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _placed(table: np.ndarray):
    def run(batches):
        for batch in batches:
            length, place = (batch.column(c).to_numpy() for c in ("length", "place"))
            if len(length):
                key = (length << RANKS) + place
                first, each, sequence, offset = table[np.searchsorted(table[:, 0], key, side="right") - 1].T
                within = key - first
                columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + within // each), pa.array(offset + within % each * length), batch.column("ids")], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs(doc_id, text, ...) -> a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    ids are the piece's token ids: in order of offset, those of one sequence_id are the training sequence.
    A null text is empty and has the end id only. Texts of more than `capacity` ids are cut from the end, so that only the first
    piece may be shorter. Rows that repeat a doc_id are packed each. A sequence is filled without gaps from offset 0. Other columns
    are ignored; an empty table gives an empty result. tokenizer: path of the vocabulary on the workers.
    """
    tune(docs.sparkSession)
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end), PIECES), "pieces")
    counts = written(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = layout(bin_completion(histogram, capacity))
    ahead = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("shard", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "bases")
    forget(counts)
    ranked = pieces.join(bases, ["shard", "length"]).withColumn("place", F.col("place") + F.col("base"))
    return ranked.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids array<int>")
