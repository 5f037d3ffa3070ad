"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on doc_id, written in order of doc_id.

A file is one shard of the id order. Stripes are read in parallel, and a filter on doc_id skips shards, stripes and row groups by
their statistics and Bloom filters (`read_documents`). Each row carries the number of ids before it in its shard, so
that a document's place in the whole sequence needs the shards' totals only.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import scratch_path, tune

END = 1
VOCABULARY = "word_bpe_49k.json"
STORED = "shard int, doc_id long, n_tokens long, before long, ids array<int>"


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's own.

    The vocabulary drops white space and marks the end of a word. Plain texts (ASCII, Latin letters with accents, line ends
    and tabs) are lower-cased and their words set apart by one space, which stands for the mark; tiktoken's merge loop then
    runs on the vocabulary's own merge order, about three times as fast. All other texts go to the tokenizer.
    """

    #: Latin letters that NFC leaves alone and whose one lower-case letter is among them too; of some, as U+0181, it lies beyond.
    _LETTERS = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and 0xDF <= ord(c.lower()) < 0x250 and unicodedata.is_normalized("NFC", c))
    _PLAIN = re.compile(f"[\\n\\t -~{_LETTERS}]*")
    #: What the tokenizer splits off besides runs of letters: contractions, single digits, runs of other signs.
    _MARKS = re.compile("'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \\n\\ta-z0-9\u00df-\u024f]+")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = byte_letters()
        ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i for t, i in self.tokenizer.get_vocab().items() if t not in self.special}
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self._PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        words = self._MARKS.sub(r" \g<0> ", text.lower()).split()
        return self.fast.encode_to_numpy(" ".join([*words, ""]), disallowed_special=()).view(np.int32)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _encode(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        shard, before, ids_of = TaskContext.get().partitionId(), 0, encoder(path).encode
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                ids = [np.append(ids_of(t), np.int32(end)) for t in some.column("text").to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = np.cumsum(sizes)
                values = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard, np.int32)), some.column("doc_id"), pa.array(sizes), pa.array(ends - sizes + before), values], ["shard", "doc_id", "n_tokens", "before", "ids"])
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, shards: int | None = None) -> None:
    """Encodes docs(doc_id, text, ...) and writes ORC files in ascending doc_id order to `path`.

    A null text is empty and has the end id only. Rows that share a doc_id are neighbours, in order of their texts; rows without
    doc_id come first. An empty table writes no rows. tokenizer: path of the vocabulary on the workers.
    """
    spark = docs.sparkSession
    tune(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_encode(tokenizer, end), STORED)
    rows.write.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "1000").option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the files in `path`. Only (shard, n_tokens) is read for the totals, one row a shard."""
    stored = spark.read.schema(STORED).orc(path)
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; shards, stripes and row groups without them are skipped."""
    return spark.read.schema(STORED).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_tokens' rows; the checksum is over little-endian unsigned 32-bit ids."""
    return tokens.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_digest(read_tokens(docs.sparkSession, path))
