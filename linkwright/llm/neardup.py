"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature holds SYMBOLS minimum hashes of b = 32 bits. It is split into CHUNKS chunks of WIDTH symbols, and each
chunk is filed under every choice of WIDTH - ERRORS of its symbols, which enumerates the allowed errors in the chunk. By the
pigeonhole principle two signatures that differ in at most RADIUS = CHUNKS * (ERRORS + 1) - 1 symbols share such a key. At a
similarity of exactly 0.75 a pair differs in 20 of 80 symbols on average (sd 3.9), RADIUS is 31.

Pairs within a key are never all emitted. First every document is compared with one leader of each of its keys, the document
that shares keys most often (the middle of a family of near copies); links are confirmed on full shingle sets and joined into
components. Then only keys whose other documents still lie in different components are open. In open keys of up to CROWD
documents, pairs of different components whose sizes allow a link are compared.

In larger open keys only documents outside the key's largest component are left over. They and all documents of the key are
dealt into blocks of bounded size; a block of the one and a block of the other make a unit of work that counts all its
intersections as one product of 0-1 matrices and returns a forest of its links, never pairs. So no link between components is
lost, at any size of a key, without a cap.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .runtime import forget, tune, written
from .words import U64, mix, shingle_set

CHUNKS, WIDTH, ERRORS = 16, 5, 1
SYMBOLS = CHUNKS * WIDTH
RADIUS = CHUNKS * (ERRORS + 1) - 1
_KEPT = [list(c) for c in itertools.combinations(range(WIDTH), WIDTH - ERRORS)]
_XOR = mix(np.arange(1, SYMBOLS + 1, dtype=U64))
_MUL = mix(np.arange(1001, SYMBOLS + 1001, dtype=U64)) | U64(1)
#: Documents of an open key whose pairs are compared one by one; documents and shingles of a block of a larger one; columns of a product.
CROWD, BLOCK, BLOCK_SHINGLES, COLUMNS = 64, 256, 1 << 20, 4096
SKETCH = "doc_id long, n_shingles long, set_id binary, signature array<int>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """b-bit minimum hashes of a set that isn't empty."""
    least = np.full(SYMBOLS, np.iinfo(U64).max, U64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, ((shingles[i : i + 1024][None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return (mix(least) >> U64(32)).astype(np.uint32).view(np.int32)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys (rows x CHUNKS * choices) of signatures (rows x SYMBOLS)."""
    parts = signatures.view(np.uint32).astype(U64).reshape(len(signatures), CHUNKS, WIDTH)
    keys = []
    for i, kept in enumerate(_KEPT):
        total = np.broadcast_to(np.arange(CHUNKS, dtype=U64) * U64(len(_KEPT)) + U64(i + 1), parts.shape[:2])
        for j in kept:
            total = mix(total * U64(0x2545F4914F6CDD1D) + parts[:, :, j])
        keys.append(total)
    return np.concatenate(keys, axis=1)


def _sketches(batches):
    for batch in batches:
        sizes, ids, signatures = [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text)
            sizes.append(len(found))
            ids.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_id", "signature"])


def _keys(batches):
    for batch in batches:
        if batch.num_rows:
            signatures = batch.column("signature").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, SYMBOLS)
            keys = chunk_keys(np.ascontiguousarray(signatures)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))], ["doc", "keys"])


def _sets(batches):
    for batch in batches:
        found = [shingle_set(text).view(np.int64) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc", "shingles"])


def differing(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets share at least percent / 100 of their union."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("shared") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def alike(a, b, percent: int):
    """Whether sets of these sizes can be linked at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of `left` with all of `right`, as products of 0-1 matrices of at most COLUMNS
    shingles each. Shingles of a single set are left out first."""
    sets = [*left, *right]
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    common = times[column] > 1
    column, owner = number[column[common]], owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        total += part[: len(left)] @ part[len(left) :].T
    return total


def forest(docs: list[np.ndarray], components: list[np.ndarray], sets: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """The links between two blocks, as far as they join components that no earlier link of the unit has joined."""
    shared = intersections(*sets)
    sizes = [np.array([len(x) for x in side]) for side in sets]
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    linked = (shared * 100 >= union * percent) & (components[0][:, None] != components[1][None, :])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []
    for x, y in zip(*(side.tolist() for side in np.nonzero(linked)), strict=True):
        a, b = root(int(components[0][x])), root(int(components[1][y]))
        if a != b:
            parent[a] = b
            found.append((int(docs[0][x]), int(docs[1][y])))
    return found


def _forests(percent: int):
    def run(batches):
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                sides = []
                for column in ("others", "members"):
                    block = batch.column(column).slice(row, 1).flatten()
                    doc, component, shingles = block.flatten()
                    values, ends = shingles.values.to_numpy(), shingles.offsets.to_numpy()
                    sides.append((doc.to_numpy(), component.to_numpy(), [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]))
                found += forest(*map(list, zip(*sides, strict=True)), percent)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def spread(keyed: DataFrame) -> DataFrame:
    """The rows of keys whose documents lie in different components."""
    several = keyed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    return keyed.join(several, "key")


def links_of_open_keys(open_: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """open_(key, doc, component, size), marks(doc, signature), sets(doc, shingles) -> (a, b): links between documents of
    one key and different components, as many as connect what the key connects."""
    counts = open_.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    sized = written(open_.join(counts, "key"), "sized")
    few, many = sized.where(F.col("n") <= CROWD), sized.where(F.col("n") > CROWD)
    side = lambda x: few.select("key", F.col("doc").alias(x), F.col("component").alias(f"c{x}"), F.col("size").alias(f"s{x}"))
    pairs = side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike(F.col("sa"), F.col("sb"), percent)).select("a", "b").distinct()
    pairs = written(near(pairs, marks), "pairs")
    links = written(confirmed(pairs, sets, percent).union(links_of_blocks(many, sets, percent)), "links")
    forget(sized)
    forget(pairs)
    return links


def links_of_blocks(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links of large keys, many(key, doc, component, size, n, shingles), as forests of the links of each two blocks. A block
    has about BLOCK documents or BLOCK_SHINGLES shingles at most."""
    by = many.groupBy("key", "component").agg(F.count("*").alias("count"), F.sum("size").alias("sum"), F.first("n").alias("n"), F.first("shingles").alias("total"))
    home = by.groupBy("key").agg(F.max(F.struct("count", "sum", "component")).alias("home"), F.first("n").alias("n"), F.first("total").alias("total"))
    blocks = lambda n, total: F.greatest(F.ceil(n / BLOCK), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")
    home = home.select("key", F.col("home.component").alias("home"), blocks(F.col("n"), F.col("total")).alias("blocks"), blocks(F.col("n") - F.col("home.count"), F.col("total") - F.col("home.sum")).alias("left"))
    dealt = many.select("key", "doc", "component").join(home, "key")
    packed = F.collect_list(F.struct("doc", "component", "shingles"))
    block = lambda count: F.pmod(F.xxhash64("doc"), F.col(count)).cast("int")
    members = dealt.join(sets, "doc").groupBy("key", block("blocks").alias("block")).agg(packed.alias("members"))
    others = dealt.where("component <> home").join(sets, "doc").groupBy("key", "blocks", block("left").alias("part")).agg(packed.alias("others"))
    units = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(members, ["key", "block"])
    return units.select("others", "members").mapInArrow(_forests(percent), "a long, b long")


def near(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The (a, b) whose signatures differ in at most RADIUS symbols."""
    side = lambda x: marks.select(F.col("doc").alias(x), F.col("signature").alias(f"m{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(differing("ma", "mb") <= RADIUS).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept).

    Sets are the distinct 5-word shingles of the text with A-Z lower-cased; a text of one to four words is one shingle, a null
    or blank one has an empty set and no link. component_id is the smallest doc_id reachable over links of at least percent
    similarity, kept says that it is the document's own. Equal sets form one class first, so copies are never paired.
    Rows that share a doc_id count as one document with several texts. A row without doc_id links with nothing, has a null
    component_id and is kept. Ties, of leaders or classes, go to the smallest doc_id and don't show in the result. Texts of
    any length are one set. Other columns of docs are ignored; an empty table gives an empty result.
    """
    tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketches = written(docs.mapInArrow(_sketches, SKETCH), "sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    filed = classes.select("doc", "signature").mapInArrow(_keys, "doc long, keys array<long>").select("doc", F.explode("keys").alias("key"))
    crowded = written(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    shared = written(filed.join(crowded, "key"), "shared")
    weight = written(shared.groupBy("doc").agg(F.sum("n").alias("weight")), "weight")
    leaders = shared.join(weight, "doc").groupBy("key").agg(F.max(F.struct("weight", -F.col("doc"), "doc")).getField("doc").alias("leader"))
    # With its leader, which holds for every key; whatever is left to compare lies in keys of three documents or more.
    others = written(shared.join(leaders, "key").where("leader <> doc"), "others")
    marks = classes.select("doc", "signature")
    sizes = classes.select("doc", "size")
    first = others.select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    first = first.join(sizes.select(F.col("doc").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("size").alias("sb")), "b")
    first = written(near(first.where(alike(F.col("sa"), F.col("sb"), percent)).select("a", "b"), marks), "pairs")
    sets = written(docs.join(weight.select(F.col("doc").alias("doc_id")).hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc long, shingles array<long>"), "sets")
    links = written(confirmed(first, sets, percent), "links")
    found = written(components(links), "found")
    known = sizes.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").select("doc", "size", F.coalesce("component", "doc").alias("component"))
    member = written(others.where("n > 2").select("key", "doc").join(known, "doc").select("key", "doc", "component", "size"), "member")
    more = links_of_open_keys(spread(member), marks, sets, percent)
    found = components(written(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "merged"))
    of_class = classes.select("set_id", "doc").join(found.select(F.col("node").alias("doc"), "component"), "doc", "left")
    of_class = written(of_class.select("set_id", F.coalesce("component", "doc").alias("component_id")), "of_class")
    for table in (crowded, shared, weight, others, first, sets, links, member):
        forget(table)
    # Rows without a class go past the join: as one null key they would be one task.
    filed = sketches.where("n_shingles > 0 and doc_id is not null").join(of_class, "set_id").select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
