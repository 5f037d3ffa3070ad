"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement by perturbed A-star.

A text's lattice has a state at every character and an option for every piece that begins there. Pieces have the log weight
-log(1 + rank), and backward sums turn weights into the probability of each option, so that a segmentation's probability is the
product of its options'. The search keeps regions of the lattice with the greatest perturbed log probability in each: the
whole lattice has a Gumbel variable, and its best segmentation is drawn option by option. What is left splits into one region
a decision (same options before, another option here, anything after), with Gumbel variables truncated at the greatest so
far. The next sample is drawn in the best region. The k samples are exactly the k greatest perturbed segmentations.

All texts of a batch are searched together, as arrays. Random numbers are hashes of row key, round and place, so that a row
has the same samples in any batch.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import tune
from .words import U64, mix

VOCABULARY = "piece_bpe_32k.model"
SAMPLES = 2
#: States kept from batch to batch; chunks whose lattices are built, and texts that are searched, at a time.
STATES_HELD, LEARNED, SEARCHED = 2_000_000, 3_000, 100
SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = -np.inf
#: Steps that stand for other draws than options: of regions' bounds, of the first sample, of another option.
BOUND, FIRST, OTHER = (1 << 40, (1 << 40) + 1, (1 << 40) + 2)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Model:
    """Pieces by length, as sorted hashes, and the bytes that each id stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = sp = SentencePieceProcessor(model_file=path)
        # No piece goes on after a space mark, a line end or, with this set of marks, from a letter to a mark: chunks end there.
        pieces = {sp.id_to_piece(i): i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        marks = re.escape("".join(m for m in ".,;:!?|" if not any(a.isalpha() and b == m for p in pieces for a, b in zip(p, p[1:], strict=False))))
        self.chunks = re.compile((f"{SPACE}*[^\\W\\d_]+(?=[{marks}{SPACE}\n]|\\Z)|[{marks}][^{SPACE}\n]*|" if marks else "") + f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.weight = -np.log1p(np.array([max(0.0, -sp.get_score(i)) for i in range(len(sp))]))
        self.unknown = float(self.weight.min()) - 1
        self.tables = {}
        for n in sorted({len(p) for p in pieces}):
            of = [p for p in pieces if len(p) == n]
            points = np.array([[ord(c) for c in p] for p in of], U64)
            hashes = (points * np.array([pow(_BASE, j, 1 << 64) for j in range(n)], U64)).sum(axis=1, dtype=U64)
            order = np.argsort(hashes)
            seen = np.zeros(1 << 20, bool)  # by the hashes' upper bits: most substrings are no pieces
            seen[hashes * U64(_BASE) >> U64(44)] = True
            self.tables[n] = hashes[order], np.array([pieces[p] for p in of])[order], seen
        raw = [b""] * len(sp)
        for p, i in pieces.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.sizes = np.array([len(r) for r in raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encoding puts in front."""
        found = self.raw[ranges(self.starts[ids], self.sizes[ids])].tobytes()
        return found.removeprefix(b" ").decode("utf-8", "replace")


class Numbers(dict):
    """Chunks, numbered as they come."""

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        return number


class Lattices:
    """States and options of all chunks seen, and the first state of each by its number. No piece spans the start of a run of spaces or a line end, so chunks are independent."""

    FIELDS = {"first": np.int32, "next": np.int32, "logp": float, "cum": float, "id_start": np.int32, "id_count": np.int32, "option": np.int32, "ids": np.int32}

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        self.n_states = self.n_options = self.n_ids = 0
        self.parts: dict[str, list[np.ndarray]] = {k: [] for k in self.FIELDS}

    def learn(self, chunks: list[str]) -> None:
        """Adds the lattices of the chunks that were numbered next, all at once."""
        model, text = self.model, "".join(chunks)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        sizes = np.array([len(c) for c in chunks])
        stops = np.cumsum(sizes)
        end = np.repeat(stops, sizes)
        n = len(points)
        powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, _BASE, U64)]), dtype=U64)
        inverse = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, _INVERSE, U64)]), dtype=U64)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(points * powers[:-1], dtype=U64)])
        sources, targets, ids = [], [], []
        single = np.zeros(n, bool)
        room = end - np.arange(n)
        at = np.arange(n)
        for length, (hashes, of, seen) in model.tables.items():
            at = at[room[at] >= length]
            got = (sums[at + length] - sums[at]) * inverse[at]
            likely = seen[got * U64(_BASE) >> U64(44)]
            some, got = at[likely], got[likely]
            i = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            hit = hashes[i] == got
            sources.append(some[hit])
            targets.append(some[hit] + length)
            ids.append(of[i[hit]])
            if length == 1:
                single[some[hit]] = True
        # A character that is no piece is spelled in bytes.
        lone = np.flatnonzero(~single)
        spelled = [model.byte_ids[list(text[i].encode("utf-8", "replace"))] for i in lone]
        source, target = np.concatenate([*sources, lone]), np.concatenate([*targets, lone + 1])
        known = np.concatenate(ids)
        weight = np.concatenate([model.weight[known], [model.unknown * len(b) for b in spelled]])
        id_count = np.concatenate([np.ones(len(known), np.int64), np.array([len(b) for b in spelled], np.int64)])
        pool = np.concatenate([known, *spelled]).astype(np.int64)
        order = np.argsort(source * 64 - (target - source))  # longest first, as the likeliest
        id_start = (np.cumsum(id_count) - id_count)[order]
        source, target, weight, id_count = source[order], target[order], weight[order], id_count[order]
        option = np.searchsorted(source, np.arange(n + 1))
        # Backward sums, all states with the same distance to their chunk's end at once.
        backward = np.zeros(n + 1)
        by = np.argsort(room.astype(np.uint16) if n and room.max() < 1 << 16 else room, kind="stable")
        value = np.empty(len(source))
        groups = np.split(by, np.flatnonzero(np.diff(room[by])) + 1)
        # The farther from the end, the fewer states: those of the few longest chunks are summed one by one.
        wide = next((i for i, g in enumerate(groups) if len(g) <= 3), len(groups))
        for group in groups[:wide]:
            counts = option[group + 1] - option[group]
            edges = ranges(option[group], counts)
            ahead = target[edges]
            got = weight[edges] + np.where(ahead == end[source[edges]], 0.0, backward[np.minimum(ahead, n)])
            begin = np.cumsum(counts) - counts
            top = np.maximum.reduceat(got, begin)
            backward[group] = top + np.log(np.add.reduceat(np.exp(got - np.repeat(top, counts)), begin))
            value[edges] = got
        if wide < len(groups):
            self._far(np.concatenate(groups[wide:]), option, target, weight, end, backward, value)
        logp = value - backward[source]
        running = np.cumsum(np.exp(logp))
        begin = option[:-1]
        cum = running - np.repeat(np.concatenate([[0.0], running])[begin], np.diff(option))
        cum = np.minimum(cum, 1.0)
        cum[option[1:] - 1] = 1.0
        parts = {
            "first": stops - sizes + self.n_states, "next": np.where(target == end[source], -1, target + self.n_states), "logp": np.minimum(logp, 0.0), "cum": cum,
            "id_start": id_start + self.n_ids, "id_count": id_count, "option": option[:-1] + self.n_options, "ids": pool,
        }
        for k, v in parts.items():
            self.parts[k].append(v.astype(self.FIELDS[k]))
        self.n_states, self.n_options, self.n_ids = self.n_states + n, self.n_options + len(source), self.n_ids + len(pool)

    @staticmethod
    def _far(states: np.ndarray, option: np.ndarray, target: np.ndarray, weight: np.ndarray, end: np.ndarray, backward: np.ndarray, value: np.ndarray) -> None:
        """Fills backward and value of states, nearest to their chunk's end first, a state at a time."""
        sums = backward.tolist()
        of = zip(states.tolist(), option[states].tolist(), option[states + 1].tolist(), end[states].tolist(), strict=True)
        for state, a, b, stop in of:
            got = [w + (sums[t] if t != stop else 0.0) for w, t in zip(weight[a:b].tolist(), target[a:b].tolist(), strict=True)]
            top = max(got)
            sums[state] = top + math.log(sum(math.exp(g - top) for g in got))
            value[a:b] = got
        backward[states] = np.array(sums)[states]

    def arrays(self) -> dict[str, np.ndarray]:
        for k, parts in self.parts.items():
            if len(parts) > 1:
                self.parts[k] = [np.concatenate(parts)]
        return {k: parts[0] for k, parts in self.parts.items() if parts}


def uniform(seeds: np.ndarray, turn: int, slot: np.ndarray, step: int) -> np.ndarray:
    """Hashes in (0, 1) of row seed, round, chunk and step; steps beyond 16 bits go into a second product."""
    at = (U64(turn + 1) << U64(52)) + (slot.astype(U64) << U64(16)) + U64(step & 0xFFFF)
    above = U64((step >> 16) * 0x9E6C63D0876A9A47 % (1 << 64))
    return ((mix(seeds ^ (at * U64(0xD1342543DE82EF95) + above)) >> U64(12)).astype(float) + 0.5) * 2.0**-52


def truncated_gumbel(loc: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables with location loc, given that they are below most; -inf where there is no mass."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = loc - np.log(np.exp(np.minimum(loc - most, 700.0)) - np.log(u))
    return np.where(np.isfinite(loc), out, _NONE)


class Search:
    """The samples of all texts of a batch. A decision is an option taken in a state; a round has a path for each text that has one."""

    def __init__(self, tables: dict[str, np.ndarray], counts: np.ndarray, states: np.ndarray, keys: np.ndarray):
        """counts: chunks of each text; states: the first state of each chunk, text by text."""
        self.t, self.texts, self.counts, self.state = tables, len(counts), counts, states
        self.begin = np.cumsum(self.counts) - self.counts
        self.seeds = mix(keys.astype(np.int64).view(U64) + U64(0x5851F42D4C957F2D))
        self.rounds: list[dict[str, np.ndarray]] = []

    def _draw(self, turn: int, text: np.ndarray, slot: np.ndarray, state: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Options from each state to its chunk's end, and how many each has."""
        counts, active, steps = np.zeros(len(state), np.int64), np.arange(len(state)), []
        step = salt
        while len(active):
            u = uniform(self.seeds[text[active]], turn, slot[active], step)
            option = self.t["option"][state[active]].astype(np.int64)
            beyond = np.flatnonzero(u >= self.t["cum"][option])
            while len(beyond):
                option[beyond] += 1
                beyond = beyond[u[beyond] >= self.t["cum"][option[beyond]]]
            counts[active] += 1
            steps.append((active, option))
            after = self.t["next"][option]
            active, state = active[after >= 0], state.copy() if len(steps) == 1 else state
            state[active] = after[after >= 0]
            step += 1
        out = np.empty(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        for i, (rows, option) in enumerate(steps):
            out[begin[rows] + i] = option
        return out, counts

    def _close(self, turn: int, text: np.ndarray, sizes: np.ndarray, slot: np.ndarray, option: np.ndarray, mask: np.ndarray, gone: np.ndarray, least: np.ndarray, best: np.ndarray) -> None:
        """Files a round: text of each path, decisions of each, slot, option, options taken before, their mass, first open decision, Gumbel."""
        begin = np.cumsum(sizes) - sizes
        logp = self.t["logp"][option]
        total = np.concatenate([[0.0], np.cumsum(logp)])
        before = total[:-1] - np.repeat(total[begin], sizes)
        place = np.arange(len(option)) - np.repeat(begin, sizes)
        taken = np.exp(logp) + gone
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(taken, 1.0))
        rest[taken > 1 - 1e-12] = _NONE
        rest[place < np.repeat(least, sizes)] = _NONE
        u = uniform(np.repeat(self.seeds[text], sizes), turn, place, BOUND)
        bound = truncated_gumbel(before + rest, np.repeat(best, sizes), u)
        self.rounds.append({"text": text, "begin": begin, "sizes": sizes, "slot": slot, "option": option, "mask": mask, "gone": gone, "bound": bound, "best": best, "logp": total[begin + sizes] - total[begin], "before": before})

    def first(self) -> None:
        text = np.arange(self.texts)
        slot = ranges(np.zeros(self.texts, np.int64), self.counts)
        of = np.repeat(text, self.counts)
        option, counts = self._draw(0, of, slot, self.state)
        sizes = np.bincount(of, counts, self.texts).astype(np.int64)
        best = -np.log(-np.log(uniform(self.seeds, 0, np.zeros(self.texts, np.int64), FIRST)))
        zero = np.zeros(len(option), np.uint64)
        self._close(0, text, sizes, np.repeat(slot, counts), option, zero, zero.astype(float), np.zeros(self.texts, np.int64), best)

    def best_left(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the greatest open bound, its round and its decision."""
        best, turn, where = np.full(self.texts, _NONE), np.full(self.texts, -1), np.full(self.texts, -1)
        for i, r in enumerate(self.rounds):
            some = r["sizes"] > 0
            if not some.any():
                continue
            top = np.maximum.reduceat(r["bound"], r["begin"][some])
            hit = np.flatnonzero(r["bound"] == np.repeat(top, r["sizes"][some]))
            owner = np.searchsorted(r["begin"][some], hit, side="right") - 1
            at = np.full(len(top), -1)
            at[owner[::-1]] = hit[::-1]
            text = r["text"][some]
            better = top > best[text]
            best[text[better]], turn[text[better]], where[text[better]] = top[better], i, at[better]
        return best, turn, where

    def next(self) -> None:
        turn = len(self.rounds)
        best, parent, where = self.best_left()
        text = np.flatnonzero(best > _NONE)
        pools = {k: np.concatenate([r[k] for r in self.rounds]) for k in ("slot", "option", "mask", "gone")}
        shift = np.cumsum([0, *(len(r["option"]) for r in self.rounds)])
        size_of = np.zeros(self.texts, np.int64)
        for i, r in enumerate(self.rounds):
            mine = np.zeros(self.texts, np.int64)
            mine[r["text"]] = r["begin"]
            size_of = np.where(parent == i, where - mine, size_of)
        head, at = size_of[text], where[text] + shift[parent[text]]
        for i, r in enumerate(self.rounds):
            r["bound"][where[text[parent[text] == i]]] = _NONE
        # Another option in the region's state.
        old, slot = pools["option"][at], pools["slot"][at]
        state = np.searchsorted(self.t["option"], old, side="right") - 1
        begin = self.t["option"][state].astype(np.int64)
        count = np.append(self.t["option"], len(self.t["next"]))[state + 1] - begin
        mask = pools["mask"][at] | U64(1) << (old - begin).astype(U64)
        width = int(count.max()) if len(count) else 1
        grid = np.arange(width)[None, :]
        options = begin[:, None] + grid
        open_ = (grid < count[:, None]) & ((mask[:, None] >> grid.astype(U64)) & U64(1) == 0)
        p = np.where(open_, np.exp(self.t["logp"][np.minimum(options, len(self.t["logp"]) - 1)]), 0.0)
        running = np.cumsum(p, axis=1)
        u = uniform(self.seeds[text], turn, slot, OTHER) * running[:, -1]
        pick = np.minimum((running <= u[:, None]).sum(axis=1), width - 1)
        new = begin + pick
        gone = pools["gone"][at] + np.exp(self.t["logp"][old])
        # Anything after it: the rest of the chunk, then fresh draws for the later chunks.
        after = self.t["next"][new]
        later = self.counts[text] - slot - 1
        parts = (after >= 0) + later
        first = np.cumsum(parts) - parts
        of = np.repeat(np.arange(len(text)), parts)
        place = slot[of] + 1 + np.arange(len(of)) - first[of] - (after >= 0)[of]
        inside = place == slot[of]
        states = np.where(inside, after[of], self.state[np.minimum(self.begin[text][of] + place, len(self.state) - 1)])
        drawn, counts = self._draw(turn, text[of], place, states, salt=1)
        tail = np.bincount(of, counts, len(text)).astype(np.int64)
        sizes = head + 1 + tail
        start = np.cumsum(sizes) - sizes
        out = {k: np.zeros(int(sizes.sum()), v.dtype) for k, v in pools.items()}
        source = ranges(at - head, head)
        target = ranges(start, head)
        for k in ("slot", "option"):
            out[k][target] = pools[k][source]
        out["slot"][start + head], out["option"][start + head], out["mask"][start + head], out["gone"][start + head] = slot, new, mask, gone
        target = ranges(start + head + 1, tail)
        out["option"][target], out["slot"][target] = drawn, np.repeat(place, counts)
        self._close(turn, text, sizes, out["slot"], out["option"], out["mask"], out["gone"], head, best[text])

    def run(self, samples: int) -> np.ndarray:
        """Fills `samples` rounds; returns each text's greatest perturbed log probability beyond them."""
        self.first()
        for _ in range(samples - 1):
            self.next()
        return self.best_left()[0]


@functools.cache
def lattices(path: str) -> Lattices:
    return Lattices(Model(path))


def sample(held: Lattices, texts: list[str | None], keys: list[int], samples: int):
    """(text's number, rank, ids, log probability, perturbed, log inclusion score) of each sample, in order of rank.

    The inclusion score is the probability that the segmentation is among the samples given the greatest perturbed value
    beyond them; it is 1 where there are no more segmentations.
    """
    if held.n_states > STATES_HELD:
        held.clear()
    chunks = [held.model.chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    counts = np.array([len(c) for c in chunks], np.int64)
    known = len(held.numbers)
    numbers = np.fromiter(map(held.numbers.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, int(counts.sum()))
    for new in itertools.batched(itertools.islice(held.numbers, known, None), LEARNED):
        held.learn(list(new))
    tables = held.arrays()
    if not tables:
        for i in range(len(texts)):
            yield i, 0, np.empty(0, np.int64), 0.0, 0.0, 0.0
        return
    states, ends = tables["first"].astype(np.int64)[numbers], np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, len(texts), SEARCHED):
        b = min(a + SEARCHED, len(texts))
        search = Search(tables, counts[a:b], states[ends[a] : ends[b]], np.array(keys[a:b], np.int64))
        for i, *found in _samples(search, samples):
            yield a + i, *found


def _samples(search: Search, samples: int):
    tables, beyond = search.t, search.run(samples)
    for rank, r in enumerate(search.rounds):
        sizes = tables["id_count"][r["option"]]
        ids = tables["ids"][ranges(tables["id_start"][r["option"]], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        with np.errstate(divide="ignore", over="ignore"):
            gap = r["logp"] - beyond[r["text"]]
            inclusion = np.where(gap > -30, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))), gap)
        for j, i in enumerate(r["text"].tolist()):
            a, b = r["begin"][j], r["begin"][j] + r["sizes"][j]
            yield i, rank, ids[ends[a] : ends[b]], float(r["logp"][j]), float(r["best"][j]), float(inclusion[j])


RESULT = "doc_id long, rank int, n_ids long, log_p double, perturbed double, log_inclusion double, ids_crc32 long, decoded boolean, ids array<int>"


def _sampled(path: str, samples: int):
    def run(batches):
        held = lattices(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                some = batch.slice(a, 1000)
                ids, texts = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
                rows = []
                for i, rank, found, logp, perturbed, inclusion in sample(held, texts, [x or 0 for x in ids], samples):
                    text = (texts[i] or "").replace(SPACE, " ")
                    rows.append((ids[i], rank, len(found), logp, perturbed, inclusion, zlib.crc32(found.astype("<u4").tobytes()), held.model.decode(found) == text, found.astype(np.int32)))
                types = (pa.int64(), pa.int32(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.bool_(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 9, types, strict=True)], [f.split()[0] for f in RESULT.split(", ")])

    return run


def sampled_segmentations(docs: DataFrame, model: str, samples: int = SAMPLES) -> DataFrame:
    """docs(doc_id, text, ...) -> a row per document and sample: doc_id, rank, n_ids, log_p, perturbed, log_inclusion, ids_crc32, decoded, ids.

    Segmentations of one document are distinct; it has fewer rows than samples only if its text has fewer segmentations. A null or
    empty text has one, without ids. decoded tells whether the ids decode to the text, with the space mark as a space. Rows that
    repeat a doc_id draw from the same random numbers; a null doc_id draws as 0. Other columns are ignored; an empty table gives
    an empty result. model: path of the SentencePiece model on the workers.
    """
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_sampled(model, samples), RESULT)
