"""String similarities between 0 and 1, over Arrow batches. Null in, null out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; rows of the table are bits of one integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _remainders(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _remainders(a, b)
    if both and not (left and right):
        return 1.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([indel(with_left, with_right)] + ([indel(both, with_left), indel(both, with_right)] if both else []))


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text against windows of its length in the longer, shorter ones at the ends."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    best = max(indel(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
    return max(best, max(indel(b, a[max(0, i) : i + len(b)]) for i in range(1 - len(b), len(a)))) if len(a) == len(b) else best


def _windows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of characters a(m, rows) and b(n, rows) the best ratio of a against windows of its length in b, shorter ones at the ends.

    Seaweeds (semi-local LCS): each cell of the table is met once, for all windows; the LCS of a and b[i:j] is j - i less the strands that
    go from a place in i..j-1 on the top to one on the bottom."""
    m, n, rows = len(a), len(b), a.shape[1]
    kind = np.uint8 if m + n < 256 else np.uint32
    down = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], rows, 1)
    for i in range(m):
        across = np.full(rows, m - 1 - i, kind)
        for j in range(n):
            swap = a[i] == b[j]
            swap |= across > down[j]
            moved = (across ^ down[j]) * swap
            across ^= moved
            down[j] ^= moved
    best = np.zeros(rows)
    for i in range(1 - m, n):
        lo, hi = max(0, i), min(n, i + m)
        common = hi - lo - (down[lo:hi] >= m + lo).sum(0)
        np.maximum(best, 2 * common / (m + hi - lo), out=best)
    return best


def partial_many(pairs: list[tuple[str, str]], least: int = 8) -> np.ndarray:
    """partial of each pair; those of equal lengths together, few of a kind one by one."""
    out, kinds = np.zeros(len(pairs)), {}
    for i, (a, b) in enumerate(pairs):
        kinds.setdefault((min(len(a), len(b)), max(len(a), len(b))), []).append(i)
    for (m, n), at in kinds.items():
        if not m or len(at) < least:
            out[at] = [partial(*pairs[i]) for i in at]
            continue
        both = [sorted(pairs[i], key=len) for i in at]
        sides = [np.array([p[k] for p in both], f"U{size}").view(np.uint32).reshape(len(at), size).T for k, size in ((0, m), (1, n))]
        a, b = (np.ascontiguousarray(x.astype(np.uint8) if max(s.max() for s in sides) < 256 else x) for x in sides)
        out[at] = np.maximum(_windows(a, b), _windows(b, a)) if m == n else _windows(a, b)
    return out


def partial_token_set(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _remainders(a, b)
    return 1.0 if both else partial(left, right)


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(len(a), len(b)) // 2 - 1
    used, taken = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                taken.append(c)
                break
    m = len(taken)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(taken, [c for c, u in zip(b, used, strict=True) if u], strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


METRICS = {"ratio": indel, "token_sort": token_sort, "token_set": token_set, "partial": partial, "partial_token_set": partial_token_set, "jw": jaro_winkler}


def similarity(metric: str, a, b):
    f = METRICS[metric]

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        if metric == "partial":
            out, known = pd.Series(None, index=x.index, dtype="float64"), (x.notna() & y.notna()).to_numpy()
            out[known] = partial_many(list(zip(x[known], y[known], strict=True)))
            return out
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)], dtype="Float64").astype("float64")

    return run(a, b)
