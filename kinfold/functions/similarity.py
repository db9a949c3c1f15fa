"""Comparators of token lists.

The edit distance with transpositions has no built-in expression, so the
matrix comparators are Arrow-batched functions of two token lists. A bounded
number of matrix cells at a time, all cells are numbered by their two tokens,
each distinct token pair is measured once by one dynamic programme that runs
over all pairs, and the matrices are gathered from the results by index. The
greedy matching takes every cell that is best in its row and in its column, and
again on what is left. Cosine needs no Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.config import Parameters

PAIRS_AT_ONCE = 20_000
DISTANCE_CELLS = 1 << 25  # of the dynamic programme held at once, but for a pair that has more alone
MATRIX_CELLS = 1 << 20  # of score matrices held at once, but for a matrix that has more alone


def edit_distances(left: list[str], right: list[str], restricted: bool = False) -> np.ndarray:
    """Damerau-Levenshtein distances of paired strings; ``restricted``: no edits between transposed characters."""
    n = len(left)
    if not n:
        return np.zeros(0, dtype=np.int64)
    la, lb = (np.array([len(s) for s in side]) for side in (left, right))
    m, w = max(1, int(la.max())), max(1, int(lb.max()))
    a = np.ascontiguousarray(np.array(left, dtype=f"<U{m}").view(np.uint32).reshape(n, m).T)
    b = np.ascontiguousarray(np.array(right, dtype=f"<U{w}").view(np.uint32).reshape(n, w).T)
    cost = np.zeros((m + 1, w + 1, n), dtype=np.int16)  # of the first i and j characters
    cost[:, 0] = np.arange(m + 1)[:, None]
    cost[0] = np.arange(w + 1)[:, None]
    last_row = np.zeros((w, n), dtype=np.int16)  # last i whose character equals the column's
    for i in range(1, m + 1):
        same_row = a[i - 1] == b
        last_col = np.zeros(n, dtype=np.int16)  # last j whose character equals the row's
        for j in range(1, w + 1):
            same = same_row[j - 1]
            best = np.minimum(cost[i - 1, j - 1] + ~same, np.minimum(cost[i - 1, j], cost[i, j - 1]) + 1)
            k, c = last_row[j - 1], last_col
            # with characters between on both sides, substitutions are as cheap as a swap
            swap = (k == i - 1) & (c == j - 1) if restricted else (k == i - 1) | (c == j - 1)
            at = np.flatnonzero(swap & (k > 0) & (c > 0))
            if len(at):
                ka, ca = k[at], c[at]
                best[at] = np.minimum(best[at], cost[ka - 1, ca - 1, at] + (i - ka) + (j - ca) - 1)
            cost[i, j] = best
            last_col = np.where(same, np.int16(j), last_col)
        last_row[same_row] = i
    return cost[la, lb, np.arange(n)].astype(np.int64)


def token_similarities(vocabulary: np.ndarray, left: np.ndarray, right: np.ndarray, number_rule: bool, initial_rule: bool, restricted: bool = False) -> np.ndarray:
    """Similarity of pairs of tokens, given by their places in ``vocabulary``: equality for numbers and initials if the rules hold, else 1 - distance / length."""
    size = np.array([len(t) for t in vocabulary], dtype=np.int64)
    out = (left == right).astype(float)
    rest = left != right
    if number_rule:
        digits = np.array([t.isdigit() for t in vocabulary], dtype=bool)
        rest &= ~(digits[left] & digits[right])
    if initial_rule:
        rest &= (size[left] != 1) & (size[right] != 1)
    at = np.flatnonzero(rest)
    at = at[np.lexsort((size[right[at]], size[left[at]]))]  # like lengths together: little padding
    while len(at):
        n = min(len(at), PAIRS_AT_ONCE)
        while n > 1 and n * (size[left[at[:n]]].max() + 1) * (size[right[at[:n]]].max() + 1) > DISTANCE_CELLS:
            n = n // 2
        part, at = at[:n], at[n:]
        a, b = left[part], right[part]
        out[part] = 1.0 - edit_distances(vocabulary[a].tolist(), vocabulary[b].tolist(), restricted) / np.maximum(size[a], size[b])
    return out


def _picks(sim: np.ndarray) -> list[tuple[int, float]]:
    """Greedy matching (row, similarity): the largest cell (first by rows of equals), then without its row and column, and so on."""
    rows, cols = np.arange(sim.shape[0]), np.arange(sim.shape[1])
    out: list[tuple[int, float]] = []
    while len(rows) and len(cols):
        best = sim.argmax(axis=1)
        mine = np.flatnonzero(sim.argmax(axis=0)[best] == np.arange(len(rows)))  # none before it shares its row or column
        out += zip(rows[mine].tolist(), sim[mine, best[mine]].tolist())
        rows, cols = np.delete(rows, mine), np.delete(cols, best[mine])
        sim = np.delete(np.delete(sim, mine, axis=0), best[mine], axis=1)
    return out


def matrix_std(sim: np.ndarray) -> float:
    """Mean of the picks."""
    picks = _picks(sim)
    total = 0.0
    for _, s in picks:
        total += s
    return total / len(picks)


def matrix_kris(sim: np.ndarray) -> float:
    """Picks weighed by place in the shorter list: its first token counts most."""
    if sim.shape[0] > sim.shape[1]:
        sim = sim.T
    m = sim.shape[0]
    base = m * (m + 1) / 2
    total = 0.0
    for r, s in _picks(sim):
        total += s * (m - r) / base
    return total


def monge_elkan(sim: np.ndarray) -> float:
    """Mean over the first list of the best match in the second."""
    return float(sim.max(axis=1).sum()) / sim.shape[0]


MATRIX: dict[str, Callable[[np.ndarray], float]] = {"ScoringMatrixStd": matrix_std, "ScoringMatrixKris": matrix_kris, "MongeElkan": monge_elkan}


def _by_matrix(p: Parameters) -> Callable[[Column, Column], Column]:
    measure, number_rule, initial_rule = MATRIX[p.comparator], p.matrixNumTokenRule, p.matrixInitialRule

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        one, two = left.tolist(), right.tolist()
        m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (one, two))
        cells = m * n
        out = np.zeros(len(cells))
        at = 0
        while at < len(cells):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(cells[at:]), MATRIX_CELLS, side="right")))
            vocabulary, place = np.unique(np.array([t for i in range(at, to) for side in (one, two) for t in side[i]], dtype=object), return_inverse=True)
            ends = np.cumsum(np.stack([m[at:to], n[at:to]], axis=1).ravel())
            lists = np.split(place, ends[:-1])
            width = len(vocabulary)
            codes = [(a[:, None] * width + b[None, :]).ravel() for a, b in zip(lists[::2], lists[1::2])]
            pairs, cell = np.unique(np.concatenate(codes), return_inverse=True)
            sims = token_similarities(vocabulary, pairs // max(width, 1), pairs % max(width, 1), number_rule, initial_rule)[cell]
            for i, sim in enumerate(np.split(sims, np.cumsum(cells[at:to])[:-1]), at):
                if cells[i]:
                    out[i] = measure(sim.reshape(m[i], n[i]))
            at = to
        return pd.Series(out)

    return F.pandas_udf(run, "double")


def cosine(left: Column, right: Column, distinct: bool = False) -> Column:
    """Shared tokens (with repeats, unless the lists have none) over the geometric mean of the lists' lengths; 0 for an empty list."""
    both = F.array_intersect(left, right)
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.size(both) if distinct else F.aggregate(both, F.lit(0), lambda s, x: s + F.least(times(left, x), times(right, x)))
    size = F.sqrt(F.size(left).cast("double") * F.size(right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), shared / size).otherwise(0.0)


def comparator(p: Parameters) -> Callable[[Column, Column], Column]:
    """The similarity of two token lists that ``p`` names."""
    if p.comparator == "Cosine":
        return lambda left, right: cosine(left, right, p.removeDuplicateTokens)
    if p.comparator not in MATRIX:
        raise ValueError(f"no comparator {p.comparator!r}")
    return _by_matrix(p)


def token_similarity(p: Parameters, restricted: bool = False) -> Callable[[Column, Column], Column]:
    """The similarity of two tokens by the rules of ``p``."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        vocabulary, place = np.unique(np.concatenate([left.to_numpy(object), right.to_numpy(object)]), return_inverse=True)
        a, b = np.split(place, 2)
        return pd.Series(token_similarities(vocabulary, a, b, p.matrixNumTokenRule, p.matrixInitialRule, restricted))

    return F.pandas_udf(run, "double")
