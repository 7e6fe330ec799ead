"""The best of many scores for each of many queries, kept while batches pass by; runs in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores are compared to 9 digits, so what is this far below the last of the best can't be among them.
MARGIN = 2e-9
#: Scores offered but not yet sorted, at most.
MOST = 1_000_000


def as_ids(column: pa.Array) -> np.ndarray:
    """Integers as they are, anything else as objects."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array([*column.to_pylist(), None], object)[:-1]


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the ninth digit, halves away from 0; what is no number comes first, as in Spark's order."""
    return np.where(np.isnan(scores), np.inf, np.copysign(np.floor(np.abs(scores) * 1e9 + 0.5), scores))


class Best:
    """At most k (id, score) of each of n queries, by falling score to 9 digits, ties by id; least has what a score must reach to matter."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, score, ids))
            self.held += len(query)
            if self.held > min(MOST, 4 * self.k * len(self.least) + 1000):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drops what is beyond k; query, score, id of what is left."""
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        query, score, ids = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        value = rounded(score)
        place = ids if ids.dtype.kind in "iu" else np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place, -value, query))
        query = query[order]
        first = np.r_[0, np.flatnonzero(np.diff(query)) + 1]
        at = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        last = at == self.k - 1
        self.least[query[last]] = value[order[last]] * 1e-9 - MARGIN
        keep = order[at < self.k]
        self.parts = [(query[at < self.k], score[keep], ids[keep])]
        self.held = len(keep)
        return self.parts[0]

    def batch(self, names: tuple[str, str, str], kind: pa.DataType) -> pa.RecordBatch:
        query, score, ids = self.settle()
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, kind), pa.array(score, pa.float64())], names=list(names))
