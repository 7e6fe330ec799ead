"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import documents, slices, table
from docloom.llm.encoders import encoder, tokenizer_file

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


class _Bins:
    """Open sequences by free capacity; finds the cheapest with at least so much free: a tree of minima over capacities, a heap of sequences in each."""

    def __init__(self, capacity: int) -> None:
        self.n = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.low = [(float("inf"), -1)] * (2 * self.n)
        self.top = capacity

    def _set(self, free: int) -> None:
        i = free + self.n
        self.low[i] = (self.heaps[free][0][0], free) if self.heaps[free] else (float("inf"), -1)
        i >>= 1
        while i:
            self.low[i] = min(self.low[2 * i], self.low[2 * i + 1])
            i >>= 1

    def put(self, free: int, cost: float, name: int) -> None:
        heapq.heappush(self.heaps[free], (cost, name))
        self._set(free)

    def take(self, need: int) -> tuple[int, float, int] | None:
        """free, cost, name of the cheapest sequence with room for need."""
        best, lo, hi = (float("inf"), -1), need + self.n, self.top + self.n + 1
        while lo < hi:
            if lo & 1:
                best = min(best, self.low[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, self.low[hi])
            lo >>= 1
            hi >>= 1
        if best[1] < 0:
            return None
        cost, name = heapq.heappop(self.heaps[best[1]])
        self._set(best[1])
        return best[1], cost, name

    def roomiest(self) -> int:
        return max(f for f in range(self.top, 0, -1) if self.heaps[f])


def pack(lengths: list[int], capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items with these lengths.

    An item's cost is linear * n + quadratic * n * n (attention within a document).
    Whole capacities are cut off long items and are sequences by themselves. The
    rest, longest first, goes to the sequence of least cost that has room; if none
    has, it fills the roomiest and what is left of it queues again by its length.
    Sequences hold capacity tokens each but for the last tokens of all, which go to
    sequences of powers of two; so all are exactly full and none needs padding.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    queue: list[tuple[int, int, int]] = []
    used = 0
    for i, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            pieces.append((i, at, capacity, used, 0))
            used += 1
            at += capacity
        if at < n:
            queue.append((at - n, i, at))
    heapq.heapify(queue)
    rest = -sum(q[0] for q in queue)
    sizes = [capacity] * (rest // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (rest % capacity) >> b & 1]
    bins = _Bins(capacity)
    for k, s in enumerate(sizes):
        bins.put(s, 0.0, used + k)
    while queue:
        left, i, at = heapq.heappop(queue)
        n = -left
        found = bins.take(n)
        if found is None:
            free, cost, name = bins.take(bins.roomiest())
            heapq.heappush(queue, (free - n, i, at + free))
            n = free
        else:
            free, cost, name = found
        pieces.append((i, at, n, name, sizes[name - used] - free))
        if free > n:
            bins.put(free - n, cost + linear * n + quadratic * n * n, name)
    return pieces


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, group_tokens: int = 4_000_000) -> DataFrame:
    """Pieces of the token sequences of all rows, packed; see pack() for the method and SCHEMA for the columns.

    A document's tokens are the library's ids without special tokens, then end_id; a
    null or empty text has end_id alone; rows are packed one by one, so a repeated
    row is packed again; a null doc_id stays null. Documents are packed within the
    task that reads them, group_tokens or one document at a time, so memory is
    bounded, nothing is shuffled, and a task that runs again gives the same pieces.
    sequence_id holds the task's number in its upper bits. No row, no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, end = encoder(tokenizer), table(SCHEMA), np.array([end_id], np.uint32).tobytes()
        base = TaskContext.get().partitionId() << 36
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, names, size, base
            pieces = pack([len(x) // 4 for x in ids], capacity)
            total: dict[int, tuple[int, float]] = {}
            for _, _, n, s, _ in pieces:
                t, c = total.get(s, (0, 0.0))
                total[s] = (t + n, c + n + n * n / capacity)
            for k in range(0, len(pieces), 50_000):
                part = pieces[k : k + 50_000]
                yield out({
                    "doc_id": [names[p[0]] for p in part], "start": [p[1] for p in part], "length": [p[2] for p in part],
                    "ids_crc32": [zlib.crc32(memoryview(ids[p[0]])[4 * p[1] : 4 * (p[1] + p[2])]) for p in part], "doc_tokens": [len(ids[p[0]]) // 4 for p in part],
                    "sequence_id": [base + p[3] for p in part], "offset": [p[4] for p in part], "sequence_tokens": [total[p[3]][0] for p in part], "cost": [total[p[3]][1] for p in part],
                })
            base += len(total)
            ids, names, size = [], [], 0

        for batch, texts in slices(batches, most=4_000_000):
            flat, n = enc.encode_flat(texts)
            raw, at = memoryview(flat.tobytes()), 0
            for name, k in zip(batch.column(0).to_pylist(), n.tolist()):
                ids.append(b"".join((raw[at : at + 4 * k], end)))
                names.append(name)
                at += 4 * k
                size += k + 1
                if size >= group_tokens:
                    yield from flush()
        if ids:
            yield from flush()
        enc.forget()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
