"""Removal of repeated passages by prefix-partitioned sparse suffix trees over words.

Only suffixes at anchors enter the trees: in each window of 20 words the 8-word gram
of least hash is an anchor, so equal windows have equal anchors at equal places, and
an anchor gram that occurs once in the corpus lies in no repeat. The suffixes at
recurring anchors are split by prefixes of variable length: the first 8 words, for groups
too large for a task the first 20, and these by document as well, since a passage that very
many share is the same to its end.
Each group is a subtree: its suffixes sorted by words, with the
common prefix of neighbours, which gives the nodes of each depth. A window that
begins o words before its anchor repeats where suffixes meet in a node at least 20 - o
words deep and agree in the o words to the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WordHashes, column, discard, documents, gram_hashes, join_by_key, mix, release, slices, split_words, staged, table

WINDOW, GRAM = 20, 8
#: Suffixes in a group before its prefix grows.
GROUP = 10_000
#: Suffixes whose groups are built at a time.
BATCH = 50_000


def minimizers(words: np.ndarray, doc: np.ndarray | None = None, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window's start, the start of its anchor; -1 for windows across the ends of documents (doc: document of each word)."""
    if len(words) < window:
        return np.empty(0, np.int64)
    g = gram_hashes(words, gram)
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    index = (np.uint64(1) << bits) - np.uint64(1)
    x = ((g >> bits) << bits) | np.arange(len(g), dtype=np.uint64)
    span, width = 1, window - gram + 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < width:
        x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
    at = (x & index).astype(np.int64)
    if doc is not None:
        at[doc[: len(at)] != doc[window - 1 :]] = -1
    return at


def anchors(docs: DataFrame) -> DataFrame:
    """gram (hash), doc_id, pos of each anchor of each row, and deep, a hash of the suffix's first 20 words."""
    schema = "gram long, deep int, doc_id long, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = WordHashes(), table(schema)
        for batch, texts in slices(batches, most=2_000_000):
            words = [split_words(t) for t in texts]
            n = np.array([len(w) for w in words], np.int64)
            hashes = known([x for w in words for x in w])
            doc = np.repeat(np.arange(len(n)), n)
            at = minimizers(hashes, doc)
            at = at[at >= 0]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
            if len(at):
                begin = np.cumsum(n) - n
                grams = gram_hashes(hashes, GRAM)[at]
                # near a document's end it reads on into the next: such suffixes are merely split otherwise
                deep = gram_hashes(np.append(hashes, np.zeros(WINDOW, np.uint64)), WINDOW)[at]
                ids = column(batch, "doc_id").take(pa.array(doc[at]))
                yield out({"gram": grams.view(np.int64), "deep": (deep >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": ids, "pos": (at - begin[doc[at]]).astype(np.int32)})

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


SCANNED = "doc_id long, n_words long, kept_sha256 string, text string, hits binary"
SUFFIXES = "part long, split boolean, doc_id long, start int, anchor int, words binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without recurring anchors are done; of the others the text stays."""
    out = table(SCANNED)
    for batch, texts in slices(batches):
        hits = column(batch, "hits").to_pylist()
        words = [split_words(t) for t in texts]
        yield out({
            "doc_id": column(batch, "doc_id"), "n_words": [len(w) for w in words], "kept_sha256": [None if h else _digest(w) for w, h in zip(words, hits)],
            "text": [t if h else None for t, h in zip(texts, hits)], "hits": [np.array([(x["pos"], x["piece"]) for x in h], np.int32).tobytes() if h else None for h in hits],
        })


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each recurring anchor of each document, the words of the windows whose anchor it is, as 32-bit codes."""
    known, out = WordHashes(), table(SUFFIXES)
    for batch, texts in slices(batches, most=500_000):
        rows: dict[str, list] = {x.split()[0]: [] for x in SUFFIXES.split(", ")}
        for doc_id, t, h in zip(column(batch, "doc_id").to_pylist(), texts, column(batch, "hits").to_pylist()):
            hashes = known(split_words(t))
            at = minimizers(hashes)
            if not len(at):
                continue
            hit = np.frombuffer(h, np.int32).reshape(-1, 2)
            piece = np.full(len(hashes), -1, np.int64)
            piece[hit[hit[:, 0] < len(hashes), 0]] = hit[hit[:, 0] < len(hashes), 1]
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.append(cut[1:], len(at))
            codes = (hashes >> np.uint64(32)).astype("<u4")
            raw = codes.tobytes()
            a = at[cut]
            grams = gram_hashes(hashes, GRAM)[a]
            with np.errstate(over="ignore"):
                part = mix(grams + piece[a].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            use = np.flatnonzero(piece[a] >= 0)
            rows["part"] += part[use].tolist()
            rows["split"] += (piece[a][use] > 0).tolist()
            rows["doc_id"] += [doc_id] * len(use)
            rows["start"] += cut[use].tolist()
            rows["anchor"] += (a - cut)[use].tolist()
            rows["words"] += [raw[4 * s : 4 * (e - 1 + WINDOW)] for s, e in zip(cut[use].tolist(), ends[use].tolist())]
        if rows["part"]:
            yield out(rows)


FOUND = "doc_id long, start int, mask int, window long"


def subtree(part: np.ndarray, doc: np.ndarray, start: np.ndarray, anchor: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For suffix rows of whole groups: (mask, hashes): bit i of mask says that the window at start + i has an earlier equal; hashes (rows, 13) name the windows.

    part: group; anchor: the anchor's place from start; words: codes of the windows from start on.
    """
    n, left_most = len(part), WINDOW - GRAM
    size = np.array([len(w) // 4 for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), "<u4").astype(np.uint64)
    begin = np.cumsum(size) - size
    col = begin[:, None] + anchor[:, None] + np.arange(WINDOW)
    inside = anchor[:, None] + np.arange(WINDOW) < size[:, None]
    right = np.where(inside, flat[np.minimum(col, len(flat) - 1)], 0)
    col = begin[:, None] + anchor[:, None] - 1 - np.arange(left_most)
    left = np.where(anchor[:, None] > np.arange(left_most), flat[np.maximum(col, 0)], 0)
    # the suffix array of the groups, and the words that neighbours have in common
    pairs = (right[:, 0::2] << np.uint64(32)) | right[:, 1::2]
    order = np.lexsort([*pairs.T[::-1], part])
    same = right[order[1:]] == right[order[:-1]]
    common = np.where(same.all(1), WINDOW, np.argmin(same, axis=1))
    common = np.where(part[order[1:]] == part[order[:-1]], common, 0)
    by_time = np.lexsort([start + anchor, doc])
    mask = np.zeros(n, np.int64)
    windows = size - WINDOW + 1
    hashes = np.zeros((n, left_most + 1), np.uint64)
    lefts = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        rights = np.zeros((n, WINDOW + 1), np.uint64)
        for d in range(WINDOW):
            rights[:, d + 1] = mix(rights[:, d] * np.uint64(31) + right[:, d] + np.uint64(1))
        for o in range(left_most + 1):
            # nodes of depth WINDOW - o: runs of neighbours with as much in common
            node = np.empty(n, np.uint64)
            node[order] = np.concatenate([[0], np.cumsum(common < WINDOW - o)]).astype(np.uint64)
            key = mix(lefts + node)
            i = anchor - o
            valid = by_time[((i >= 0) & (i < windows))[by_time]]
            if len(valid):
                _, first, which = np.unique(key[valid], return_index=True, return_inverse=True)
                earliest = valid[first][which]
                again = (doc[earliest] != doc[valid]) | (start[earliest] != start[valid])
                mask[valid[again]] |= np.int64(1) << i[valid[again]]
                hashes[valid, i[valid]] = mix(lefts[valid] ^ mix(rights[valid, WINDOW - o] + np.uint64(o)))
            if o < left_most:
                lefts = mix(lefts * np.uint64(31) + left[:, o] + np.uint64(1))
    return mask, hashes


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of sorted groups, several small ones at a time; of split groups also the windows that are first in their piece."""
    out = table(FOUND)

    def build(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: rows.column(c).to_numpy()
        doc, start = get("doc_id"), get("start").astype(np.int64)
        words = rows.column("words").to_pylist()
        mask, hashes = subtree(get("part"), doc, start, get("anchor").astype(np.int64), words)
        hit = np.flatnonzero(mask)
        yield out({"doc_id": doc[hit], "start": start[hit].astype(np.int32), "mask": mask[hit].astype(np.int32), "window": pa.nulls(len(hit), pa.int64())})
        cut = np.flatnonzero(get("split"))
        if len(cut):
            n = np.array([len(w) // 4 - WINDOW + 1 for w in words])[cut]
            row = np.repeat(cut, n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            free = (mask[row] >> i) & 1 == 0
            row, i = row[free], i[free]
            yield out({"doc_id": doc[row], "start": (start[row] + i).astype(np.int32), "mask": np.ones(len(row), np.int32), "window": hashes[row, i].view(np.int64)})

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= BATCH:
            rows = pa.concat_tables(held)
            part = rows.column("part").to_numpy()
            other = part[::-1] != part[-1]
            last = len(part) - int(np.argmax(other)) if other.any() else 0
            if last:
                yield from build(rows.slice(0, last))
            held, size = [rows.slice(last)], len(part) - last
    if size:
        yield from build(pa.concat_tables(held))


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
SPANS = "array<struct<first:int,after:int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = table(KEPT)
    for batch, texts in slices(batches):
        removed, shas, ns, spans = [], [], [], []
        for t, repeats in zip(texts, column(batch, "repeats").to_pylist()):
            words = split_words(t)
            ns.append(len(words))
            steps = np.zeros(len(words) + 1, np.int64)
            for r in repeats or ():
                for i in range(r["mask"].bit_length()):
                    if r["mask"] >> i & 1 and r["start"] + i + WINDOW <= len(words):
                        steps[r["start"] + i] += 1
                        steps[r["start"] + i + WINDOW] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            removed.append(int(gone.sum()))
            shas.append(_digest([w for w, g in zip(words, gone.tolist()) if not g]))
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
            spans.append([{"first": a, "after": b} for a, b in zip(edges[::2], edges[1::2])])
        rows = out({"doc_id": column(batch, "doc_id"), "n_words": ns, "n_removed": removed, "kept_sha256": shas})
        yield rows.append_column("spans", pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))))


def deduplicated(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """KEPT for each row of docs (doc_id, text, others unread), and spans: the words removed, from first to before after.

    A window is 20 consecutive words (common.WORD) of a document. A word goes if a
    window over it has the words of another that starts earlier: in a smaller doc_id,
    or in the same document before. Windows are judged on the input. A null or empty
    text has no words; texts under 20 words lose none. Rows that repeat a doc_id are
    the same document: equal starts are equally early. A row without doc_id loses
    nothing and makes nothing a repeat. A very long text is many suffixes of bounded length.

    Words are compared by 32 bits of their hash, so of 4 billion pairs of windows that
    differ in one word, one would count as equal.
    """
    spark = docs.sparkSession
    found = staged(anchors(docs.filter("doc_id is not null")))
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = staged(counts)
    hits = join_by_key(found, counts, "gram", "n").filter("n is not null")
    any_split = not counts.filter(F.col("n") > group).isEmpty()
    # where more than `group` suffixes share 8 words the prefix is 20, dealt by document as far as all of them might share it; what the pieces miss of each other is merged below
    part = F.xxhash64("gram", "deep", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / group)))
    piece = F.when(F.col("n") > group, 1 + F.pmod(part, F.lit(1 << 30))).otherwise(0).cast("int")
    hits = hits.select("doc_id", "pos", piece.alias("piece"))
    hits = hits.select("doc_id", F.struct("pos", "piece").alias("hit"))
    hits = staged(hits.groupBy("doc_id").agg(F.collect_list("hit").alias("hits")))
    discard(found)
    release(spark)
    scanned = staged(docs.select("doc_id", "text").join(hits, "doc_id", "left").mapInArrow(_scan, SCANNED))
    release(spark)
    open_ = scanned.filter("kept_sha256 is null")
    suffixes = open_.select("doc_id", "text", "hits").mapInArrow(_suffixes, SUFFIXES)
    repeats = staged(suffixes.repartition("part").sortWithinPartitions("part").mapInArrow(_repeats, FOUND))
    if any_split:
        pieces = repeats.filter("window is not null")
        first = pieces.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
        again = join_by_key(pieces.select("window", "doc_id", "start", "mask"), staged(first), "window", "n").filter(F.struct("doc_id", "start") > F.col("first"))
        repeats = repeats.filter("window is null").select("doc_id", "start", "mask").unionByName(again.select("doc_id", "start", "mask"))
    repeats = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("start", "mask")).alias("repeats"))
    cut = open_.select("doc_id", "text").join(repeats, "doc_id", "left").select("doc_id", "text", "repeats").mapInArrow(_cut, f"{KEPT}, spans {SPANS}")
    whole = scanned.filter("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.array().cast(SPANS).alias("spans"))
    return whole.unionByName(cut)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).drop("spans")
