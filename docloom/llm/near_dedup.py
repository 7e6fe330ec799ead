"""Near-duplicate classes by DartMinHash signatures, banding and exact verification.

Darts of unit density are thrown into the plane (weight x rank) of each element by
hashing; a set sees those that land below its element's weight. Each dart names one
of k coordinates, and a coordinate keeps the dart of smallest rank. Two sets agree in
a coordinate with the probability of their (weighted) Jaccard similarity. Ranks are
looked at only as far as all coordinates have a dart, about (k ln k + 2k) darts a set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import WordHashes, column, documents, gram_hashes, join_by_key, mix, slices, split_words, staged
from docloom.llm.components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 6
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_CELLS = 400_000


def shingles(hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the n-word shingles of a text, weighted by how often each occurs; a shorter text is one shingle, an empty one none.

    Whole weights are unit layers (see dart_signatures()): the k-th occurrence of a shingle is an element
    of its own, so the plain Jaccard similarity of two results is the weighted one of the texts.
    """
    if not len(hashes):
        return np.empty(0, np.uint64)
    found, times = np.unique(gram_hashes(hashes, n) if len(hashes) >= n else gram_hashes(hashes, len(hashes)), return_counts=True)
    return layered(found, times) if (times > 1).any() else found


def layered(elements: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sorted: an element for each unit of the elements' whole weights."""
    index = np.repeat(np.arange(len(elements)), times)
    level = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        return np.sort(elements[index] + mix(level.astype(np.uint64)) * (level > 0))


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, starts: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) uint32 signatures of weighted sets; set i is elements[starts[i]:starts[i+1]] (uint64) with weights > 0 (all 1 if None). Empty sets have zeros."""
    sets = len(starts) - 1
    best = np.full(sets * k, np.iinfo(np.uint64).max, np.uint64)
    count = np.diff(starts)
    doc = np.repeat(np.arange(sets), count)
    if weights is None:
        layer_of, room = elements, None
        total = count.astype(float)
    else:
        # a unit layer for each begun unit of weight; darts of the last one count below the fraction only
        layers = np.ceil(weights).astype(np.int64)
        index = np.repeat(np.arange(len(elements)), layers)
        level = np.arange(len(index)) - np.repeat(np.cumsum(layers) - layers, layers)
        with np.errstate(over="ignore"):
            layer_of = elements[index] + mix(level.astype(np.uint64)) * (level > 0)
        room = np.minimum(1.0, weights[index] - level)
        doc = doc[index]
        total = np.bincount(doc, room, sets)
    pending = total > 0
    low = np.zeros(sets)
    high = np.where(pending, k * (math.log(k) + 2) / np.maximum(total, 1e-9), 0)
    while pending.any():
        use = np.flatnonzero(pending[doc])
        d = doc[use]
        first = np.floor(low[d]).astype(np.int64)
        cells = np.ceil(high[d]).astype(np.int64) - first
        at = np.repeat(np.arange(len(use)), cells)
        rank_cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + first[at]
        with np.errstate(over="ignore"):
            seed = mix(layer_of[use][at] + rank_cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(float) * 2.0**-53)
        j = 0
        sel = np.flatnonzero(darts > 0)
        while len(sel):
            with np.errstate(over="ignore"):
                h = mix(seed[sel] + np.uint64((0xA0761D6478BD642F * (j + 1)) & (2**64 - 1)))
            dd = d[at[sel]]
            frac = h >> np.uint64(32)
            rank = rank_cell[sel] + frac.astype(float) * 2.0**-32
            ok = (rank >= low[dd]) & (rank < high[dd])
            if room is not None:
                ok &= (mix(h + np.uint64(1)) >> np.uint64(11)).astype(float) * 2.0**-53 < room[use][at[sel]]
            h, dd, rank = h[ok], dd[ok], rank[ok]
            # coordinate, then the dart's name, from further bits of its hash; the rank's order in the upper half
            more = mix(h)
            where = dd * k + (more % np.uint64(k)).astype(np.int64)
            order = (rank / np.maximum(high[dd], 1e-300) * (2.0**32 - 2)).astype(np.uint64)
            np.minimum.at(best, where, (order << np.uint64(32)) | (more >> np.uint64(32)))
            j += 1
            sel = sel[darts[sel] > j]
        open_ = (best.reshape(sets, k) == np.iinfo(np.uint64).max).any(1) & pending
        # coordinates that have a dart must keep it against later ranks: it counts as the earliest
        filled = best != np.iinfo(np.uint64).max
        best[filled] &= np.uint64(0xFFFFFFFF)
        low = np.where(open_, high, low)
        high = np.where(open_, 2 * high, high)
        pending = open_
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(sets, k)
    out[total == 0] = 0
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) int64 hashes of the bands of signatures."""
    with np.errstate(over="ignore"):
        out = np.broadcast_to(mix(np.arange(1, bands + 1).astype(np.uint64)), (len(signatures), bands)).copy()
        for i in range(rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + signatures[:, i::rows][:, :bands])
    return out.view(np.int64)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set_id (128-bit hash of the weighted shingle set), size (shingles), bands (array; none for a text without words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_id", pa.binary()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, texts in slices(batches, most=2_000_000):
            sets = [shingles(known(split_words(t)), words) for t in texts]
            ids = column(batch, "doc_id")
            i = 0
            while i < len(sets):
                j, cells = i, 0
                while j < len(sets) and (cells < _CELLS or j == i):
                    cells += max(len(sets[j]), bands * rows * 8)
                    j += 1
                part = sets[i:j]
                starts = np.concatenate([[0], np.cumsum([len(s) for s in part])])
                b = band_hashes(dart_signatures(np.concatenate(part), None, starts, bands * rows), bands, rows)
                lists = [x.tolist() if len(s) else [] for x, s in zip(b, part)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([set_name(s) for s in part], pa.binary()), pa.array([len(s) for s in part], pa.int64()), pa.array(lists, schema.field("bands").type)], schema=schema)
                i = j

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id binary, size long, bands array<long>")


def set_name(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def node_of(set_id: Column) -> Column:
    """A set's number in links and components: 64 bits of its name."""
    return F.conv(F.hex(F.substring(set_id, 1, 8)), 16, -10).cast("long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, shingles (sorted uint64 as bytes) of each row."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, texts in slices(batches, most=1_000_000):
            sets = [shingles(known(split_words(t)), words) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(set_name(s)[:8], signed=True) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets' exact Jaccard similarity is at least similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(column(batch, "sa"), column(batch, "sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                # integers, so that exactly 0.8 counts whatever its rounding
                ok.append(common * 1_000_000 >= round(similarity * 1_000_000) * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).cast(schema)

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(b, "b").hint("merge").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def block_links(xs: list[np.ndarray], ys: list[np.ndarray], x_labels: np.ndarray, y_labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(x, y) of sets of different labels that are similar enough, one for each y and label: shared elements are counted by an index of all xs."""
    flat = np.concatenate(xs)
    owner = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.array([len(x) for x in xs], np.int64)
    out = []
    for j, y in enumerate(ys):
        low, high = np.searchsorted(flat, y, "left"), np.searchsorted(flat, y, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        common = np.bincount(owner[at], minlength=len(xs))
        hit = (common * 1_000_000 >= round(similarity * 1_000_000) * (sizes + len(y) - common)) & (x_labels != y_labels[j])
        hit = np.flatnonzero(hit)
        _, first = np.unique(x_labels[hit], return_index=True)
        out += [(int(hit[i]), j) for i in first]
    return out


def remaining_links(rest: DataFrame, sets: DataFrame, similarity: float, x_block: int = 2_000_000, y_block: int = 1_000_000) -> DataFrame:
    """Links (a, b) between different classes within buckets: rest has band, node, label, size.

    The class that most of a bucket has is known to be one; so only the bucket's other
    documents are held against all of it. Both are dealt into blocks of about so many
    shingles, and each pair of blocks is a task's work: never a row for each pair.
    """
    most = rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    most = most.groupBy("band").agg(F.max_by(F.struct("label", "s"), F.struct("c", "label")).alias("main"), F.sum("s").alias("sx"), F.sum("c").alias("weight"))
    blocks = lambda c, n: F.greatest(F.lit(1), F.ceil(c / n).cast("int"))
    most = most.select("band", "weight", F.col("main.label").alias("main"), blocks(F.col("sx"), x_block).alias("nx"), blocks(F.col("sx") - F.col("main.s"), y_block).alias("ny"))
    rows = join_by_key(rest.select("band", "node", "label"), staged(most), "band", "weight").withColumn("y", F.col("label") != F.col("main"))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    xs = rows.select("band", "node", "label", deal("nx", 1).alias("i"), all_("ny").alias("j"), F.lit(False).alias("y"))
    ys = rows.filter("y").select("band", "node", "label", all_("nx").alias("i"), deal("ny", 2).alias("j"), F.lit(True).alias("y"))
    both = xs.unionByName(ys).join(sets, "node")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        side = part.column("y").to_numpy()
        nodes, labels = part.column("node").to_numpy(), part.column("label").to_numpy()
        found = [np.frombuffer(b, np.uint64) for b in part.column("shingles").to_pylist()]
        x, y = np.flatnonzero(~side), np.flatnonzero(side)
        links = block_links([found[k] for k in x], [found[k] for k in y], labels[x], labels[y], similarity) if len(x) and len(y) else []
        return pa.table({"a": pa.array([int(nodes[x[i]]) for i, _ in links], pa.int64()), "b": pa.array([int(nodes[y[j]]) for _, j in links], pa.int64())})

    return both.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) of components after more links between them."""
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"r{c}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    up = components(between)
    old = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return staged(old.unionByName(up.join(labels.select("node"), "node", "left_anti").select("node", "label")))


def near_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, firsts: int = 2) -> DataFrame:
    """doc_id, class_id, kept for each row of docs (doc_id, text, others unread).

    Documents are linked if the Jaccard similarity of their words-word shingles, each
    weighing as often as it occurs, is similarity or more (words as in common.WORD);
    class_id is the smallest doc_id of the documents linked directly or through others,
    and that document is kept. With 36 bands of 6 rows a link of exactly 0.8 is missed
    with probability 2e-5. A text of fewer words is one shingle; texts without words (or
    null) are one class. Every row is classed by its own text, also where rows repeat a
    doc_id; a row without doc_id gets the class of its text, or null if no row of the
    class has one. The order of rows changes nothing. A very long text is a large set.

    Texts of equal shingles are one set from the start. In each band bucket all sets are
    held against one, then, where several classes are left, against a few more, and at
    last those outside the bucket's main class against all of it, in blocks. So no pair
    of different classes in a bucket stays untried, and verification is exact on all
    shingles. Buckets that many sets share are never gathered: see common.join_by_key().
    """
    signs = staged(signed(docs, words, bands, rows))
    groups = staged(signs.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("bands").alias("bands")).withColumn("node", node_of(F.col("set_id"))))
    at = groups.filter(F.col("rep").isNotNull()).select(F.explode("bands").alias("band"), "node", "size")
    full = at.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    members = staged(join_by_key(at, staged(full), "band", "n").filter("n is not null").select("band", "node", "size", F.col("first").alias("last")))
    reps = groups.join(members.select("node").distinct(), "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    # several texts of one doc_id are several sets
    texts = docs.join(reps, "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("_text")).dropDuplicates(["doc_id", "_text"])
    sets = staged(shingle_sets(texts.select("text"), words))
    pairs = members.filter("node <> last").select(F.col("last").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(staged(verified(pairs, sets, similarity)))

    def undecided(rows: DataFrame) -> DataFrame:
        """Those rows (band, node, size, last) whose bucket has several classes among the sets after the last one that was held against all; with their label."""
        known = rows.filter("node > last").join(labels, "node", "left").select("band", "node", "size", F.coalesce("label", "node").alias("label"))
        known = staged(known)
        mixed = known.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y").select("band", "m")
        return staged(join_by_key(known, staged(mixed), "band", "m").filter("m is not null").drop("m"))

    rest = undecided(members)
    if not rest.isEmpty():
        nth = F.row_number().over(Window.partitionBy("band").orderBy("node"))
        heads = rest.withColumn("nth", nth).filter(F.col("nth") <= firsts).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("node", "label"))).alias("heads"))
        heads = heads.join(rest.groupBy("band").agg(F.count(F.lit(1)).alias("m")), "band")
        rest = staged(join_by_key(rest, staged(heads), "band", "m").drop("m"))
        head = F.explode(F.transform("heads", lambda h: F.struct(h["node"].alias("a"), h["label"].alias("la"))))
        pairs = rest.select("node", "label", head.alias("h")).filter("node > h.a and label <> h.la").select("h.a", F.col("node").alias("b")).distinct()
        labels = merged(labels, staged(verified(pairs, sets, similarity)))
        rest = undecided(rest.select("band", "node", "size", F.element_at("heads", -1)["node"].alias("last")))
        if not rest.isEmpty():
            labels = merged(labels, staged(remaining_links(rest, sets, similarity)))
    # a class is named by its smallest doc_id
    names = groups.select("node", "rep").join(labels, "node").groupBy("label").agg(F.min("rep").alias("class_id"))
    labelled = labels.join(names, "label").select("node", "class_id")
    classes = staged(groups.join(labelled, "node", "left").select("set_id", "n", F.coalesce("class_id", "rep").alias("class_id")))
    found = join_by_key(signs.select("doc_id", "set_id"), classes, "set_id", "n")
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_classes() keeps, one for each doc_id. Rows without doc_id can't be named in a class: they stay."""
    named = docs.filter("doc_id is not null")
    kept = near_classes(named, **options).filter("kept").select("doc_id").distinct()
    found = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return found.unionByName(docs.filter("doc_id is null"))
