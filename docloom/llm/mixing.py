"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources
form a pattern; only the patterns' sizes reach the solver. Each pattern can give its
size once, twice, up to the repeat limit, each repetition at a higher price, to any
of its sources; each source takes up to its target. The cheapest full flow says how
much of each pattern to take, and documents are then chosen by a seeded hash.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, documents, staged

WEIGHTS = (5, 2, 1)
SUBSETS = 1000  # documents of a pattern that share a hash range, about
SEED = 20
#: Membership patterns that may reach the driver, a row each; more are an error.
MAX_PATTERNS = 200_000


def targets(sizes: dict, weights: dict, total: float, limit: float = 3.0) -> dict:
    """Shares of total by weight; none is over limit times its source's size, what is over goes to the others by weight."""
    out: dict = {}
    open_ = {s for s, n in sizes.items() if n > 0}
    left = float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > limit * sizes[s]}
        if not over:
            out |= {s: left * weights[s] / weight for s in open_}
            break
        for s in over:
            out[s] = float(limit * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return {s: out.get(s, 0.0) for s in sizes}


def flow(patterns: dict[tuple, int], quotas: dict, repeats: int = 3) -> dict[tuple[tuple, object], int]:
    """Words that each pattern gives to each of its sources: a min-cost flow of as much as quotas and repeats allow.

    Arcs: start to pattern, its size for each repetition r at cost r * r; pattern to
    source, free; source to end, the quota. Successive shortest paths with potentials.
    """
    if all(len(p) == 1 for p in patterns):  # one way only
        return {(p, p[0]): min(round(quotas.get(p[0], 0)), repeats * n) for p, n in patterns.items() if n and round(quotas.get(p[0], 0))}
    names = list(patterns)
    sources = sorted({s for p in names for s in p}, key=repr)
    index = {s: 2 + len(names) + k for k, s in enumerate(sources)}
    n = 2 + len(names) + len(sources)
    graph: list[list[list]] = [[] for _ in range(n)]

    def arc(a: int, b: int, room: int, cost: int) -> list:
        x, y = [b, room, cost, None], [a, 0, -cost, None]
        x[3], y[3] = y, x
        graph[a].append(x)
        graph[b].append(y)
        return x

    links = {}
    for k, p in enumerate(names):
        for r in range(1, repeats + 1):
            arc(0, 2 + k, patterns[p], r * r)
        for s in p:
            links[p, s] = arc(2 + k, index[s], repeats * patterns[p], 0)
    for s in sources:
        arc(index[s], 1, round(quotas.get(s, 0)), 0)
    price = [0] * n
    while True:
        far: list[float] = [float("inf")] * n
        via: list = [None] * n
        far[0], todo = 0, [(0, 0)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for x in graph[a]:
                if x[1] > 0 and d + x[2] + price[a] - price[x[0]] < far[x[0]]:
                    far[x[0]] = d + x[2] + price[a] - price[x[0]]
                    via[x[0]] = x
                    heapq.heappush(todo, (far[x[0]], x[0]))
        if far[1] == float("inf"):
            break
        price = [p + (f if f < float("inf") else far[1]) for p, f in zip(price, far)]
        path, at = [], 1
        while at:
            path.append(via[at])
            at = via[at][3][0]
        room = min(x[1] for x in path)
        for x in path:
            x[1] -= room
            x[3][1] += room
    return {k: x[3][1] for k, x in links.items() if x[3][1] > 0}


def nearest_sum(sizes: list[int], need: int, window: int = 24) -> list[bool]:
    """Which of sizes to take so that they sum to about need.

    In their order those that fit in what is still needed are taken, to the end; larger
    ones are passed over. The last window of those taken and the smallest window of those
    passed over are then chosen anew: the subset whose sum is nearest, found by all sums
    that are possible (a bit each), the lower one of two that are as near.
    """
    taken = [False] * len(sizes)
    for k, n in enumerate(sizes):
        if 0 < n <= need:
            taken[k], need = True, need - n
    last = [k for k, t in enumerate(taken) if t][-window:]
    over = sorted((k for k, t in enumerate(taken) if not t and sizes[k] > 0), key=lambda k: (sizes[k], k))[:window]
    part = sorted(last + over)
    need += sum(sizes[k] for k in last)
    # a sum over twice of what is needed is farther off than none
    mask = (1 << 2 * need + 1) - 1
    sums = [1]
    for k in part:
        sums.append((sums[-1] | sums[-1] << sizes[k]) & mask if sizes[k] <= 2 * need else sums[-1])
    low = sums[-1] & ((1 << need + 1) - 1)
    best = low.bit_length() - 1
    high = sums[-1] >> need + 1
    if high and (high & -high).bit_length() < need - best:
        best = need + (high & -high).bit_length()
    for k, before in zip(part[::-1], sums[-2::-1]):
        # left out where the sums before reach it without
        taken[k] = not before >> best & 1
        best -= sizes[k] if taken[k] else 0
    return taken


def _pattern(membership: str | None) -> Column:
    """The names of a row's sources in order; '=' before a name tells a null source, '~', from any string."""
    member = F.col(membership) if membership else F.array(F.col("source"))
    return F.array_sort(F.array_distinct(F.transform(member, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("~")))))


def _place(seed: int, membership: str | None) -> Column:
    """A row's place in the order of its pattern: rows of equal doc_id, text and sources share it."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), _pattern(membership))


def _mix(docs: DataFrame, weights: tuple[int, ...], membership: str | None, repeats: int, seed: int, max_patterns: int) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = staged(docs.select("doc_id", size.alias("size"), _pattern(membership).alias("pattern"), _place(seed, membership).alias("h")))
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of membership; join rare sources first, or raise max_patterns")
    patterns = {tuple(r.pattern): r.size for r in sums}
    counts = {tuple(r.pattern): r.n for r in sums}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s == "~", s.encode()))}
    target = targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(sizes)}, sum(patterns.values()), repeats)
    want = dict.fromkeys(patterns, 0)
    for (p, _), n in flow({p: n for p, n in patterns.items() if n}, target, repeats).items():
        want[p] += n
    spark = docs.sparkSession
    plan = [(list(p), min(want[p] // n, repeats) if n else 0, (want[p] - n * min(want[p] // n, repeats)) if n else 0, max(1, -(-counts[p] // SUBSETS)), sizes[p[0]], target[p[0]]) for p, n in patterns.items()]
    schema = "pattern array<string>, rounds long, rest long, ranges long, source_size long, target double"
    table = F.broadcast(spark.createDataFrame(plan or [([], 0, 0, 1, 0, 0.0)], schema))  # a row a pattern, as collected above
    rows = rows.join(table, "pattern", "left").withColumn("range", F.floor((F.shiftrightunsigned("h", 11) / float(1 << 53)) * F.col("ranges")).cast("long"))
    # running sums over ranges, not documents; each pattern's ranges are one window
    by = rows.groupBy("pattern", "range", "rest").agg(F.sum("size").alias("inside"))
    upto = by.withColumn("upto", F.sum("inside").over(Window.partitionBy("pattern").orderBy("range")))
    edge = upto.filter(F.col("upto") > F.col("rest")).groupBy("pattern").agg(F.min_by(F.struct("range", (F.col("rest") - (F.col("upto") - F.col("inside"))).alias("need")), "range").alias("edge"))
    edge = F.broadcast(edge.select("pattern", "edge.range", "edge.need").withColumnsRenamed({"range": "edge"}))  # at most a row a pattern
    rows = staged(rows.join(edge, "pattern", "left"))

    def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "doc_id", "size"], kind="stable")
        whole = (part["size"] * part["n"]).tolist()
        return part[["pattern", "h", "doc_id", "size"]].assign(extra=nearest_sum(whole, int(part["need"].iloc[0])))

    kept = ["doc_id", "size", "pattern", "h", "rounds", "rest", "source_size", "target"]
    at_edge = F.coalesce(F.col("range") == F.col("edge"), F.lit(False))
    before = F.coalesce(F.col("range") < F.col("edge"), F.col("rest") > 0) & (F.col("size") > 0)
    plain = rows.filter(~at_edge).select(*kept, before.alias("extra"))
    # equal rows are one unit, so a group has about SUBSETS units however often one repeats
    units = rows.filter(at_edge).groupBy("pattern", "h", "doc_id", "size", "need").agg(F.count(F.lit(1)).alias("n"))
    units = units.groupBy("pattern").applyInPandas(choose, "pattern array<string>, h long, doc_id long, size long, extra boolean")
    same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"u.{c}")) for c in ("pattern", "h", "doc_id", "size")))
    chosen = rows.filter(at_edge).alias("r").join(units.alias("u"), same, "left").select(*(f"r.{c}" for c in kept), "u.extra")
    found = plain.unionByName(chosen)
    copies = F.when(F.col("size") > 0, F.col("rounds") + F.col("extra").cast("long")).otherwise(F.lit(0).cast("long"))
    names = F.transform("pattern", lambda s: F.when(s != "~", F.substring(s, 2, 1 << 30)))
    return found.select("doc_id", "size", names.alias("sources"), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, membership: str | None = None, repeats: int = 3, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, size, sources (array), source_size, target, copies and taken (copies * size) of each row of docs (doc_id, text, source and others).

    membership: an array column of sources; if None, [source]. size: number of words
    of the text (null: 0). Sources sorted by code point, null last, have the weights in
    turn. Targets share all documents' sizes (see targets(): at most repeats times a
    source's size). For a document in several sources, source_size and target are
    those of the first. Each pattern's words are taken in whole rounds of all its
    documents, then by seeded hash of doc_id and text: ranges of the hash with about
    SUBSETS documents each are taken whole while they fit, and in the first that doesn't,
    the documents that nearest_sum() chooses. Rows of size 0 are taken 0 times. Rows of
    equal doc_id, text and sources are taken alike, so the order of rows changes nothing; a null
    or repeated doc_id is told apart by its text. A very long text is one document of
    its size. A row for each pattern reaches the driver (at most max_patterns), no more.
    """
    return _mix(docs, weights, membership, repeats, seed, max_patterns).drop("h")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, membership: str | None = None, repeats: int = 3, seed: int = SEED, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() takes it, with docs' columns."""
    copies = _mix(docs, weights, membership, repeats, seed, max_patterns).filter(F.col("copies") > 0).groupBy(F.col("h").alias("at"), F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), _place(seed, membership).alias("place"))
    found = rows.join(copies, (F.col("place") == F.col("at")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", F.col("sources")[0].alias("source"))
