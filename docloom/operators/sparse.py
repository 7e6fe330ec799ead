"""BM25 as tables: postings, document frequencies, lengths; a batch of queries is a join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from docloom.config import Sparse
from docloom.errors import IndexingError
from docloom.functions.text import lexical_tokens, token_counts
from docloom.operators.best import Best, as_ids
from docloom.operators.corpus import require_none, row_fingerprint
from docloom.stage import staged

#: Terms of queries are broadcast if there are at most so many, and so many characters of them.
MAX_TERMS, MAX_TERM_CHARS = 200_000, 8_000_000
#: At most so many queries are scored where postings lie; chunks at once, and their pairs with queries.
MAX_SEARCHED, MAX_CHUNKS, MAX_PAIRS = 4000, 500, 1_000_000
#: Results of at most so many rows are sent to the table they are joined to.
MAX_FEW = 100_000


@dataclass(frozen=True)
class SparseIndex:
    """postings (chunk_id, term, tf, dl), df (term, df), stats (n, avgdl: one row).

    packed is what postings are unpacked from, if chunk_ids are unique: chunk_id, dl, terms, tfs
    (arrays) and any attributes (struct) by which queries may narrow the chunks.
    """

    postings: DataFrame
    df: DataFrame
    stats: DataFrame
    packed: DataFrame | None = None

    def write(self, path: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.df.write.mode("overwrite").parquet(f"{path}/df")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        fingerprint(self).write.mode("overwrite").json(f"{path}/header")

    @classmethod
    def read(cls, spark: SparkSession, path: str, check: bool = False) -> SparseIndex:
        """A written index; check: an error unless postings have its fingerprint and df and stats follow from them."""
        index = cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "df", "stats")))
        if check:
            said = spark.read.schema("n long, fingerprint string").json(f"{path}/header").first()
            if said != fingerprint(index).first():
                raise IndexingError("postings don't have the index's fingerprint")
            require_none(integrity(index), "an index that contradicts itself", IndexingError)
        return index


def build(chunks: DataFrame, config: Sparse = Sparse(), key: str = "chunk_id", text: str = "text", attributes: tuple[str, ...] = ()) -> SparseIndex:
    """The index of chunks. Texts are tokenised once, where they lie: a row of the shared folder has a chunk's postings, from which statistics and any number of searches read.

    Terms are counted within their row, so neither texts nor postings move and a task's
    memory doesn't grow with the chunks it reads. Rows of one chunk_id, which should be
    unique, are brought together afterwards.
    """
    rows = chunks.select(F.col(key).alias("chunk_id"), *([F.struct(*attributes).alias("attributes")] if attributes else []), F.col(text).alias("text"))
    known, stopwords = rows.schema.fields[:-1], config.stopwords

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                found = [token_counts(t, stopwords) for t in part.column(part.num_columns - 1).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                terms, tfs = pa.array(chain.from_iterable(found), pa.string()), pa.array(chain.from_iterable(f.values() for f in found), pa.int64())
                dl = pa.array([sum(f.values()) for f in found], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], dl, pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)], names=[*(f.name for f in known), "dl", "terms", "tfs"])

    packed = staged(rows.mapInArrow(pack, StructType([*known, StructField("dl", IntegerType()), StructField("terms", ArrayType(StringType())), StructField("tfs", ArrayType(LongType()))])))
    postings = packed.select("chunk_id", "dl", F.inline(F.arrays_zip("terms", "tfs"))).toDF("chunk_id", "dl", "term", "tf")
    # two sums of one row each; chunks without tokens count, too
    stats = staged(packed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).select("n", F.when(F.col("n") > 0, F.col("total") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0).alias("avgdl")))
    if not packed.groupBy("chunk_id").count().filter("count > 1").isEmpty():
        postings, packed = staged(postings.groupBy("chunk_id", "dl", "term").agg(F.sum("tf").alias("tf"))), None
    return SparseIndex(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats, packed)


def query_terms(queries: DataFrame, config: Sparse = Sparse()) -> DataFrame:
    """query_id, term, qtf, pos (first place in the query)."""
    rows = queries.select("query_id", F.posexplode(lexical_tokens(F.col("question"), config.stopwords)).alias("pos", "term"))
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"), F.min("pos").alias("pos"))


def term_score(config: Sparse) -> Column:
    """One term's part of the score, from tf, dl, df, n, avgdl and qtf."""
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avgdl = F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    tf = F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / avgdl))
    return idf * (tf + config.delta if config.variant == "bm25_plus" else tf) * F.col("qtf")


def scores(index: SparseIndex, queries: DataFrame, config: Sparse = Sparse(), allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score of chunks with a term of the query.

    Statistics are the whole index's, whatever is allowed: allowed (chunk_id, or
    query_id and chunk_id) cuts candidates, not counts. Where the queries' terms are few
    enough to be broadcast, postings of these terms move to their chunk's task, where
    they meet the queries and are summed: what is shuffled is part of the index, not a row
    for each query and chunk. Beyond that, postings and queries are joined by term.
    """
    asked = query_terms(queries, config)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if size.n <= MAX_TERMS and size.chars <= MAX_TERM_CHARS:
        wanted = index.df.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        hits = index.postings.join(F.broadcast(wanted), "term").repartition("chunk_id").join(F.broadcast(asked), "term")
    else:
        hits = index.postings.join(asked.join(index.df, "term"), "term")
    hits = hits.crossJoin(F.broadcast(index.stats))
    out = hits.groupBy("query_id", "chunk_id").agg(F.sum(term_score(config)).alias("score")).filter("score > 0")
    return out if allowed is None else out.join(allowed, [c for c in ("query_id", "chunk_id") if c in allowed.columns], "left_semi")


def top_k(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """rank from 1 by falling score (to 9 digits), ties by key; at most k for each query."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return scored.withColumn("rank", order).filter(F.col("rank") <= k)


def search(index: SparseIndex, queries: DataFrame, k: int, config: Sparse = Sparse(), where: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: top_k() of scores(); where: a condition on the index's attributes and the queries' filters (structs; needs an index with attributes)."""
    return searches(index, queries, [(k, config)], where)[0]


def searches(index: SparseIndex, queries: DataFrame, wanted: list[tuple[int, Sparse]], where: Callable[[Column, Column], Column] | None = None) -> list[DataFrame]:
    """search() for each k and config, which have the same stop words; the index is read once.

    Where postings are packed by chunk, those of the queries' terms are picked and scored
    where they lie and each task keeps its own k best of each query, so nothing else is
    shuffled and memory grows with the queries, not with the chunks. With many queries
    or filters, hits are joined.
    """
    spark, plain = index.postings.sparkSession, lambda: [top_k(_filtered(index, queries, c, where), k) for k, c in wanted]
    if where and (index.packed is None or "attributes" not in index.packed.columns):
        raise IndexingError("the index has no attributes to narrow by")
    if index.packed is None:
        return plain()
    asked = staged(query_terms(queries, wanted[0][1]))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars"), F.count_distinct("query_id").alias("queries")).first()
    if size.n > MAX_TERMS or size.chars > MAX_TERM_CHARS or size.queries > MAX_SEARCHED:
        return plain()
    rows, kept = index.packed, {}
    if where:
        filters = {r.query_id: r.filters for r in queries.select("query_id", "filters").collect()}
        place = {f: i for i, f in enumerate(dict.fromkeys(filters.values()))}
        if len(place) > 62:
            return plain()
        known = spark.createDataFrame([([*place],)], StructType([StructField("_filters", ArrayType(queries.schema["filters"].dataType))]))
        held = F.transform("_filters", lambda f, i: F.when(where(F.col("attributes"), f), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        rows = rows.crossJoin(F.broadcast(known)).withColumn("mask", F.aggregate(held, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))
        kept = {q: 1 << place[f] for q, f in filters.items()}
    said = asked.collect()
    terms = [*dict.fromkeys(r.term for r in said)]
    number, names = {t: i for i, t in enumerate(terms)}, [*dict.fromkeys(r.query_id for r in said)]
    hits = staged(_picked(rows, terms, bool(where)))
    df = dict(_picked_counts(hits, len(terms)).groupBy("term").agg(F.sum("n")).collect())
    stats = index.stats.first()
    at = {q: i for i, q in enumerate(names)}
    uses = sorted((number[r.term], at[r.query_id], r.qtf) for r in said)
    idf = np.array([math.log1p((stats.n - df.get(i, 0) + 0.5) / (df.get(i, 0) + 0.5)) for i in range(len(terms))])
    begin = np.searchsorted([u[0] for u in uses], np.arange(len(terms) + 1))
    bits = np.array([kept.get(q, 0) for q in names], np.int64) if where else None
    listed = spark.createDataFrame([*enumerate(names)], StructType([StructField("_query", IntegerType()), queries.schema["query_id"]]))
    found = StructType([StructField("_query", IntegerType()), hits.schema["chunk_id"], StructField("score", DoubleType())])
    out = []
    for k, config in wanted:
        score = Scorer(idf, begin, np.array([u[1] for u in uses], np.int64), np.array([u[2] for u in uses], np.float64), bits, len(names), k, config, stats.avgdl)
        out.append(top_k(hits.mapInArrow(score.best, found).join(F.broadcast(listed), "_query").select("query_id", "chunk_id", "score"), k))
    return out


def _picked(rows: DataFrame, terms: list[str], masked: bool) -> DataFrame:
    """chunk_id, dl, picked (places in terms), tfs and any mask of packed rows that have any of terms."""
    rows = rows.select("chunk_id", "dl", "terms", "tfs", *(["mask"] if masked else []))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            place = pc.index_in(batch.column(2).flatten(), value_set=known)
            some = place.is_valid()
            upto = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
            ends = pa.array(upto[np.r_[0, np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))]], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x.filter(some)) for x in (place, batch.column(3).flatten())]
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], *lists, *batch.columns[4:]], names=["chunk_id", "dl", "picked", "tfs", *batch.schema.names[4:]])
            yield out.filter(pa.array(np.diff(ends.to_numpy()) > 0))

    fields = {f.name: f for f in rows.schema}
    return rows.mapInArrow(pick, StructType([fields["chunk_id"], fields["dl"], StructField("picked", ArrayType(IntegerType())), fields["tfs"], *([fields["mask"]] if masked else [])]))


def _filtered(index: SparseIndex, queries: DataFrame, config: Sparse, where: Callable[[Column, Column], Column] | None) -> DataFrame:
    hits = scores(index, queries, config)
    if where is None:
        return hits
    found = hits.join(queries.select("query_id", "filters"), "query_id").join(index.packed.select("chunk_id", "attributes"), "chunk_id")
    return found.filter(where(F.col("attributes"), F.col("filters"))).select(*hits.columns)


def _picked_counts(hits: DataFrame, n: int) -> DataFrame:
    """term (place), n: how many rows of a task have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["term", "n"])

    return hits.select("picked").mapInArrow(count, "term int, n long")


@dataclass(frozen=True)
class Scorer:
    """Scores of chunks from their postings, a batch at a time: idf by term; the queries with a term (begin to begin[term + 1] of query and qtf); the filter of each of n queries as a bit."""

    idf: np.ndarray
    begin: np.ndarray
    query: np.ndarray
    qtf: np.ndarray
    kept: np.ndarray | None
    n: int
    k: int
    config: Sparse
    avgdl: float

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """_query, chunk_id, score from batches of chunk_id, dl, picked, tfs and any mask."""
        found, kind = Best(self.n, self.k), None
        for batch in batches:
            kind = batch.column(0).type
            for i in range(0, batch.num_rows, MAX_CHUNKS):
                self.score(batch.slice(i, MAX_CHUNKS), found)
        if kind is not None:
            yield found.batch(("_query", "chunk_id", "score"), kind)

    def score(self, rows: pa.RecordBatch, found: Best) -> None:
        column = lambda c: c.to_numpy(zero_copy_only=False)
        names, sizes = as_ids(rows.column(0)), column(pc.list_value_length(rows.column(2))).astype(np.int64)
        first, total = np.cumsum(sizes) - sizes, int(sizes.sum())
        chunk, dl = np.repeat(np.arange(len(names)), sizes), np.repeat(column(rows.column(1)), sizes)
        c, term, tf = self.config, column(rows.column(2).flatten()), column(rows.column(3).flatten()).astype(np.float64)
        part = tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * dl / (self.avgdl if self.avgdl > 0 else 1.0)))
        part = self.idf[term] * (part + c.delta if c.variant == "bm25_plus" else part)
        masks = column(rows.column(4)) if self.kept is not None else None
        times = self.begin[term + 1] - self.begin[term]
        work = np.cumsum(np.add.reduceat(times, first) + self.n)
        low = 0
        while low < len(first):  # so many chunks that their pairs with queries are few
            high = max(low + 1, int(np.searchsorted(work, (work[low - 1] if low else 0) + MAX_PAIRS, "right")))
            own = slice(first[low], first[high] if high < len(first) else total)
            t = times[own]
            use = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(self.begin[term[own]], t)
            sums = np.bincount(np.repeat(chunk[own] - low, t) * self.n + self.query[use], np.repeat(part[own], t) * self.qtf[use], (high - low) * self.n).reshape(high - low, self.n)
            some = sums > np.maximum(found.least, 0)
            if masks is not None:
                some &= (masks[low:high, None] & self.kept) != 0
            at, query = np.nonzero(some)
            found.offer(query, sums[at, query], names[low + at])
            low = high


def beside(few: DataFrame, many: DataFrame, on: str | list[str]) -> DataFrame:
    """few join many, with few's columns first. few is computed once; unless it has over MAX_FEW rows it is sent to where many lies, which is not shuffled."""
    few = staged(few)
    both = many.join(F.broadcast(few), on) if few.count() <= MAX_FEW else few.join(many, on)
    return both.select(*few.columns, *(c for c in many.columns if c not in few.columns))


def matched_terms(index: SparseIndex, queries: DataFrame, results: DataFrame, config: Sparse = Sparse()) -> DataFrame:
    """results with matched_terms, in the query's order, and term_frequencies."""
    results = staged(results)
    terms = beside(results.select("query_id", "chunk_id").join(query_terms(queries, config), "query_id"), index.postings, ["chunk_id", "term"])
    found = terms.groupBy("query_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "term", "tf"))).alias("m"))
    return results.join(found, ["query_id", "chunk_id"], "left").select(*results.columns, F.col("m.term").alias("matched_terms"), F.col("m.tf").alias("term_frequencies"))


def fingerprint(index: SparseIndex) -> DataFrame:
    """One row: entries and their fingerprint, whatever their order."""
    return row_fingerprint(index.postings, ["chunk_id", "dl", "term", "tf"])


def integrity(index: SparseIndex) -> DataFrame:
    """rule, key: what an index's df and stats say otherwise than its postings: df of a term, chunks counted below those with postings, and their lengths."""
    again = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("again"))
    terms = index.df.join(again, "term", "full").filter(~F.col("df").eqNullSafe(F.col("again"))).select(F.lit("document_frequency").alias("rule"), F.col("term").alias("key"))
    lengths = index.postings.groupBy("chunk_id").agg(F.sum("tf").alias("total"), F.max("dl").alias("dl"))
    wrong = lengths.filter("total <> dl").select(F.lit("length").alias("rule"), F.col("chunk_id").cast("string").alias("key"))
    sums = lengths.agg(F.count(F.lit(1)).alias("held"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).crossJoin(F.broadcast(index.stats))
    off = (F.col("held") > F.col("n")) | (F.abs(F.col("avgdl") * F.col("n") - F.col("tokens")) > 1e-6 * (1 + F.col("tokens")))
    return terms.unionByName(wrong).unionByName(sums.filter(off).select(F.lit("statistics").alias("rule"), F.lit("").alias("key")))
