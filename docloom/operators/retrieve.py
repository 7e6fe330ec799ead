"""Search as one operator: filters, both branches, fusion, checks of identity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import Hybrid, Sparse
from docloom.errors import RetrievalError
from docloom.functions import vectors
from docloom.operators import dense, hybrid, sparse
from docloom.operators.corpus import require_none

#: Columns by which queries may narrow the chunks.
FILTERS = ("domain", "document_id", "date_from", "date_to")
ATTRIBUTES = ("domain", "document_id", "source_date")


def allowed(chunk: Column, query: Column) -> Column:
    """Whether a chunk (struct with ATTRIBUTES) passes a query's filters (struct with FILTERS, null: any). A chunk without date fails any bound. Both branches use this one predicate."""
    same = lambda c: query[c].isNull() | F.coalesce(chunk[c] == query[c], F.lit(False))
    date = lambda c, ok: query[c].isNull() | F.coalesce(ok, F.lit(False))
    return same("domain") & same("document_id") & date("date_from", chunk["source_date"] >= query["date_from"]) & date("date_to", chunk["source_date"] <= query["date_to"])


def with_filters(queries: DataFrame) -> DataFrame:
    """queries with all FILTERS, null where they had none."""
    kinds = {"domain": "string", "document_id": "long", "date_from": "date", "date_to": "date"}
    return queries.withColumns({c: F.lit(None).cast(kinds[c]) for c in FILTERS if c not in queries.columns})


def query_violations(queries: DataFrame) -> DataFrame:
    """query_id, rule of queries that can't be asked: blank, or dates in the wrong order."""
    rules = F.array_compact(F.array(F.when(~F.coalesce(F.col("question").rlike(r"(?U)\S"), F.lit(False)), "blank_question"), F.when(F.col("date_from") > F.col("date_to"), "dates_reversed")))
    return with_filters(queries).select("query_id", F.explode(rules).alias("rule"))


def filtered_hits(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits (query_id, chunk_id and others) whose chunk passes their query's filters: attributes are joined to the hits, never chunks to queries."""
    c = chunks.select("chunk_id", F.struct(*ATTRIBUTES).alias("_chunk"))
    q = with_filters(queries).select("query_id", F.struct(*FILTERS).alias("_query"))
    return hits.join(q, "query_id").join(c, "chunk_id").filter(allowed(F.col("_chunk"), F.col("_query"))).select(*hits.columns)


def by_terms(index: sparse.SparseIndex, chunks: DataFrame, queries: DataFrame, k: int, config: Sparse = Sparse()) -> DataFrame:
    """sparse.search() for queries with or without FILTERS; an index without attributes has them joined to its hits."""
    if not any(c in queries.columns for c in FILTERS):
        return sparse.search(index, queries, k, config)
    if index.packed is None or "attributes" not in index.packed.columns:
        return sparse.top_k(filtered_hits(sparse.scores(index, queries, config), chunks, queries), k)
    return sparse.search(index, with_filters(queries).select("query_id", "question", F.struct(*FILTERS).alias("filters")), k, config, allowed)


def filtered_counts(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and n, the chunks that pass its filters: chunks are counted by attributes first, so a query meets sums, not chunks."""
    q = with_filters(queries)
    # without a document named, documents need not be told apart
    named = "document_id" in queries.columns
    sums = chunks.groupBy("domain", "source_date", *(["document_id"] if named else [])).agg(F.count(F.lit(1)).alias("c"))
    sums = sums if named else sums.withColumn("document_id", F.lit(None).cast("long"))
    q = q.select("query_id", F.struct(*FILTERS).alias("_query"))
    hits = q.join(sums.select(F.struct(*ATTRIBUTES).alias("_chunk"), "c"), allowed(F.col("_chunk"), F.col("_query")))
    return q.select("query_id").join(hits.groupBy("query_id").agg(F.sum("c").alias("n")), "query_id", "left").fillna(0, ["n"])


def collisions(*branches: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """chunk_id and versions of chunks that lists name with different payloads: one identity, two contents."""
    rows = reduce(DataFrame.unionByName, (b.select("chunk_id", F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256).alias("h")) for b in branches))
    return rows.groupBy("chunk_id").agg(F.count_distinct("h").alias("versions")).filter("versions > 1")


def index_violations(answers: DataFrame, sizes: DataFrame) -> DataFrame:
    """query_id, rule of a reranker's answers (query_id, index) against the number of candidates (query_id, n): an index twice, or none of 0 to n - 1."""
    twice = answers.groupBy("query_id", "index").count().filter("count > 1").select("query_id", F.lit("duplicate_index").alias("rule"))
    out = answers.join(sizes, "query_id", "left").filter(F.col("n").isNull() | (F.col("index") < 0) | (F.col("index") >= F.col("n"))).select("query_id", F.lit("index_out_of_range").alias("rule"))
    return twice.unionByName(out).distinct()


@dataclass(frozen=True)
class HybridSearch:
    """Chunks searched by terms and by vectors at once.

    chunks: chunk_id, text and ATTRIBUTES; vectors: chunk_id, vector; embed makes
    (query_id, vector) of (query_id, question). Made by build(), searched in batches.
    """

    chunks: DataFrame
    index: sparse.SparseIndex
    vectors: DataFrame
    rules: DataFrame | None = None
    config: Hybrid = Hybrid()
    terms: Sparse = Sparse()

    @classmethod
    def build(cls, chunks: DataFrame, rules: DataFrame | None = None, config: Hybrid = Hybrid(), terms: Sparse = Sparse()) -> HybridSearch:
        attributes = ATTRIBUTES if all(c in chunks.columns for c in ATTRIBUTES) else ()
        index = sparse.build(chunks, terms, attributes=attributes)
        rows = chunks.withColumn("attributes", F.struct(*attributes)) if attributes else chunks
        return cls(chunks, index, vectors.hash_vectors(rows, "chunk_id", "text", keep=("attributes",) if attributes else ()), rules, config, terms)

    def embed(self, queries: DataFrame) -> DataFrame:
        return vectors.hash_vectors(queries, "query_id", "question")

    def by_terms(self, queries: DataFrame) -> DataFrame:
        return by_terms(self.index, self.chunks, queries, self.config.branch_top_k, self.terms)

    def by_vectors(self, queries: DataFrame) -> DataFrame:
        asked, stored = self.embed(queries.select("query_id", "question")), self.vectors
        narrowed = any(c in queries.columns for c in FILTERS)
        if narrowed:
            asked = asked.join(with_filters(queries).select("query_id", F.struct(*FILTERS).alias("filters")), "query_id")
            if "attributes" not in stored.columns:
                stored = stored.join(self.chunks.select("chunk_id", F.struct(*ATTRIBUTES).alias("attributes")), "chunk_id")
        return dense.search(stored, asked, self.config.branch_top_k, where=allowed if narrowed else None)

    def search(self, queries: DataFrame) -> DataFrame:
        """The fused list of each query (query_id, question and any FILTERS), with both branches' ranks and scores: expanded, searched by both branches with equal filters, fused. A blank question or reversed dates are an error; a failing branch fails the query."""
        require_none(query_violations(queries), "a query that can't be asked", RetrievalError)
        if self.rules is not None:
            queries = hybrid.expand(queries, self.rules, self.config).drop("expansions", "question").withColumnRenamed("retrieval_query", "question")
        return hybrid.rrf(self.by_vectors(queries), self.by_terms(queries), self.config)

    def rebuilt(self, results: DataFrame) -> DataFrame:
        """results with their chunks' columns; a chunk that is not stored is an error."""
        require_none(results.join(self.chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"), "a result that is not stored", RetrievalError)
        return results.join(self.chunks, "chunk_id")
