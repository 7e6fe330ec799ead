"""Fusion of ranked lists, query expansion, several hops, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import Hybrid
from docloom.functions.text import REFERENCE, RELATION_CUES, casefold, contains_any, squeeze, whitespace_tokens
from docloom.operators.sparse import beside
from docloom.stage import staged


def best_of_branch(branch: DataFrame) -> DataFrame:
    """One row a query and chunk: the best rank, then the best score."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy("rank", F.desc("score"))
    return branch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def rrf(dense: DataFrame, sparse: DataFrame, config: Hybrid = Hybrid()) -> DataFrame:
    """Reciprocal rank fusion of two lists (query_id, chunk_id, rank, score) by full outer join; order: score, best rank, chunk_id."""
    side = lambda df, p: best_of_branch(df).select("query_id", "chunk_id", F.col("rank").alias(f"{p}_rank"), F.col("score").alias(f"{p}_score"))
    part = lambda p: F.coalesce(F.lit(1.0) / (config.rrf_k + F.col(f"{p}_rank")), F.lit(0.0))
    both = side(dense, "dense").join(side(sparse, "sparse"), ["query_id", "chunk_id"], "full")
    both = both.withColumns({"dense_part": part("dense"), "sparse_part": part("sparse")}).withColumn("score", F.col("dense_part") + F.col("sparse_part"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.least("dense_rank", "sparse_rank"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.top_k)


def expand(queries: DataFrame, rules: DataFrame, config: Hybrid = Hybrid()) -> DataFrame:
    """queries with expansions (array) and retrieval_query.

    rules: key, position, expansion. A rule applies if its key is in the query, both
    folded; expansions in the order of keys and positions, without repeats or the
    query itself, squeezed and cut, at most config.max_expansions.
    """
    folded = casefold(F.col("question"))
    cut = F.regexp_replace(F.substring(squeeze(F.col("expansion")), 1, config.max_expansion_chars), r"(?U)\s+$", "")
    r = rules.select(casefold(F.trim("key")).alias("key"), "position", cut.alias("expansion")).filter("key <> '' and expansion <> ''")
    hits = queries.select("query_id", folded.alias("folded")).join(r, F.contains(F.col("folded"), F.col("key")))
    hits = hits.withColumn("name", casefold(F.col("expansion"))).filter(F.col("name") != F.trim("folded"))
    first = hits.groupBy("query_id", "name").agg(F.min_by(F.struct("key", "position", "expansion"), F.struct("key", "position")).alias("e"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("e.key", "e.position"))).filter(F.col("_r") <= config.max_expansions)
    found = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_r", "e.expansion"))).alias("x"))
    out = queries.join(found, "query_id", "left").withColumn("expansions", F.coalesce(F.col("x.expansion"), F.array().cast("array<string>"))).drop("x")
    return out.withColumn("retrieval_query", F.concat_ws(" ", F.array(squeeze(F.col("question"))), "expansions"))


def needs_second_hop(question: Column) -> Column:
    return contains_any(casefold(question), RELATION_CUES)


def derived_queries(first_hop: DataFrame, queries: DataFrame, most: int = 2, mode: str = "rule") -> DataFrame:
    """query_id, hop (from 2), question: references named in first_hop's texts (query_id, rank, text), by rank and place, each once; mode off, rule (only questions with a relation cue) or always."""
    asked = queries.filter({"off": F.lit(False), "always": F.lit(True)}.get(mode, needs_second_hop(F.col("question")))).select("query_id")
    found = first_hop.join(asked, "query_id", "left_semi").select("query_id", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(REFERENCE), 0)).alias("pos", "ref"))
    found = found.withColumn("ref", squeeze(F.col("ref"))).groupBy("query_id", casefold(F.col("ref")).alias("name")).agg(F.min_by(F.struct("rank", "pos", "ref"), F.struct("rank", "pos")).alias("r"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("r.rank", "r.pos"))
    return found.withColumn("_n", order).filter(F.col("_n") <= most).select("query_id", (F.col("_n") + 1).alias("hop"), F.col("r.ref").alias("question"))


def multi_hop_trace(queries: DataFrame, derived: DataFrame) -> DataFrame:
    """query_id, triggered and hops (1 and those of derived queries): what several hops came to."""
    n = derived.groupBy("query_id").agg(F.sort_array(F.collect_set("hop")).alias("more"))
    rows = queries.select("query_id").join(n, "query_id", "left")
    return rows.select("query_id", F.col("more").isNotNull().alias("triggered"), F.concat(F.array(F.lit(1)), F.coalesce("more", F.array().cast("array<int>"))).alias("hops"))


def merge_hops(results: DataFrame, config: Hybrid = Hybrid()) -> DataFrame:
    """Candidates (query_id, hop, rank, chunk_id, score) of all hops in the order they are first seen, cut at config.max_merged, with hops."""
    seen = results.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("hop", "rank", "score"), F.struct("hop", "rank")).alias("f"), F.sort_array(F.collect_set("hop")).alias("hops"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("f.hop", "f.rank", "chunk_id"))
    return seen.withColumn("merged_rank", order).filter(F.col("merged_rank") <= config.max_merged).select("query_id", "chunk_id", "merged_rank", F.col("f.hop").alias("hop"), F.col("f.rank").alias("rank"), F.col("f.score").alias("score"), "hops")


def multi_hop(queries: DataFrame, search: Callable[[DataFrame], DataFrame], texts: DataFrame, most: int = 2, mode: str = "rule", config: Hybrid = Hybrid()) -> DataFrame:
    """merge_hops() of hop 1 (queries: query_id, question and any filters) and a hop for each query derived from its texts (chunk_id, text).

    search makes query_id, chunk_id, rank, score of queries; it is given the derived ones
    with the filters of the query they come from, and (query_id, hop) as their query_id.
    """
    columns = ["query_id", "hop", "rank", "chunk_id", "score"]
    first = staged(search(queries))
    derived = staged(derived_queries(beside(first, texts.select("chunk_id", "text"), "chunk_id"), queries, most, mode).join(queries.drop("question"), "query_id"))
    later = search(derived.withColumn("query_id", F.struct("query_id", "hop")).drop("hop"))
    later = later.withColumns({"hop": F.col("query_id.hop"), "query_id": F.col("query_id.query_id")})
    return merge_hops(first.withColumn("hop", F.lit(1)).select(columns).unionByName(later.select(columns)), config)


def rerank(candidates: DataFrame, top_n: int, weights: dict[str, float] | None = None) -> DataFrame:
    """candidates (query_id, chunk_id, rank, question, text) with rerank_score, pre_rank and new rank: weights of contained terms and 0.001 for each shared token.

    The provider's cut to top_n breaks ties by candidate order, the final order by rank before, then chunk_id.
    """
    text = casefold(F.col("text"))
    score = 0.001 * F.size(F.array_intersect(F.array_distinct(whitespace_tokens(casefold(F.col("question")))), whitespace_tokens(text)))
    for term, weight in (weights or {}).items():
        score = score + F.when(F.contains(text, F.lit(term.lower())), weight).otherwise(0.0)
    rows = candidates.withColumn("rerank_score", score.cast("double"))
    cut = rows.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank"))).filter(F.col("_i") <= top_n).drop("_i")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank", "chunk_id"))
    return cut.withColumn("_n", order).withColumnRenamed("rank", "pre_rank").withColumnRenamed("_n", "rank")
