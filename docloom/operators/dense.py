"""Exact vector search and the vector table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from docloom.errors import IndexingError
from docloom.operators.best import MARGIN, Best, as_ids
from docloom.operators.corpus import require_none
from docloom.operators.sparse import top_k
from docloom.stage import staged

#: Queries are sent to the vectors in blocks of about so many; products are made for so many pairs at once.
MAX_QUERIES, MAX_PAIRS = 16_000, 2_000_000


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", same: str | None = None, where: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, key, score, rank: the k most similar vectors (key, vector) of each query (query_id, vector); same: a column in which both must agree; where: a condition on vectors' attributes and queries' filters (structs).

    A block of about MAX_QUERIES queries at a time is held against every vector where
    the vector lies, by products of matrices; each task keeps its own k best as batches
    pass by, so only these are shuffled, and memory doesn't grow with either side. What
    may be among the best is computed again term by term, so equal vectors have equal
    scores. Conditions are evaluated once a vector and distinct filter. A vector that is
    null, empty or has a null in it is like none (score 0); other sizes are an error.
    Queries are dealt to blocks by a hash of query_id, so rows of one query_id are in one block.
    """
    asked = staged(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *([F.col(same).alias("_same")] if same else []), *(["filters"] if where else [])))
    n = asked.count()
    blocks = 1 if n <= MAX_QUERIES else -(-n // (MAX_QUERIES * 9 // 10))  # blocks by hash vary in size
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [_block(vectors, asked.filter(block == b) if blocks > 1 else asked, k, key, same, where) for b in range(blocks)]
    return top_k(reduce(DataFrame.unionByName, parts), k, key)


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a column of arrays; those that are null, empty or have a null in them are zeros. All others are of one size (dim, if given)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    real = sizes[sizes > 0]
    dim = int(real[0]) if dim is None and len(real) else dim or 0
    if (real != dim).any() and dim:
        raise IndexingError("vectors of different dimensions")
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(dim, 1))
    if flat.null_count:
        values = np.where(flat.is_null().to_numpy(zero_copy_only=False).reshape(values.shape).any(1, keepdims=True), 0.0, values)
    if len(values) == len(column):
        return values
    out = np.zeros((len(column), max(dim, 1)))
    out[sizes > 0] = values
    return out


def in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added in order: equal rows give equal sums, wherever they lie."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _block(vectors: DataFrame, queries: DataFrame, k: int, key: str, same: str | None, where: Callable[[Column, Column], Column] | None) -> DataFrame:
    spark, kind = vectors.sparkSession, vectors.schema[key]
    got = queries.toArrow()
    n = got.num_rows
    names = spark.createDataFrame(pa.table({"_query": pa.array(range(n), pa.int32()), "query_id": got["query_id"]}), StructType([StructField("_query", IntegerType()), queries.schema["query_id"]]))
    asked = matrix(got["vector"])
    lengths = np.sqrt(in_turn(asked, asked))
    rows = vectors.select(F.col(key), "vector", *([F.col(same).alias("_same")] if same else []), *(["attributes"] if where else []))
    labels = got["_same"].combine_chunks() if same else None
    values = pc.drop_null(pc.unique(labels)) if same else None
    group = pc.fill_null(pc.index_in(labels, value_set=values, skip_nulls=True), -1).to_numpy(zero_copy_only=False) if same else None
    kept = None
    if where:
        rows, kept = flagged(rows, queries.schema["filters"], got["filters"].to_pylist(), where)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, dim, id_type = Best(n, k), asked.shape[1] if lengths.any() else None, None
        for batch in batches if n else ():
            ids, v = as_ids(batch.column(0)), matrix(batch.column(1), dim)
            id_type = batch.column(0).type
            if not len(ids):
                continue
            mine = np.zeros((n, v.shape[1])) if v.shape[1] != asked.shape[1] else asked
            nv = np.sqrt(in_turn(v, v))
            label = pc.fill_null(pc.index_in(batch.column(2).cast(values.type), value_set=values, skip_nulls=True), -2).to_numpy(zero_copy_only=False) if same else None
            flags = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool).reshape(len(ids), -1) if where else None
            few = max(1, min(n, MAX_PAIRS // len(ids)))
            step = max(1, MAX_PAIRS // few)
            with np.errstate(all="ignore"):
                vn = np.where(nv[:, None] > 0, v / nv[:, None], np.where(np.isnan(nv[:, None]), np.nan, 0.0))
                qn = np.where(lengths[:, None] > 0, mine / lengths[:, None], np.where(np.isnan(lengths[:, None]), np.nan, 0.0))
                for x in range(0, len(ids), step):
                    for y in range(0, n, few):
                        part = qn[y : y + few] @ vn[x : x + step].T
                        if np.isnan(part).any():
                            part[np.isnan(part)] = np.inf
                        if same:
                            part[group[y : y + few, None] != label[None, x : x + step]] = -np.inf
                        if where:
                            part[~flags[x : x + step, :].T[kept[y : y + few]]] = -np.inf
                        least = found.least[y : y + few].copy()
                        if part.shape[1] > k and np.isinf(least).any():  # nothing known yet: the k-th of this part is a bound
                            least = np.maximum(least, np.partition(part, -k, 1)[:, -k] - MARGIN)
                        q, c = np.nonzero((part >= least[:, None]) & (part > -np.inf))
                        for z in range(0, len(q), MAX_PAIRS // 4):
                            a, b = q[z : z + MAX_PAIRS // 4] + y, c[z : z + MAX_PAIRS // 4] + x
                            both = nv[b] * lengths[a]
                            score = np.where((both > 0) | np.isnan(both), in_turn(v[b], mine[a]) / both, 0.0)
                            found.offer(a, score, ids[b])
            found.settle()
        if id_type is not None:
            yield found.batch(("_query", key, "score"), id_type)

    out = rows.mapInArrow(best, StructType([StructField("_query", IntegerType()), kind, StructField("score", DoubleType())]))
    return out.join(F.broadcast(names), "_query").select("query_id", key, "score")


def flagged(rows: DataFrame, schema: StructField, filters: list, where: Callable[[Column, Column], Column]) -> tuple[DataFrame, np.ndarray]:
    """rows (with attributes) with, in place of attributes, flags: whether where holds for each distinct filter; and the place of each of filters among these."""
    named = [None if f is None else tuple(f.values()) for f in filters]
    place = {f: i for i, f in enumerate(dict.fromkeys(named))}
    known = rows.sparkSession.createDataFrame([([*place],)], StructType([StructField("_filters", ArrayType(schema.dataType))]))
    held = F.transform("_filters", lambda f: F.coalesce(where(F.col("attributes"), f), F.lit(False)))
    out = rows.crossJoin(F.broadcast(known)).select(*(c for c in rows.columns if c != "attributes"), held.alias("flags"))
    return out, np.array([place[f] for f in named], np.int64)


def require_dimension(vectors: DataFrame, dim: int) -> None:
    require_none(vectors.filter(F.size("vector") != dim).select(F.size("vector").alias("size")), f"vectors are not of dimension {dim}", IndexingError)


def vector_violations(vectors: DataFrame, dim: int, expected: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """key, rule: vectors of another dimension, with values that are no numbers, of keys that come twice, and (expected: key) of keys that are missing or not asked for."""
    rule = lambda rows, name: rows.select(key, F.lit(name).alias("rule"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
    out = rule(vectors.filter(F.size("vector") != dim), "dimension").unionByName(rule(vectors.filter(odd), "not_finite"))
    out = out.unionByName(rule(vectors.groupBy(key).count().filter("count > 1"), "duplicate"))
    if expected is not None:
        out = out.unionByName(rule(expected.join(vectors, key, "left_anti"), "missing")).unionByName(rule(vectors.join(expected, key, "left_anti"), "unknown"))
    return out.distinct()


def upsert(table: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """table with rows in place of those of equal key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def replace_documents(table: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """table without any row of documents (document_id), and rows."""
    return table.join(documents.select("document_id"), "document_id", "left_anti").unionByName(rows)


def consistency(left: DataFrame, right: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    missing = a.join(b, key, "full").filter("_a is null or _b is null")
    return missing.select(key, F.when(F.col("_b").isNull(), "left_only").otherwise("right_only").alias("side"))
