"""Chunks of cleaned elements: fixed windows, tables by rows, semantic groups; and how chunkings compare."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docloom.config import DOMAINS, Chunking
from docloom.functions import ids
from docloom.functions.text import sentences, starts_legal_clause, whitespace_tokens
from docloom.functions.vectors import WordBuckets

#: Semantic chunking compares so many segments at once.
MAX_SEGMENTS = 4000


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Array of (window, start, tokens, overlap_tokens): size tokens each, the next one starting overlap before the end."""
    n, step = F.size(tokens), size - overlap
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    one = lambda i: F.struct(
        i.alias("window"), (i * step).alias("start"), F.slice(tokens, i * step + 1, F.lit(size)).alias("tokens"),
        F.when(i == 0, 0).otherwise(F.least(F.lit(overlap), n - i * step)).alias("overlap_tokens"),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array())


def fixed_chunks(docs: DataFrame, key: str, text: str, config: Chunking) -> DataFrame:
    """Whole texts cut into windows: key, ordinal, start, token_count, overlap_tokens, text. No shuffle."""
    found = docs.select(key, whitespace_tokens(F.col(text)).alias("t")).select(key, F.explode(windows(F.col("t"), config.chunk_size, config.chunk_overlap)).alias("w"))
    return found.select(key, F.col("w.window").alias("ordinal"), F.col("w.start").alias("start"), F.size("w.tokens").alias("token_count"), F.col("w.overlap_tokens").alias("overlap_tokens"), F.array_join("w.tokens", " ").alias("text"))


def blocks(elements: DataFrame, config: Chunking) -> DataFrame:
    """Chunkable elements (document_id, ordinal, kind, text, page_number, section_hint, domain) with block: consecutive elements that a chunk may span.

    A new block begins after and before a table (if tables are cut by rows), where the
    section changes, and at a numbered clause of a legal document.
    """
    rows = elements.filter((F.col("kind") != "page_break") & F.col("text").rlike(r"(?U)\S"))
    w = Window.partitionBy("document_id").orderBy("ordinal")
    table = (F.col("kind") == "table") if config.table_aware else F.lit(False)
    section = F.coalesce(F.lag("section_hint").over(w) != F.col("section_hint"), F.lit(False))
    clause = (F.col("domain") == "legal") & starts_legal_clause(F.col("text"))
    breaks = (section | clause) if config.section_aware else F.lit(False)
    first = F.lag("ordinal").over(w).isNull() | table | F.coalesce(F.lag(table).over(w), F.lit(False)) | breaks
    return rows.withColumn("_first", first.cast("int")).withColumn("block", F.sum("_first").over(w) - 1).drop("_first")


def block_chunks(elements: DataFrame, config: Chunking) -> DataFrame:
    """Fixed windows over blocks() of elements with provenance: document_id, block, window, text, token_count, overlap_tokens, element_ids, pages. Table blocks are left to table_chunks()."""
    rows = blocks(elements, config)
    if config.table_aware:
        rows = rows.filter("kind <> 'table'")
    refs = F.transform(whitespace_tokens(F.col("text")), lambda t: F.struct(t.alias("t"), F.col("element_id").alias("e"), F.col("page_number").alias("p")))
    merged = rows.groupBy("document_id", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", refs.alias("refs")))), lambda s: s["refs"])).alias("refs"))
    found = merged.select("document_id", "block", F.explode(windows(F.col("refs"), config.chunk_size, config.chunk_overlap)).alias("w"))
    part = F.col("w.tokens")
    return found.select(
        "document_id", "block", F.col("w.window").alias("window"), F.array_join(part["t"], " ").alias("text"), F.size(part).alias("token_count"), F.col("w.overlap_tokens").alias("overlap_tokens"),
        F.array_distinct(part["e"]).alias("element_ids"), F.array_sort(F.array_distinct(F.filter(part["p"], lambda p: p.isNotNull()))).alias("pages"),
    )


def table_chunks(tables: DataFrame, config: Chunking) -> DataFrame:
    """document_id, ordinal, group, text, token_count, row_start, row_end, repeated_header, oversized for table elements (rows by line ends).

    A table that fits, or of one row, is one chunk of its own text. Else rows after the
    header are filled greedily into groups that fit with the header, by an aggregate
    over the array of rows: no UDF.
    """
    rows = F.filter(F.transform(F.split("text", r"\r\n|\r|\n"), lambda r: F.regexp_replace(r, r"(?U)^\s+|\s+$", "")), lambda r: r != "")
    count = lambda c: F.size(whitespace_tokens(c))
    size, head = config.chunk_size, config.repeat_table_header
    t = tables.select("document_id", "ordinal", "text", rows.alias("rows"), count(F.col("text")).alias("n")).filter(F.size("rows") > 0)
    costs = F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), count)
    top = count(F.get("rows", F.lit(0))) if head else F.lit(0)
    # (group of each row so far, tokens of the open group); a group always takes one row
    start = F.struct(F.array().cast("array<int>").alias("g"), F.lit(-1).alias("last"), F.lit(0).alias("used"))
    step = lambda s, c: F.struct(
        F.concat(s["g"], F.array(F.when((s["last"] < 0) | (s["used"] + c > size), s["last"] + 1).otherwise(s["last"]))).alias("g"),
        F.when((s["last"] < 0) | (s["used"] + c > size), s["last"] + 1).otherwise(s["last"]).alias("last"),
        F.when((s["last"] < 0) | (s["used"] + c > size), F.col("top") + c).otherwise(s["used"] + c).alias("used"),
    )
    whole = (F.col("n") <= size) | (F.size("rows") == 1)
    one = t.filter(whole).select("document_id", "ordinal", F.lit(0).alias("group"), "text", F.col("n").alias("token_count"), F.lit(0).alias("row_start"), F.size("rows").alias("row_end"), F.lit(False).alias("repeated_header"), (F.col("n") > size).alias("oversized"))
    split = t.filter(~whole).withColumn("top", top).withColumn("g", F.aggregate(costs, start, step)["g"])
    split = split.select("*", F.explode(F.sequence(F.lit(0), F.array_max("g"))).alias("group"))
    at = F.filter(F.sequence(F.lit(1), F.size("g")), lambda i: F.get(F.col("g"), i - 1) == F.col("group"))
    split = split.withColumn("at", at)
    lines = F.transform("at", lambda i: F.get(F.col("rows"), i))
    text = F.array_join(F.concat(F.slice("rows", 1, 1), lines) if head else lines, "\n")
    split = split.withColumn("text", text)
    many = split.select(
        "document_id", "ordinal", "group", "text", count(F.col("text")).alias("token_count"), F.array_min("at").alias("row_start"), (F.array_max("at") + 1).alias("row_end"),
        (F.col("group") > 0) & F.lit(head), ((count(F.col("text")) > size) & (F.size("at") == 1)).alias("oversized"),
    ).toDF(*one.columns)
    return one.unionByName(many)


def local_embedding(text: str, dim: int = 64) -> np.ndarray:
    """functions.vectors.hash_embedding() for one text in Python."""
    v = np.zeros(dim)
    for t in text.casefold().split():
        d = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(d[:2], "big") % dim] += 1 if d[2] % 2 == 0 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def likeness(before: np.ndarray, v: np.ndarray) -> float:
    length = np.linalg.norm(before) * np.linalg.norm(v)
    return float(before @ v) / length if length else 0.0


def likenesses(segments: list[str], words: list[list[str]], dim: int, embed, buckets: WordBuckets, border: float) -> list[float]:
    """How like each segment is the one before it (the first: 0). Local embeddings are counted for many segments at once, each distinct word hashed once; likenesses next to border are computed again one by one, since the order of additions may matter there."""
    if embed is not local_embedding:
        vectors = [embed(s, dim) for s in segments]
        return [0.0, *(likeness(a, b) for a, b in zip(vectors, vectors[1:]))]
    out = [0.0]
    for i in range(0, len(segments) - 1, MAX_SEGMENTS):
        v = buckets.counts(words[i : i + MAX_SEGMENTS + 1])
        n = np.sqrt((v * v).sum(1))
        with np.errstate(all="ignore"):
            some = np.where(n[1:] * n[:-1] > 0, (v[1:] * v[:-1]).sum(1) / (n[1:] * n[:-1]), 0.0)
        for j in np.flatnonzero(np.abs(some - border) < 1e-9):
            some[j] = likeness(embed(segments[i + j], dim), embed(segments[i + j + 1], dim))
        out += some.tolist()
    return out


def semantic_chunks(units: DataFrame, config: Chunking, dim: int = 64, embed=local_embedding) -> DataFrame:
    """document_id, group, text, token_count, segment_count, oversized from units (document_id, ordinal, text).

    Sentences join the open group until its tokens would exceed the most, or, once it
    has the least, until a sentence is unlike the one before it. State runs along a
    document, so its units come in order to one task, which walks over any number of
    documents and compares the sentences of many at once; sentences are cut by the JVM.
    """
    rows = units.select("document_id", "ordinal", sentences(F.col("text")).alias("segments")).filter(F.size("segments") > 0)
    schema = "document_id string, group int, text string, token_count int, segment_count int, oversized boolean"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    most, least, border = config.semantic_max_tokens, config.semantic_min_tokens, config.semantic_similarity_threshold

    def cut(documents: list[tuple[str, list[str]]], buckets: WordBuckets) -> pa.RecordBatch:
        segments = [s for _, own in documents for s in own]
        words = [(s.casefold() if embed is local_embedding else s).split() for s in segments]
        alike = likenesses(segments, words, dim, embed, buckets, border)
        out: list[tuple] = []
        i = 0
        for name, own in documents:
            group, start, used = 0, i, 0
            for j in range(i, i + len(own)):
                n = len(words[j])
                if j > start and (used + n > most or (alike[j] < border and used >= least)):
                    out.append((name, group, " ".join(segments[start:j]), used, j - start, used > most and j - start == 1))
                    group, start, used = group + 1, j, 0
                used += n
            i += len(own)
            out.append((name, group, " ".join(segments[start:i]), used, i - start, used > most and i - start == 1))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, held, n = WordBuckets(dim), [], 0
        for batch in batches:
            for name, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held[-1][0] == name:
                    held[-1][1].extend(segments)
                else:
                    if n >= MAX_SEGMENTS:
                        yield cut(held, buckets)
                        held, n = [], 0
                    held.append((name, segments))
                n += len(segments)
        if held:
            yield cut(held, buckets)

    return rows.repartition("document_id").sortWithinPartitions("document_id", "ordinal").select("document_id", "segments").mapInArrow(walk, schema)


def with_ids(chunks: DataFrame, order: list[str], config: Chunking) -> DataFrame:
    """ordinal (from 0 along order) and chunk_id of chunks (document_id, text)."""
    out = chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)) - 1)
    return out.withColumn("chunk_id", ids.chunk_id(F.col("document_id"), F.col("ordinal"), F.lit(config.fingerprint), F.col("text")))


def token_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Count, least, most and mean of token_count, mean overlap."""
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.round(F.avg("token_count"), 6).alias("mean_tokens"),
        F.round(F.coalesce(F.avg("overlap_tokens"), F.lit(0.0)), 6).alias("mean_overlap"),
    )


def nearest_rank(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """by and a column for each fraction: the smallest value with at least that share of the rows at or below it."""
    # frequencies of each value first, so that few rows reach a group's window
    freq = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
    w = Window.partitionBy(*by).orderBy("_v")
    total = F.sum("_f").over(Window.partitionBy(*by))
    ranked = freq.withColumns({"_c": F.sum("_f").over(w), "_n": total})
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("_c") >= F.ceil(F.col("_n") * p), F.col("_v"))).alias(name) for name, p in fractions.items()))


def ablation(chunks: DataFrame) -> DataFrame:
    """token_stats() and percentiles by strategy and domain; every domain appears, empty ones with zeros."""
    by = ["strategy", "domain"]
    found = token_stats(chunks, by).join(nearest_rank(chunks, by, "token_count", {"p50_tokens": 0.5, "p95_tokens": 0.95}), by)
    domains = F.explode(F.array(*map(F.lit, DOMAINS))).alias("domain")
    return chunks.select("strategy").distinct().select("strategy", domains).join(found, by, "left").fillna(0)


def fragmentation(references: DataFrame) -> DataFrame:
    """One row: tables, fragmented and rate. references: element_id, chunk_id, row_group of the chunks that a table's element is in; a table is fragmented if it is in several and one of them is no group of its rows."""
    by = references.groupBy("element_id").agg(F.count_distinct("chunk_id").alias("n"), F.bool_and("row_group").alias("grouped"))
    sums = by.agg(F.count(F.lit(1)).alias("tables"), F.count_if((F.col("n") > 1) & ~F.col("grouped")).alias("fragmented"))
    return sums.withColumn("rate", F.when(F.col("tables") == 0, 0.0).otherwise(F.col("fragmented") / F.when(F.col("tables") > 0, F.col("tables"))))


def chunks(elements: DataFrame, config: Chunking) -> DataFrame:
    """Chunks of cleaned elements by the strategy that config names, with ordinal and chunk_id: document_id, text, token_count, overlap_tokens, kind (text, table or semantic).

    Fixed strategies cut blocks into windows and tables by rows; semantic ones join sentences of each block's elements.
    """
    columns = ["document_id", "_block", "_part", "text", "token_count", "overlap_tokens", "kind"]
    rows = blocks(elements, config)
    tables = rows.filter((F.col("kind") == "table") & F.lit(config.table_aware))
    cut = table_chunks(tables, config).join(tables.select("document_id", "ordinal", F.col("block").alias("_block")), ["document_id", "ordinal"])
    cut = cut.select("document_id", "_block", F.col("group").alias("_part"), "text", "token_count", F.lit(0).alias("overlap_tokens"), F.lit("table").alias("kind"))
    if config.strategy == "semantic":
        units = rows.filter((F.col("kind") != "table") | F.lit(not config.table_aware))
        named = units.select(F.to_json(F.array(F.col("document_id"), F.col("block").cast("string"))).alias("document_id"), "ordinal", "text")
        parts = F.from_json("document_id", "array<string>")
        whole = semantic_chunks(named, config).select(parts[0].alias("document_id"), parts[1].cast("long").alias("_block"), F.col("group").alias("_part"), "text", "token_count", F.lit(0).alias("overlap_tokens"), F.lit("semantic").alias("kind"))
    else:
        whole = block_chunks(elements, config).select("document_id", F.col("block").alias("_block"), F.col("window").alias("_part"), "text", "token_count", "overlap_tokens", F.lit("text").alias("kind"))
    return with_ids(whole.select(columns).unionByName(cut.select(columns)), ["_block", "_part"], config).drop("_block", "_part")


def provenance_coverage(expected: DataFrame, covered: DataFrame, key: str = "element_id") -> DataFrame:
    """One row: the share of expected keys that covered has; 1 if none is expected."""
    hit = covered.select(key).distinct().withColumn("_hit", F.lit(1))
    sums = expected.select(key).distinct().join(hit, key, "left").agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("covered"))
    return sums.withColumn("coverage", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("covered") / F.when(F.col("expected") > 0, F.col("expected"))))
