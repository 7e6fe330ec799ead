"""Context within a token budget, and grounded answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from docloom.config import Context
from docloom.functions.text import REFUSALS, casefold, contains_any, is_small_talk

SEPARATOR = "\n\n---\n\n"
CONTEXT = "query_id string, rendered string, included array<string>, omitted array<string>, duplicates array<string>, token_count int, truncated boolean"
_WORD = re.compile(r"[A-Za-z0-9]+")
#: Contexts are returned when they have so many characters together.
MAX_CHARS = 8_000_000


def render(chunk_id: str, rank: int, document_id: str, metadata: str, text: str, truncated: bool) -> str:
    """A block of context (fixed format)."""
    return f'[CONTEXT_CHUNK id="{chunk_id}" rank="{rank}" document_id="{document_id}" truncated="{str(truncated).lower()}"]\nSOURCE_METADATA: {metadata}\nCONTENT:\n{text}\n[/CONTEXT_CHUNK]'


def assemble(results: DataFrame, config: Context = Context()) -> DataFrame:
    """CONTEXT for each query of results (query_id, chunk_id, document_id, rank, pre_rank, text, metadata as JSON).

    In the order of ranks, near copies of a chunk before are dropped; chunks are taken
    while the rendered whole fits; the first that doesn't is cut to the most words that
    do, if enough, and the rest is omitted. Each step depends on those before, so a
    query's few candidates are handled together: they come sorted to one task, which
    walks over any number of queries. White space separates tokens and the blocks'
    joints, so counts of blocks add up and the cut is found by subtraction.
    """
    fields = ("query_id", "chunk_id", "document_id", "rank", "pre_rank", "text", "metadata")
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    schema = to_arrow_schema(_parse_datatype_string(CONTEXT))

    def one(query: str | None, found: list[tuple]) -> tuple:
        if len(found) > 1:
            found.sort(key=lambda r: [(r[i] is None, r[i]) for i in (2, 3, 0)])
            unique, sets, texts, copies = [], [], set(), []
            for r in found:
                norm = " ".join(r[4].casefold().split())
                words = set(_WORD.findall(norm))
                near = norm in texts or (words and any(len(words & s) >= config.near_duplicate_jaccard_threshold * len(words | s) for s in sets if s))
                if near:
                    copies.append(r[0])
                else:
                    unique.append(r)
                    sets.append(words)
                    texts.add(norm)
        else:
            unique, copies = found, []
        blocks, included, omitted, used, cut = [], [], [], 0, False
        for i, (chunk_id, document_id, rank, _, text, metadata) in enumerate(unique):
            make = lambda text, short: render(chunk_id, rank, document_id, metadata, text, short)  # noqa: B023, E731
            joint = 1 if blocks else 0
            words = text.split()
            # the text lies between line ends, so its words and those around it don't touch
            n = len(words) + len(make("", False).split())
            if used + joint + n <= config.max_context_tokens:
                blocks.append(make(text, False))
                included.append(chunk_id)
                used += joint + n
                continue
            room = config.max_context_tokens - used - joint - len(make("", True).split())
            take = min(room, len(words))
            if len(words) >= config.min_truncated_chunk_tokens and take >= config.min_truncated_chunk_tokens:
                block = make(" ".join(words[:take]), True)
                blocks.append(block)
                included.append(chunk_id)
                used += joint + len(block.split())
                cut = True
            else:
                omitted.append(chunk_id)
            omitted += [x[0] for x in unique[i + 1 :]]
            break
        return query, SEPARATOR.join(blocks), included, omitted, copies, used, cut

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, found, out, size = None, [], [], 0
        for batch in batches:
            for q, *r in zip(*(c.to_pylist() for c in batch.columns)):
                if found and q != query:
                    out.append(one(query, found))
                    found, size = [], size + len(out[-1][1])
                    if size > MAX_CHARS:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)
                        out, size = [], 0
                query = q
                found.append(tuple(r))
        if found:
            out.append(one(query, found))
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)

    rows = results.select(F.col("query_id").cast("string").alias("query_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), "rank", "pre_rank", "text", "metadata")
    return rows.select(*fields).repartition("query_id").sortWithinPartitions("query_id").mapInArrow(walk, CONTEXT)


def is_refusal(answer: Column) -> Column:
    return contains_any(casefold(answer), REFUSALS)


def answer_errors(answer: Column, cited: Column, allowed: Column, insufficient: Column, require_citations: bool = True) -> Column:
    """Array of the rules that an answer breaks."""
    rule = lambda name, broken: F.when(broken, F.lit(name))
    return F.array_compact(F.array(
        rule("unknown_citation", F.size(F.array_except(cited, allowed)) > 0),
        rule("refusal_with_citations", insufficient & (F.size(cited) > 0)),
        rule("refusal_without_phrase", insufficient & ~is_refusal(answer)),
        rule("no_citation", ~insufficient & F.lit(require_citations) & (F.size(cited) == 0)),
        rule("refusing_answer", ~insufficient & is_refusal(answer)),
    ))


def deterministic_answers(queries: DataFrame, ranked: DataFrame, refused: tuple[str, ...] = ()) -> DataFrame:
    """The rank-1 chunk's text as the answer, cited; a refusal where there is none or the question is in refused; small talk is not answered from context."""
    first = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).filter("_r = 1").select("query_id", F.col("chunk_id").alias("top"), F.trim("text").alias("top_text"))
    rows = queries.join(first, "query_id", "left")
    no = F.col("top").isNull() | (F.col("question").isin(*refused) if refused else F.lit(False))
    return rows.select(
        "query_id", "question", (~is_small_talk(F.col("question"))).alias("retrieval_required"),
        F.when(no, F.lit("Insufficient context: the retrieved evidence does not support an answer.")).otherwise(F.col("top_text")).alias("answer"),
        F.when(no, F.array().cast("array<string>")).otherwise(F.array(F.col("top").cast("string"))).alias("cited_chunk_ids"), no.alias("insufficient_context"),
    )
