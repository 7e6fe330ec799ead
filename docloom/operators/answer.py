"""Answers from context: prompts, the strict form of an answer, validation with one repair, and the whole service as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import Context
from docloom.errors import GenerationError
from docloom.functions.text import is_small_talk
from docloom.operators import generate, hybrid
from docloom.operators.corpus import require_none
from docloom.operators.sparse import beside
from docloom.stage import staged

#: The form of a generated answer.
ANSWER = "answer string, citations array<struct<chunk_id:string,claim:string>>, insufficient_context boolean"
_FIELDS = ("answer", "citations", "insufficient_context")


def prompt(question: Column, context: Column) -> Column:
    """What a generator is asked, given the rendered context."""
    rules = "Answer from the context alone. Cite the chunks used. If the context does not hold the answer, say that there is insufficient context and cite nothing. Reply as JSON with answer, citations (chunk_id, claim) and insufficient_context."
    return F.concat(F.lit(f"{rules}\n\nCONTEXT:\n"), context, F.lit("\n\nQUESTION:\n"), question)


def repair_prompt(asked: Column, reply: Column, errors: Column) -> Column:
    return F.concat(asked, F.lit("\n\nThe reply below breaks these rules: "), F.array_join(errors, ", "), F.lit(". Correct it.\n"), reply)


def parsed(reply: Column) -> dict[str, Column]:
    """The fields of a reply and form_error: null, malformed (no JSON object), unknown_field, missing_field or blank_answer."""
    r, keys = F.from_json(reply, ANSWER), F.json_object_keys(reply)
    known = F.array(*map(F.lit, _FIELDS))
    lacks = F.size(F.array_except(known, keys)) > 0
    null = r["answer"].isNull() | r["citations"].isNull() | r["insufficient_context"].isNull() | F.exists(r["citations"], lambda c: c["chunk_id"].isNull() | c["claim"].isNull())
    error = F.when(keys.isNull(), "malformed").when(F.size(F.array_except(keys, known)) > 0, "unknown_field").when(lacks | null, "missing_field").when(~r["answer"].rlike(r"(?U)\S"), "blank_answer")
    return {"answer": r["answer"], "citations": r["citations"], "insufficient_context": r["insufficient_context"], "form_error": error}


def checked(replies: DataFrame) -> DataFrame:
    """replies (query_id, reply, allowed: chunk_ids of the context) with the parsed fields, cited_chunk_ids and errors (empty: valid)."""
    rows = replies.withColumns(parsed(F.col("reply")))
    cited = F.array_distinct(F.transform("citations", lambda c: c["chunk_id"]))
    rows = rows.withColumn("cited_chunk_ids", F.coalesce(cited, F.array().cast("array<string>")))
    broken = generate.answer_errors(F.col("answer"), F.col("cited_chunk_ids"), F.col("allowed"), F.col("insufficient_context"))
    return rows.withColumn("errors", F.when(F.col("form_error").isNotNull(), F.array("form_error")).otherwise(broken)).drop("form_error")


def generated(asked: DataFrame, generator: Callable[[Column], Column], strict: bool = True) -> DataFrame:
    """checked() replies of generator (a Column of prompts to a Column of replies) to asked (query_id, prompt, allowed), with repaired.

    A reply that breaks a rule is asked for once more, told what was wrong; one that
    still does is an error (strict) or stays with its errors. Replies are written to
    the shared folder, so a generator is asked once for each.
    """
    said = lambda rows: checked(staged(rows.withColumn("reply", generator(F.col("prompt")))))
    first = staged(said(asked).withColumn("repaired", F.size("errors") > 0))
    good = first.filter(~F.col("repaired"))
    again = first.filter("repaired").select("query_id", "allowed", repair_prompt(F.col("prompt"), F.col("reply"), F.col("errors")).alias("prompt"))
    second = said(again).withColumn("repaired", F.lit(True))
    if strict:
        require_none(second.filter(F.size("errors") > 0).select("query_id", "errors"), "an answer that breaks the rules after its repair", GenerationError)
    return good.unionByName(second)


@dataclass(frozen=True)
class AnswerService:
    """Questions to answers in one plan: routed, searched, reranked, given context, generated, validated.

    search: queries to (query_id, chunk_id, rank, score and others); chunks: chunk_id,
    document_id, text, metadata (JSON); generator: prompts to replies, or None for the
    deterministic one, which answers with the first chunk of the context.
    """

    search: Callable[[DataFrame], DataFrame]
    chunks: DataFrame
    top_n: int = 5
    weights: dict[str, float] | None = None
    context: Context = Context()
    generator: Callable[[Column], Column] | None = None
    skip_small_talk: bool = True

    def retrieved(self, queries: DataFrame) -> DataFrame:
        asked = queries.filter(~is_small_talk(F.col("question"))) if self.skip_small_talk else queries
        found = self.search(asked).select("query_id", "chunk_id", "rank", "score").join(asked.select("query_id", "question"), "query_id")
        return hybrid.rerank(beside(found, self.chunks, "chunk_id"), self.top_n, self.weights)

    def answers(self, queries: DataFrame) -> DataFrame:
        """query_id, question, retrieval_required, answer, cited_chunk_ids, insufficient_context, included (chunk_ids of the context), token_count and errors of each query."""
        ranked = staged(self.retrieved(queries))
        context = generate.assemble(ranked, self.context).select(F.col("query_id").alias("_q"), "rendered", "included", "token_count")
        rows = queries.withColumn("_q", F.col("query_id").cast("string")).join(context, "_q", "left").drop("_q")
        none = F.array().cast("array<string>")
        rows = rows.withColumns({"allowed": F.coalesce("included", none), "retrieval_required": ~is_small_talk(F.col("question")) | F.lit(not self.skip_small_talk)})
        keep = ["query_id", "question", "retrieval_required", "allowed", F.coalesce("token_count", F.lit(0)).alias("token_count")]
        if self.generator is None:
            first = ranked.select("query_id", F.col("chunk_id").cast("string").alias("_c"), "rank", F.trim("text").alias("_t"))
            first = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "_c"))).filter("_n = 1").select("query_id", "_c", "_t")
            rows = rows.join(first, "query_id", "left")
            no = F.size("allowed") == 0
            rows = rows.select(*keep, F.when(no, F.lit(REFUSAL)).otherwise(F.col("_t")).alias("answer"), F.when(no, none).otherwise(F.array("_c")).alias("cited_chunk_ids"), no.alias("insufficient_context"))
            return rows.withColumn("errors", generate.answer_errors(F.col("answer"), F.col("cited_chunk_ids"), F.col("allowed"), F.col("insufficient_context")))
        asked = rows.select("query_id", prompt(F.col("question"), F.coalesce("rendered", F.lit(""))).alias("prompt"), "allowed")
        said = generated(asked, self.generator).select("query_id", "answer", "cited_chunk_ids", "insufficient_context", "errors")
        return rows.select(*keep).join(said, "query_id")


REFUSAL = "Insufficient context: the retrieved evidence does not support an answer."
