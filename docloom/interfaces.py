"""Where other implementations plug in: the shapes that operators expect."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class Tokenizer(Protocol):
    def __call__(self, text: Column) -> Column:
        """An array of tokens."""


class SimilarityPolicy(Protocol):
    def __call__(self, a: Column, b: Column) -> Column:
        """A similarity from 0 to 1 of two arrays of tokens."""


class EmbeddingProvider(Protocol):
    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key and vector (array of doubles) of each row's text."""


class OcrAdapter(Protocol):
    def __call__(self, image: bytes) -> str:
        """The text of a page's image; called in tasks."""


class Retriever(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """query_id, chunk_id, rank, score of queries (query_id, question and any filters)."""


class QueryExpander(Protocol):
    def __call__(self, queries: DataFrame) -> DataFrame:
        """queries with retrieval_query."""


class Reranker(Protocol):
    def __call__(self, candidates: DataFrame) -> DataFrame:
        """query_id and index of candidates in their new order; see retrieve.index_violations()."""


class HopPlanner(Protocol):
    def __call__(self, first_hop: DataFrame, queries: DataFrame) -> DataFrame:
        """query_id, hop (from 2) and question of derived queries."""


class Router(Protocol):
    def __call__(self, question: Column) -> Column:
        """Whether a question needs retrieval."""


class Generator(Protocol):
    def __call__(self, prompt: Column) -> Column:
        """A reply, JSON as answer.ANSWER says."""


class Judge(Protocol):
    def __call__(self, claim: Column, evidence: Column) -> Column:
        """A judgement, JSON as evaluate.JUDGEMENT says."""


class Observer(Protocol):
    def __call__(self, pending: DataFrame, attempt: int) -> DataFrame:
        """config_id, example_id, observation of the pending pairs that succeed."""


class Sink(Protocol):
    def __call__(self, rows: DataFrame) -> None:
        """Keeps rows of traces or trackers."""
