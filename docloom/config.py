"""Settings of each stage: frozen, checked when made, named by a fingerprint of their values."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from docloom.errors import ConfigurationError


def fingerprint(values: dict, ascii_only: bool = True) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    text = json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


class Config:
    @property
    def fingerprint(self) -> str:
        return fingerprint(asdict(self))

    def require(self, ok: bool, what: str) -> None:
        if not ok:
            raise ConfigurationError(f"{type(self).__name__}: {what}")


#: Fixed values.
BOILERPLATE_MARKERS = ("confidential", "all rights reserved", "forward-looking", "not for distribution", "proprietary", "disclaimer", "generated by")
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "was", "were", "with")
DOMAINS = ("financial", "legal", "research")


@dataclass(frozen=True)
class Cleaning(Config):
    unicode_form: str = "NFKC"
    remove_control_characters: bool = True
    join_hyphenated_linebreaks: bool = True
    collapse_whitespace: bool = True
    suppress_repeated_headers_footers: bool = True
    canonicalize_page_numbers: bool = True
    repeated_pattern_min_pages: int = 2
    deduplicate_boilerplate: bool = True
    dedup_similarity_threshold: float = 0.92
    dedup_min_pages: int = 3
    dedup_min_chars: int = 24
    dedup_max_chars: int = 320
    boilerplate_markers: tuple[str, ...] = BOILERPLATE_MARKERS

    def __post_init__(self) -> None:
        self.require(self.unicode_form in ("NFC", "NFKC"), "unicode_form is NFC or NFKC")
        self.require(0 < self.dedup_similarity_threshold <= 1, "similarity is within (0, 1]")
        self.require(1 <= self.dedup_min_chars <= self.dedup_max_chars, "character bounds are in order")


@dataclass(frozen=True)
class Chunking(Config):
    strategy: str = "fixed_256"
    chunk_size: int = 256
    chunk_overlap: int = 32
    table_aware: bool = True
    section_aware: bool = True
    repeat_table_header: bool = True
    semantic_max_tokens: int = 512
    semantic_min_tokens: int = 64
    semantic_similarity_threshold: float = 0.78

    def __post_init__(self) -> None:
        self.require(self.chunk_size > 0 and 0 <= self.chunk_overlap < self.chunk_size, "overlap is below the size")
        self.require(0 < self.semantic_min_tokens <= self.semantic_max_tokens, "semantic bounds are in order")


CHUNKINGS = {f"fixed_{n}": Chunking(f"fixed_{n}", n, n // 8) for n in (256, 512, 1024)} | {"semantic": Chunking("semantic", 512, 0)}


@dataclass(frozen=True)
class Sparse(Config):
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0
    variant: str = "bm25"
    top_k: int = 20
    stopwords: tuple[str, ...] = STOPWORDS

    def __post_init__(self) -> None:
        self.require(self.k1 > 0 and 0 <= self.b <= 1 and self.delta >= 0, "k1, b and delta are in range")
        self.require(self.variant in ("bm25", "bm25_plus"), "variant is bm25 or bm25_plus")


@dataclass(frozen=True)
class Hybrid(Config):
    rrf_k: int = 60
    branch_top_k: int = 20
    top_k: int = 20
    max_expansions: int = 3
    max_expansion_chars: int = 160
    max_merged: int = 40

    def __post_init__(self) -> None:
        self.require(min(self.rrf_k, self.branch_top_k, self.top_k, self.max_merged) >= 1, "limits are positive")


@dataclass(frozen=True)
class Context(Config):
    max_context_tokens: int = 1200
    min_truncated_chunk_tokens: int = 8
    near_duplicate_jaccard_threshold: float = 0.9

    def __post_init__(self) -> None:
        self.require(self.max_context_tokens > 0 and 0 < self.near_duplicate_jaccard_threshold <= 1, "budget and threshold are in range")


@dataclass(frozen=True)
class Drift(Config):
    min_samples: int = 30
    relative_shift_threshold: float = 0.25
    max_samples: int = 10_000

    def __post_init__(self) -> None:
        self.require(self.min_samples >= 1 and self.relative_shift_threshold > 0, "bounds are positive")
