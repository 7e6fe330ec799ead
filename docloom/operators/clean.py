"""Cleaning of parsed elements: normalisation, repeated headers and footers, boilerplate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import Cleaning
from docloom.functions import ids
from docloom.functions.text import casefold, comparison_tokens, contains_any, is_page_number, normalize_text, pattern_signature

#: Columns of elements: document_id, ordinal, element_id, kind, text, page_number; boilerplate_candidate may be missing.


def prepared(elements: DataFrame, config: Cleaning = Cleaning(), exact: bool = True) -> DataFrame:
    if "boilerplate_candidate" not in elements.columns:
        elements = elements.withColumn("boilerplate_candidate", F.lit(None).cast("boolean"))
    clean = normalize_text(
        F.col("text"), F.col("kind"), form=config.unicode_form, controls=config.remove_control_characters,
        hyphens=config.join_hyphenated_linebreaks, collapse=config.collapse_whitespace, exact=exact,
    )
    return elements.withColumn("clean_text", clean)


def with_repeats(elements: DataFrame, config: Cleaning = Cleaning(), exact: bool = True) -> DataFrame:
    """prepared() elements with signature and reason: page_number, repeated_header or repeated_footer where a header or footer recurs, else null.

    It recurs if it is on enough different pages, or, if none of its kind and
    signature has a page, often enough. Pages are counted in two small aggregations
    joined back, not in windows over texts.
    """
    sig = F.when(F.col("kind").isin("header", "footer") & (F.col("clean_text") != ""), F.nullif(pattern_signature(F.col("clean_text"), config.canonicalize_page_numbers, exact), F.lit("")))
    rows = elements.withColumn("signature", sig)
    group = rows.filter("signature is not null").groupBy("document_id", "kind", "signature").agg(F.count_distinct("page_number").alias("pages"), F.count(F.lit(1)).alias("members"))
    least = config.repeated_pattern_min_pages
    again = group.filter((F.col("pages") >= least) | ((F.col("pages") == 0) & (F.col("members") >= least))).select("document_id", "kind", "signature", F.lit(True).alias("again"))
    reason = F.when(F.col("again"), F.when(is_page_number(F.col("clean_text"), exact), "page_number").otherwise(F.concat(F.lit("repeated_"), F.col("kind"))))
    return rows.join(again, ["document_id", "kind", "signature"], "left").withColumn("reason", reason if config.suppress_repeated_headers_footers else F.lit(None).cast("string")).drop("again")


def eligible(config: Cleaning = Cleaning(), exact: bool = True) -> Column:
    """Whether an element (prepared, with reason) may be boilerplate: text on a page, of fitting length, marked as a candidate or with a telling phrase."""
    text = F.col("clean_text")
    evidence = F.coalesce(F.col("boilerplate_candidate"), F.lit(False)) | contains_any(casefold(text, exact), config.boilerplate_markers)
    return F.col("kind").isin("text", "ocr_text") & F.col("page_number").isNotNull() & F.length(text).between(config.dedup_min_chars, config.dedup_max_chars) & evidence & F.col("reason").isNull()


CLUSTER = "document_id string, ordinal int, matched_ordinal int, similarity double"


def boilerplate(elements: DataFrame, config: Cleaning = Cleaning(), exact: bool = True) -> DataFrame:
    """CLUSTER rows for the elements to drop: near copies of an earlier boilerplate element of their document.

    Greedy in the order of elements, so it runs document by document, over the
    eligible elements only, with their token sets made by the JVM.
    """
    rows = elements.filter(eligible(config, exact)).select("document_id", "ordinal", "page_number", comparison_tokens(F.col("clean_text"), exact).alias("tokens"))

    def clusters(part: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, frozenset, list[tuple[int, float]], set]] = []
        for row in part.sort_values("ordinal").itertuples():
            mine, best = frozenset(row.tokens), None
            for c in found:
                both = len(mine | c[1])
                s = len(mine & c[1]) / both if both else 1.0
                if s >= config.dedup_similarity_threshold and (best is None or s > best[0]):
                    best = s, c
            if best:
                best[1][2].append((row.ordinal, best[0]))
                best[1][3].add(row.page_number)
            else:
                found.append((row.ordinal, mine, [], {row.page_number}))
        out = [(part["document_id"].iloc[0], i, c[0], s) for c in found if len(c[3]) >= config.dedup_min_pages for i, s in c[2]]
        return pd.DataFrame(out, columns=["document_id", "ordinal", "matched_ordinal", "similarity"])

    return rows.groupBy("document_id").applyInPandas(clusters, CLUSTER)


def clean(elements: DataFrame, config: Cleaning = Cleaning(), exact: bool = True) -> DataFrame:
    """All elements with clean_text, reason (null: it stays), matched_ordinal, similarity, and for those that stay clean_id and clean_ordinal."""
    rows = with_repeats(prepared(elements, config, exact), config, exact)
    if config.deduplicate_boilerplate:
        rows = rows.join(boilerplate(rows, config, exact), ["document_id", "ordinal"], "left")
    else:
        rows = rows.withColumns({"matched_ordinal": F.lit(None).cast("int"), "similarity": F.lit(None).cast("double")})
    copy = F.when(F.col("similarity") == 1.0, "duplicate_boilerplate").when(F.col("similarity").isNotNull(), "near_duplicate_boilerplate")
    empty = F.when((F.col("clean_text") == "") & ~F.col("kind").isin("table", "page_break"), "empty_after_normalization")
    rows = rows.withColumn("reason", F.coalesce("reason", copy, empty))
    order = F.row_number().over(Window.partitionBy("document_id", F.col("reason").isNull()).orderBy("ordinal")) - 1
    cid = ids.element_id(F.col("document_id"), F.col("ordinal"), F.col("kind"), F.col("clean_text"), F.col("page_number"), F.lit(config.fingerprint))
    return rows.withColumns({"clean_ordinal": F.when(F.col("reason").isNull(), order), "clean_id": F.when(F.col("reason").isNull(), cid)})


def stats(cleaned: DataFrame) -> DataFrame:
    """Counters by document."""
    reason = lambda *names: F.count_if(F.col("reason").isin(*names)).alias
    kept = F.col("reason").isNull()
    return cleaned.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("elements_in"), F.count_if(kept).alias("elements_out"),
        reason("duplicate_boilerplate")("duplicates_removed"), reason("near_duplicate_boilerplate")("near_duplicates_removed"),
        reason("repeated_header", "repeated_footer", "page_number")("header_footer_removed"), reason("page_number")("page_numbers_removed"), reason("empty_after_normalization")("empty_removed"),
        reason("duplicate_boilerplate", "near_duplicate_boilerplate", "repeated_header", "repeated_footer", "page_number")("boilerplate_removed"),
        F.count_if(kept & (F.col("kind") == "table")).alias("tables_preserved"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters_in"), F.coalesce(F.sum(F.when(kept, F.length("clean_text"))), F.lit(0)).alias("characters_out"),
    )
