"""Registered queries over the test tables, and the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import CHUNKINGS, STOPWORDS, Chunking, Cleaning, Context, Hybrid, Sparse
from docloom.functions import ids
from docloom.functions.text import TOKEN, comparison_tokens, jaccard, lexical_tokens, normalize_text, starts_legal_clause, whitespace_tokens
from docloom.functions.vectors import hash_embedding
from docloom.operators import chunk, clean, corpus, dense, evaluate, generate, hybrid, observe, retrieve, sparse
from docloom.plans.adapt import SQL as TABLES
from docloom.plans.adapt import corpus as corpus_table
from docloom.plans.adapt import domain, filtered_questions, questions, read
from docloom.sources import loaders
from docloom.stage import staged

PLUS = Sparse(variant="bm25_plus")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = corpus.duplicate_groups(corpus_table(spark, sf_dir))
    return g.select("checksum_sha256", F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("document_ids"), F.array_join("relative_paths", ",").alias("relative_paths"))


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.split_leakage(corpus_table(spark, sf_dir), "checksum_sha256")


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_table(spark, sf_dir).select("chunk_id", ids.document_id(F.col("checksum_sha256"), F.col("relative_path")).alias("document_id"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize_text(F.col("text"), exact=False)
    return read(spark, sf_dir, "documents").select("doc_id", F.length(out).alias("n_chars_clean"), F.sha2(out.cast("binary"), 256).alias("clean_sha256"))


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions.text import classify_text

    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select("doc_id", classify_text(F.col("line")).alias("kind"), starts_legal_clause(F.col("line")).alias("clause"))
    return rows.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("clause").alias("n_clauses"))


def sparse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select("doc_id", lexical_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " ").cast("binary"), 256).alias("tokens_sha256"))


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = sparse.build(corpus_table(spark, sf_dir))
    return index.df.crossJoin(F.broadcast(index.stats)).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark: SparkSession, sf_dir: str, config: Sparse = Sparse(), k: int = 10) -> DataFrame:
    return sparse.search(sparse.build(corpus_table(spark, sf_dir), config), questions(spark, sf_dir), k, config)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).withColumn("score", F.round("score", 6))


def bm25_plus_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, PLUS).withColumn("score", F.round("score", 6))


def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = corpus_table(spark, sf_dir), filtered_questions(spark, sf_dir)
    return retrieve.by_terms(sparse.build(c, attributes=retrieve.ATTRIBUTES), c, q, 10).withColumn("score", F.round("score", 6))


def bm25_matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = sparse.build(corpus_table(spark, sf_dir)), questions(spark, sf_dir)
    out = sparse.matched_terms(index, q, sparse.search(index, q, 5))
    return out.select("query_id", "chunk_id", "rank", F.array_join("matched_terms", " ").alias("terms"), F.array_join(F.col("term_frequencies").cast("array<string>"), " ").alias("frequencies"))


def _fixed(size: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = chunk.fixed_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", CHUNKINGS[f"fixed_{size}"])
        return c.select("doc_id", "ordinal", "start", "token_count", "overlap_tokens", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))

    return query


def chunk_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = None
    for config in (CHUNKINGS[f"fixed_{n}"] for n in (256, 512, 1024)):
        c = chunk.fixed_chunks(corpus_table(spark, sf_dir), "chunk_id", "text", config).select(F.lit(config.strategy).alias("strategy"), domain("chunk_id").alias("domain"), "token_count", "overlap_tokens")
        parts = c if parts is None else parts.unionByName(c)
    return chunk.ablation(parts)


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_embedding(read(spark, sf_dir, "documents"), "doc_id", "text").withColumn("value", F.round("value", 9))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    return v, v.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return dense.search(v, q, 10).withColumn("score", F.round("score", 6))


def dense_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return dense.search(v, q, 10, same="label").withColumn("score", F.round("score", 6))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = sparse.build(corpus_table(spark, sf_dir)), questions(spark, sf_dir)  # the variants differ in scores, not in postings
    fused = hybrid.rrf(*sparse.searches(index, q, [(20, Sparse()), (20, PLUS)]))
    return fused.select("query_id", "chunk_id", "dense_rank", "sparse_rank", F.round("score", 9).alias("score"), "rank")


RULES = [("the", 1, "definite article"), ("and", 1, "conjunction"), ("and", 2, "as well as"), ("of", 1, "Definite  Article"), ("that", 1, "which"), ("zzz", 1, "never")]


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "key string, position int, expansion string")
    out = hybrid.expand(questions(spark, sf_dir), rules)
    return out.select("query_id", F.array_join("expansions", "|").alias("expansions"), F.sha2(F.col("retrieval_query").cast("binary"), 256).alias("query_sha256"))


def _candidates(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    text = corpus_table(spark, sf_dir).select("chunk_id", "document_id", "text")
    return sparse.beside(_bm25(spark, sf_dir, k=k).join(questions(spark, sf_dir), "query_id"), text, "chunk_id")


def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hybrid.rerank(_candidates(spark, sf_dir), 5, {"the": 0.25})
    return out.select("query_id", "chunk_id", "pre_rank", "rank", F.round("rerank_score", 6).alias("rerank_score"))


def hop_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, q = sparse.build(corpus_table(spark, sf_dir)), questions(spark, sf_dir)  # the variants differ in scores, not in postings
    first, second = (found.withColumn("hop", F.lit(hop)) for hop, found in enumerate(sparse.searches(index, q, [(20, Sparse()), (30, PLUS)]), 1))
    out = hybrid.merge_hops(first.unionByName(second), Hybrid(max_merged=25))
    return out.select("query_id", "chunk_id", "merged_rank", "hop", "rank", F.array_join(F.col("hops").cast("array<string>"), ",").alias("hops"))


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set similarity of each turn to the next of its conversation."""
    c = read(spark, sf_dir, "conversations")
    rows = c.withColumn("next_text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("next_text is not null")
    return rows.select("conv_id", "turn", F.round(jaccard(comparison_tokens(F.col("text"), False), comparison_tokens(F.col("next_text"), False)), 6).alias("similarity"))


def _observed(spark: SparkSession, sf_dir: str, most: tuple[int, ...] = (20,)) -> list[DataFrame]:
    """benchmark items with retrieved and supporting chunks (those that contain the passage), for each number of chunks retrieved; searched once."""
    found, q = staged(_bm25(spark, sf_dir, k=max(most))), questions(spark, sf_dir)
    held = staged(evaluate.holding(corpus_table(spark, sf_dir), q).groupBy("query_id").agg(F.collect_set("chunk_id").alias("support")))
    none = F.array().cast("array<bigint>")
    out = []
    for k in most:
        got = found.filter(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("retrieved"))
        rows = q.join(got, "query_id", "left").join(held, "query_id", "left")
        out.append(rows.select("query_id", domain("query_id").alias("domain"), F.coalesce("retrieved", none).cast("array<string>").alias("retrieved"), F.coalesce("support", none).cast("array<string>").alias("support")))
    return out


def _retrievals(spark: SparkSession, sf_dir: str, most: tuple[int, ...]) -> list[DataFrame]:
    scores = (evaluate.context_precision(F.col("retrieved"), F.col("support")).alias("context_precision"), evaluate.context_recall(F.col("retrieved"), F.col("support")).alias("context_recall"))
    return [rows.select(F.col("query_id").alias("example_id"), "domain", *scores) for rows in _observed(spark, sf_dir, most)]


def _retrieval(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    return _retrievals(spark, sf_dir, (k,))[0]


def context_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _retrieval(spark, sf_dir)
    return r.withColumns({c: F.round(c, 6) for c in ("context_precision", "context_recall")})


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the turn after: example_id, question, answer."""
    c = read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return rows.filter("role = 'user' and next_role = 'assistant' and answer is not null and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"), F.col("text").alias("question"), "answer")


def answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _turn_pairs(spark, sf_dir).withColumn("score", evaluate.answer_relevancy(F.col("answer"), F.col("question"), F.lit("")))
    return p.select("example_id", F.round("score", 6).alias("score"), evaluate.relevancy_verdict(F.col("score")).alias("verdict"))


def faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _turn_pairs(spark, sf_dir)
    none = F.array().cast("array<string>")
    said = p.select("example_id", F.explode(evaluate.claims(F.col("answer"), none, F.lit(False))).alias("claim"))
    support = evaluate.claim_support(said, p.select("example_id", F.col("example_id").alias("chunk_id"), F.col("question").alias("text")))
    rows = p.join(support.groupBy("example_id").agg(F.avg("score").alias("faithfulness")), "example_id", "left")
    f = F.coalesce("faithfulness", F.lit(0.0))
    return rows.select("example_id", F.round(f, 6).alias("faithfulness"), (f < 0.8).alias("hallucinated"))


def _long(rows: DataFrame) -> DataFrame:
    m = ("context_precision", "context_recall")
    return rows.select("example_id", "domain", F.inline(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("score")) for x in m))))


def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metric_slices(_long(_retrieval(spark, sf_dir))).withColumn("mean_score", F.round("mean_score", 6))


def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _retrieval(spark, sf_dir)
    e = F.col("example_id")
    rows = r.withColumns({
        "faithfulness": F.when(e % 7 == 0, 0.5).otherwise(1.0), "answer_relevancy": F.lit(1.0), "hallucinated": e % 7 == 0, "tags": F.when(e % 4 == 0, F.array(F.lit("Vocabulary-Mismatch"))).otherwise(F.array().cast("array<string>")),
        "table_required": e % 5 == 0, "reranker_error": e % 11 == 0, "pipeline": F.lit("hybrid_rerank"), "cited": F.array(e.cast("string")), "context_ids": F.array((e - e % 13 % 2).cast("string")), "insufficient_context": F.lit(False),
    })
    return evaluate.failures(rows).select("example_id", F.array_join("categories", ",").alias("categories"))


THRESHOLDS = [("context_precision", None, 0.0, None, 1), ("context_precision", "legal", 0.05, 0.9, 1), ("context_recall", None, 0.1, None, 1), ("context_recall", "research", 0.0, None, 1000), ("missing", None, 0.0, None, 1)]


def regression_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame(THRESHOLDS, "metric string, domain string, max_drop double, min_score double, min_samples int")
    base, cand = (evaluate.metric_slices(_long(r)) for r in _retrievals(spark, sf_dir, (20, 5)))
    return evaluate.compare_slices(base, cand, t).withColumn("delta", F.round("delta", 6))


def domain_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = None
    for k, r in zip((5, 20), _retrievals(spark, sf_dir, (5, 20))):
        m = _long(r).withColumn("config_id", F.lit(f"top{k}"))
        parts = m if parts is None else parts.unionByName(m)
    return evaluate.domain_winners(parts).withColumn("composite", F.round("composite", 6))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("latency", F.abs("value"))
    out = observe.latency_summary(e, ["event_type"], "latency")
    return out.select("event_type", *(F.round(c, 6).alias(f"{c}_value") for c in ("min", "mean", "p50", "p95", "p99", "max")), F.col("count").alias("n"))


def value_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("current").alias("side"), "value")
    out = observe.drift(e)
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def request_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("latency", F.abs("value"))
    return observe.histogram(e, ["event_type"], "latency")


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observe.rate_windows(read(spark, sf_dir, "events"), ["event_type"])
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("per_second", 9).alias("per_second"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observe.rate_limited(read(spark, sf_dir, "events"), limit=2, every="1 day")
    return out.groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"))


def trace_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *(c.alias(n) for n, c in observe.redacted(F.col("text")).items()))


def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus_table(spark, sf_dir)
    return dense.consistency(c.filter("chunk_id % 7 <> 0"), c.filter("chunk_id % 11 <> 0"))


def provenance_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk.fixed_chunks(read(spark, sf_dir, "documents"), "doc_id", "text", CHUNKINGS["fixed_256"]).filter("token_count >= 64")
    return chunk.provenance_coverage(read(spark, sf_dir, "documents"), chunks, "doc_id").withColumn("coverage", F.round("coverage", 6))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return dense.upsert(v, v.filter("chunk_id % 10 = 0").withColumn("label", F.lit(-1)))


def evaluation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus_table(spark, sf_dir)
    records = c.select(F.col("chunk_id").alias("example_id"), "split", F.array(F.col("document_id"), F.col("document_id") + 1).alias("supporting_document_ids"))
    return corpus.evaluation_violations(records, c.select("document_id", "split"))


# -- beyond SQL: parsers, greedy operators, compositions


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), F.lit("html").alias("source_type"), F.col("html").cast("binary").alias("content"))
    return loaders.with_element_ids(loaders.parse(pages))


def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir)


def _line_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as elements, ten lines a page, a footer with the page's number at the end of each."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.split("text", "\n").alias("lines"))
    lines = docs.select("document_id", F.posexplode("lines").alias("i", "text")).select("document_id", (F.col("i") * 2).alias("ordinal"), F.lit("text").alias("kind"), "text", (F.floor(F.col("i") / 10) + 1).cast("int").alias("page_number"))
    pages = lines.groupBy("document_id", "page_number").agg(F.max("ordinal").alias("last"))
    foot = pages.select("document_id", (F.col("last") + 1).alias("ordinal"), F.lit("footer").alias("kind"), F.concat(F.lit("Page "), F.col("page_number").cast("string")).alias("text"), "page_number")
    return lines.unionByName(foot).withColumns({"element_id": F.concat_ws("-", "document_id", F.col("ordinal").cast("string")), "boilerplate_candidate": F.lit(None).cast("boolean"), "section_hint": F.lit(None).cast("string")})


def cleaned_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.stats(clean.clean(_line_elements(spark, sf_dir), Cleaning()))


def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _line_elements(spark, sf_dir).filter("kind = 'text'").withColumn("domain", F.lit("legal"))
    return chunk.with_ids(chunk.block_chunks(e, CHUNKINGS["fixed_256"]), ["block", "window"], CHUNKINGS["fixed_256"])


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as a table of tab-separated rows, cut by rows."""
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus"))).alias("r"))
    t = rows.select(F.col("o_custkey").cast("string").alias("document_id"), F.lit(0).alias("ordinal"), F.array_join(F.concat(F.array(F.lit("key\tpriority\tstatus")), "r"), "\n").alias("text"))
    return chunk.table_chunks(t, Chunking("table", 16, 0))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("ordinal"), "text")
    return chunk.semantic_chunks(units, CHUNKINGS["semantic"])


def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks a question and derived query by BM25, merged. The texts name no sections, so each is given one to refer to, and no question needs a cue."""
    texts = corpus_table(spark, sf_dir).withColumn("text", F.concat(F.lit("see Section "), F.col("chunk_id").cast("string"), F.lit(" ."), "text"))
    index = sparse.build(texts)
    return hybrid.multi_hop(questions(spark, sf_dir), lambda q: sparse.search(index, q, 5), texts, mode="always")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = hybrid.rerank(_candidates(spark, sf_dir), 20)
    return generate.assemble(r.withColumn("metadata", F.to_json(F.struct("document_id"))), Context())


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir)


def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = staged(hybrid.rerank(_candidates(spark, sf_dir), 5))
    q = questions(spark, sf_dir)
    a = generate.deterministic_answers(q, r.select("query_id", "chunk_id", "rank", "text"))
    allowed = r.groupBy("query_id").agg(F.collect_set(F.col("chunk_id").cast("string")).alias("allowed"))
    rows = a.join(allowed, "query_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    errors = generate.answer_errors(F.col("answer"), F.col("cited_chunk_ids"), F.col("allowed"), F.col("insufficient_context"))
    return rows.select("query_id", F.sha2(F.col("answer").cast("binary"), 256).alias("answer_sha256"), F.array_join("cited_chunk_ids", ",").alias("cited"), "insufficient_context", F.array_join(errors, ",").alias("errors"))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.row_fingerprint(corpus_table(spark, sf_dir), ["checksum_sha256", "relative_path", "split", "domain"])


QUERIES = {f.__name__: f for f in (
    exact_duplicates, split_leakage, document_ids, normalized_text, line_classes, sparse_tokens, bm25_stats, bm25_topk, bm25_plus_topk, bm25_filtered_topk, bm25_matched_terms, chunk_ablation, hash_embeddings, dense_topk, dense_filtered_topk,
    rrf_fusion, query_expansion, rerank, hop_merge, turn_similarity, context_metrics, answer_relevancy, faithfulness, metric_slices, failure_taxonomy, regression_compare, domain_winners, latency_percentiles, value_drift, request_histogram,
    event_rates, rate_limit, trace_redaction, index_consistency, provenance_coverage, vector_upsert, evaluation_violations, html_elements, cleaned_elements, block_chunks, table_chunks, semantic_chunks, multi_hop, context_assembly,
    grounded_answers, corpus_fingerprint,
)} | {f"fixed_chunks_{n}": _fixed(n) for n in (256, 512, 1024)}

# -- the same in SQL

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(text: str) -> str:
    found = f"list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda x: lower(CASE WHEN x LIKE '§%' THEN regexp_replace(x, '\\s+', '', 'g') ELSE x END))"
    return f"list_filter({found}, lambda x: x NOT IN ({_STOP}))"


_INDEX = f"""
toks AS (SELECT chunk_id, {_tokens("text")} AS t FROM corpus),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf, min(pos) AS pos FROM (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT query_id, {_tokens("question")} AS t FROM questions)) GROUP BY ALL)
"""


def _scores(name: str, plus: bool = False, where: str = "") -> str:
    tf = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))" + (" + 1.0" if plus else "")
    return f"""
{name}_s AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * ({tf}) * qtf) AS score
  FROM post JOIN qt USING (term) JOIN freq USING (term) CROSS JOIN stats GROUP BY query_id, chunk_id),
{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}_s {where})
"""


_BASE = f"WITH {TABLES}, {_INDEX}, {_scores('plain')}"
_BOTH = f"{_BASE}, {_scores('plus', True)}"
_WS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"


def _fixed_sql(size: int) -> str:
    return rf"""
WITH t AS (SELECT doc_id, {_WS.format("text")} AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= {size} THEN 1 ELSE 1 + ceil((len(w) - {size}) / {size - size // 8}.0)::INT END)) AS ordinal FROM t WHERE len(w) > 0),
s AS (SELECT doc_id, ordinal::INT AS ordinal, (ordinal * {size - size // 8})::INT AS start, w[ordinal * {size - size // 8} + 1 : ordinal * {size - size // 8} + {size}] AS c, len(w) AS n FROM k)
SELECT doc_id, ordinal, start, len(c)::INT AS token_count, CASE WHEN ordinal = 0 THEN 0 ELSE least({size // 8}, n - start) END::INT AS overlap_tokens, sha256(array_to_string(c, ' ')) AS text_sha256 FROM s
"""


def _strategy_sql(size: int) -> str:
    return f"SELECT 'fixed_{size}' AS strategy, ['financial', 'legal', 'research'][doc_id % 3 + 1] AS domain, token_count, overlap_tokens FROM ({_fixed_sql(size)})"


def _dense_sql(same: str = "") -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 {same}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INT AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10
"""


_JTOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_PAIRS = """
p AS (SELECT conv_id * 1000 + turn AS example_id, text AS question, answer FROM (
  SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant' AND answer IS NOT NULL AND text IS NOT NULL)
"""


def _metrics(k: int, name: str) -> str:
    return f"""
{name}_got AS (SELECT query_id, list(chunk_id) AS got FROM plain WHERE rank <= {k} GROUP BY query_id),
{name} AS (SELECT q.query_id AS example_id, ['financial', 'legal', 'research'][q.query_id % 3 + 1] AS domain,
  CASE WHEN len(coalesce(got, [])) = 0 THEN CASE WHEN len(coalesce(sup, [])) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(got, coalesce(sup, []))) / len(got) END AS context_precision,
  CASE WHEN len(coalesce(sup, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(got, []), sup)) / len(sup) END AS context_recall
  FROM questions q LEFT JOIN {name}_got USING (query_id) LEFT JOIN support USING (query_id)),
{name}_long AS (SELECT example_id, domain, 'context_precision' AS metric, context_precision AS score FROM {name} UNION ALL SELECT example_id, domain, 'context_recall', context_recall FROM {name}),
{name}_slices AS (SELECT metric, domain, count(*) AS count, avg(score) AS mean_score FROM {name}_long GROUP BY GROUPING SETS ((metric), (metric, domain)))
"""


_EVAL = f"{_BASE}, support AS (SELECT query_id, list(DISTINCT chunk_id) AS sup FROM corpus JOIN questions ON contains(text, question) GROUP BY query_id), {_metrics(20, 'm20')}, {_metrics(5, 'm5')}"
_CMP = r"list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}\p{{M}}_]+(?:[.''’/-][\p{{L}}\p{{N}}\p{{M}}_]+)*|[$€£¥₹]|%'))"
_DAYS = "['financial', 'legal', 'research']"

SQL = {
    "exact_duplicates": f"WITH {TABLES} SELECT checksum_sha256, string_agg(document_id::VARCHAR, ',' ORDER BY relative_path) AS document_ids, string_agg(relative_path, ',' ORDER BY relative_path) AS relative_paths FROM corpus GROUP BY 1 HAVING count(*) > 1",
    "split_leakage": f"WITH {TABLES} SELECT checksum_sha256, min(split) AS first_split, max(split) AS last_split, count(*) AS n FROM corpus GROUP BY 1 HAVING min(split) <> max(split)",
    "document_ids": f"WITH {TABLES} SELECT chunk_id, 'doc_' || substr(sha256(checksum_sha256 || chr(31) || relative_path), 1, 32) AS document_id FROM corpus",
    "normalized_text": r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{ad}\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '([\p{L}\p{N}\p{M}_])-[ \t]*\n[ \t]*([\p{L}\p{N}\p{M}_])', '\1\2', 'g'), '[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM a)
SELECT doc_id, length(t)::INT AS n_chars_clean, sha256(t) AS clean_sha256 FROM b
""",
    "line_classes": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, line, regexp_replace(line, '^[\s\x{a0}]+', '') AS t FROM l)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)^(figure|table)\s+\d+[\s:.-]') THEN 'caption' WHEN regexp_matches(t, '^(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][.)]\s+)') THEN 'list_item' ELSE 'text' END AS kind,
       count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '(?i)^\s*(?:section\s+)?\d+(?:\.\d+)+\b')) AS n_clauses
FROM s GROUP BY 1, 2
""",
    "sparse_tokens": f"SELECT doc_id, len(t)::INT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "bm25_stats": f"WITH {TABLES}, {_INDEX} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM freq CROSS JOIN stats",
    "bm25_topk": f"{_BASE} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM plain WHERE rank <= 10",
    "bm25_plus_topk": f"{_BOTH} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM plus WHERE rank <= 10",
    "bm25_filtered_topk": f"""WITH {TABLES}, {_INDEX}, {_scores("f", where=f'''
JOIN corpus c USING (chunk_id) WHERE (query_id % 2 <> 0 OR c.domain = {_DAYS}[query_id % 3 + 1]) AND source_date >= DATE '2024-02-01' AND (query_id % 3 <> 0 OR source_date <= DATE '2024-10-01')''')}
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM f WHERE rank <= 10""",
    "bm25_matched_terms": f"""{_BASE} SELECT r.query_id, r.chunk_id, r.rank::INT AS rank, string_agg(term, ' ' ORDER BY pos) AS terms, string_agg(tf::VARCHAR, ' ' ORDER BY pos) AS frequencies
FROM plain r JOIN qt USING (query_id) JOIN post USING (chunk_id, term) WHERE rank <= 5 GROUP BY 1, 2, 3""",
    "chunk_ablation": f"""WITH c AS ({" UNION ALL ".join(map(_strategy_sql, (256, 512, 1024)))})
SELECT strategy, domain, count(*) AS chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 6) AS mean_tokens,
       quantile_disc(token_count, 0.5) AS p50_tokens, quantile_disc(token_count, 0.95) AS p95_tokens, round(avg(overlap_tokens), 6) AS mean_overlap FROM c GROUP BY 1, 2""",
    "hash_embeddings": f"""WITH t AS (SELECT doc_id, unnest({_WS.format("replace(lower(text), 'ß', 'ss')")}) AS w FROM documents),
h AS (SELECT doc_id, sha256(w) AS h FROM t),
s AS (SELECT doc_id, ((('0x' || substr(h, 1, 4))::INT) % 64)::INT AS bucket, sum(CASE WHEN (('0x' || substr(h, 5, 2))::INT) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS n FROM s GROUP BY 1)
SELECT doc_id, bucket, round(s / n, 9) AS value FROM s JOIN n USING (doc_id) WHERE s <> 0""",
    "dense_topk": _dense_sql(),
    "dense_filtered_topk": _dense_sql("AND q.label = v.label"),
    "rrf_fusion": f"""{_BOTH}, d AS (SELECT * FROM plain WHERE rank <= 20), s AS (SELECT * FROM plus WHERE rank <= 20),
b AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score
  FROM d FULL JOIN s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, least(dense_rank, sparse_rank), chunk_id) AS rank FROM b)
SELECT query_id, chunk_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 20""",
    "query_expansion": rf"""WITH {TABLES}, rules(key, position, expansion) AS (VALUES {", ".join(f"('{k}', {p}, '{' '.join(e.split())}')" for k, p, e in RULES)}),
h AS (SELECT query_id, key, position, expansion, lower(expansion) AS name FROM questions JOIN rules ON contains(replace(lower(question), 'ß', 'ss'), key) WHERE lower(expansion) <> trim(lower(question))),
f AS (SELECT query_id, name, arg_min(expansion, (key, position)) AS expansion, min((key, position)) AS o FROM h GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS r FROM f),
x AS (SELECT query_id, string_agg(expansion, '|' ORDER BY r) AS e, string_agg(expansion, ' ' ORDER BY r) AS s FROM r WHERE r <= 3 GROUP BY 1)
SELECT query_id, coalesce(e, '') AS expansions, sha256(trim(regexp_replace(question, '\s+', ' ', 'g')) || coalesce(' ' || s, '')) AS query_sha256 FROM questions LEFT JOIN x USING (query_id)""",
    "rerank": f"""{_BASE}, c AS (SELECT query_id, chunk_id, rank, replace(lower(question), 'ß', 'ss') AS q, replace(lower(text), 'ß', 'ss') AS t FROM plain JOIN questions USING (query_id) JOIN corpus USING (chunk_id) WHERE rank <= 20),
s AS (SELECT query_id, chunk_id, rank, 0.001 * len(list_intersect(list_distinct({_WS.format("q")}), list_distinct({_WS.format("t")}))) + CASE WHEN contains(t, 'the') THEN 0.25 ELSE 0 END AS score FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS i FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank, chunk_id) AS final FROM i WHERE i <= 5)
SELECT query_id, chunk_id, rank::INT AS pre_rank, final::INT AS rank, round(score, 6)::DOUBLE AS rerank_score FROM r""",
    "hop_merge": f"""{_BOTH}, a AS (SELECT query_id, chunk_id, 1 AS hop, rank FROM plain WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 2, rank FROM plus WHERE rank <= 30),
f AS (SELECT query_id, chunk_id, min((hop, rank)) AS f, string_agg(DISTINCT hop::VARCHAR, ',' ORDER BY hop::VARCHAR) AS hops FROM a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f, chunk_id) AS merged_rank FROM f)
SELECT query_id, chunk_id, merged_rank::INT AS merged_rank, f[1]::INT AS hop, f[2]::INT AS rank, hops FROM r WHERE merged_rank <= 25""",
    "turn_similarity": f"""WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
t AS (SELECT conv_id, turn, {_CMP.format("text")} AS a, {_CMP.format("nxt")} AS b FROM n WHERE nxt IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS similarity FROM t""",
    "context_metrics": f"{_EVAL} SELECT example_id, domain, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall FROM m20",
    "answer_relevancy": f"""WITH {_PAIRS}, s AS (SELECT example_id, CASE WHEN len({_JTOK.format("answer")}) = 0 OR len({_JTOK.format("question")}) = 0 THEN 0.0 ELSE len(list_intersect({_JTOK.format("answer")}, {_JTOK.format("question")})) / len({_JTOK.format("question")}) END AS score FROM p)
SELECT example_id, round(score, 6) AS score, CASE WHEN score >= 0.6 THEN 'relevant' WHEN score >= 0.2 THEN 'partially_relevant' ELSE 'irrelevant' END AS verdict FROM s""",
    "faithfulness": rf"""WITH {_PAIRS}, c AS (SELECT DISTINCT example_id, question, trim(c) AS claim FROM (SELECT example_id, question, unnest(string_split(regexp_replace(trim(answer), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS c FROM p) WHERE trim(c) <> ''),
n AS (SELECT example_id, trim(regexp_replace(lower(claim), '\s+', ' ', 'g')) AS claim, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS q FROM c),
s AS (SELECT example_id, CASE WHEN contains(q, claim) THEN 1.0 WHEN len({_JTOK.format("claim")}) > 0 AND len(list_intersect({_JTOK.format("claim")}, {_JTOK.format("q")})) / len({_JTOK.format("claim")}) >= 0.5 THEN 0.5 ELSE 0.0 END AS score FROM n),
f AS (SELECT example_id, avg(score) AS f FROM s GROUP BY 1)
SELECT example_id, round(coalesce(f, 0.0), 6)::DOUBLE AS faithfulness, coalesce(f, 0.0) < 0.8 AS hallucinated FROM p LEFT JOIN f USING (example_id)""",
    "metric_slices": f"{_EVAL} SELECT metric, domain, count, round(mean_score, 6) AS mean_score FROM m20_slices",
    "failure_taxonomy": f"""{_EVAL}, c AS (SELECT example_id, context_precision AS p, list_filter([
  CASE WHEN example_id % 5 = 0 AND context_recall < 1 THEN 'table_fragmentation' END, CASE WHEN example_id % 4 = 0 AND context_recall < 1 THEN 'vocabulary_mismatch' END, CASE WHEN context_recall = 0 THEN 'retrieval_miss' END,
  CASE WHEN example_id % 11 = 0 THEN 'reranker_error' END, CASE WHEN example_id % 13 % 2 = 1 THEN 'citation_failure' END, CASE WHEN example_id % 7 = 0 THEN 'generation_unsupported_claim' END], lambda x: x IS NOT NULL) AS c,
  least(context_precision, context_recall, CASE WHEN example_id % 7 = 0 THEN 0.5 ELSE 1.0 END) AS worst FROM m20)
SELECT example_id, CASE WHEN len(c) = 0 THEN 'unknown' ELSE array_to_string(c, ',') END AS categories FROM c WHERE len(c) > 0 OR worst < 1""",
    "regression_compare": f"""{_EVAL}, t(metric, domain, max_drop, min_score, min_samples) AS (VALUES {", ".join(f"('{m}', {f"'{d}'" if d else 'NULL'}, {x}::DOUBLE, {'NULL' if s is None else s}::DOUBLE, {n})" for m, d, x, s, n in THRESHOLDS)}),
j AS (SELECT t.*, b.count AS bc, c.count AS cc, b.mean_score AS bs, c.mean_score AS cs FROM t LEFT JOIN m20_slices b ON t.metric = b.metric AND t.domain IS NOT DISTINCT FROM b.domain LEFT JOIN m5_slices c ON t.metric = c.metric AND t.domain IS NOT DISTINCT FROM c.domain),
s AS (SELECT *, CASE WHEN bc IS NULL OR cc IS NULL THEN 'missing_metric' WHEN bc <> cc OR bc < min_samples OR cc < min_samples THEN 'sample_size_mismatch' WHEN cs - bs < -max_drop OR coalesce(cs < min_score, false) THEN 'degradation' WHEN cs > bs THEN 'improvement' ELSE 'stable' END AS status FROM j)
SELECT metric, domain, status, CASE WHEN status NOT IN ('missing_metric', 'sample_size_mismatch') THEN round(cs - bs, 6) END AS delta, bc AS baseline_count, cc AS candidate_count, status NOT IN ('stable', 'improvement') AS blocking, false AS alert FROM s""",
    "domain_winners": f"""{_EVAL}, a AS (SELECT 'top20' AS config_id, * FROM m20_long UNION ALL SELECT 'top5', * FROM m5_long),
m AS (SELECT config_id, domain, metric, avg(score) AS m FROM a GROUP BY 1, 2, 3), c AS (SELECT config_id, domain, avg(m) AS composite FROM m GROUP BY 1, 2)
SELECT config_id, domain, round(composite, 6) AS composite, composite >= max(composite) OVER (PARTITION BY domain) - 1e-12 AS best FROM c""",
    "latency_percentiles": """SELECT event_type, round(min(v), 6) AS min_value, round(avg(v), 6) AS mean_value, round(quantile_disc(v, 0.5), 6) AS p50_value, round(quantile_disc(v, 0.95), 6) AS p95_value, round(quantile_disc(v, 0.99), 6) AS p99_value, round(max(v), 6) AS max_value, count(*) AS n
FROM (SELECT event_type, abs(value) AS v FROM events) GROUP BY 1""",
    "value_drift": """WITH a AS (SELECT count(value) FILTER (WHERE event_id % 2 = 0) AS baseline_count, avg(value) FILTER (WHERE event_id % 2 = 0) AS baseline_mean, min(value) FILTER (WHERE event_id % 2 = 0) AS baseline_min, max(value) FILTER (WHERE event_id % 2 = 0) AS baseline_max,
  count(value) FILTER (WHERE event_id % 2 = 1) AS current_count, avg(value) FILTER (WHERE event_id % 2 = 1) AS current_mean, min(value) FILTER (WHERE event_id % 2 = 1) AS current_min, max(value) FILTER (WHERE event_id % 2 = 1) AS current_max FROM events),
b AS (SELECT *, CASE WHEN baseline_count >= 30 AND current_count >= 30 THEN abs(current_mean - baseline_mean) / greatest(abs(baseline_mean), 1e-12) END AS relative_mean_shift FROM a)
SELECT baseline_count, round(baseline_mean, 6) AS baseline_mean, round(baseline_min, 6) AS baseline_min, round(baseline_max, 6) AS baseline_max, current_count, round(current_mean, 6) AS current_mean, round(current_min, 6) AS current_min, round(current_max, 6) AS current_max,
  round(relative_mean_shift, 6) AS relative_mean_shift, CASE WHEN relative_mean_shift IS NULL THEN 'insufficient_data' WHEN relative_mean_shift > 0.25 THEN 'potential_shift' ELSE 'stable' END AS status FROM b""",
    "request_histogram": f"""WITH b(le) AS (VALUES {", ".join(f"({float(b)}::DOUBLE)" for b in observe.BUCKETS)}, (NULL))
SELECT event_type, le, count(*) FILTER (WHERE le IS NULL OR abs(value) <= le) AS cumulative FROM events CROSS JOIN b GROUP BY 1, 2""",
    "event_rates": "SELECT (floor(epoch(ts))::BIGINT // 300 * 300) AS window_start, event_type, count(*) AS n, round(count(*) / 300.0, 9)::DOUBLE AS per_second FROM events GROUP BY 1, 2",
    "rate_limit": "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 86400 ORDER BY ts) <= 2 AS ok FROM events) SELECT user_id, count(*) FILTER (WHERE ok) AS n_allowed, count(*) FILTER (WHERE NOT ok) AS n_refused FROM r GROUP BY 1",
    "trace_redaction": "SELECT conv_id, turn, sha256(text) AS query_sha256, length(text)::INT AS query_length FROM conversations",
    "index_consistency": "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 11 = 0 THEN 'left_only' ELSE 'right_only' END AS side FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 11 = 0)",
    "provenance_coverage": f"WITH c AS (SELECT DISTINCT doc_id FROM ({_fixed_sql(256)}) WHERE token_count >= 64) SELECT count(*) AS expected, count(c.doc_id) AS covered, round(count(c.doc_id) / count(*), 6) AS coverage FROM documents LEFT JOIN c USING (doc_id)",
    "vector_upsert": "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings",
    "evaluation_violations": """WITH s AS (SELECT doc_id AS example_id, unnest([doc_id, doc_id + 1]) AS document_id FROM documents)
SELECT 'not_held_out' AS rule, doc_id::VARCHAR AS key FROM documents WHERE doc_id % 5 <> 0
UNION ALL SELECT 'unknown_document', example_id::VARCHAR FROM s WHERE document_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'wrong_split', example_id::VARCHAR FROM s JOIN documents d ON d.doc_id = s.document_id WHERE d.doc_id % 5 <> 0""",
} | {f"fixed_chunks_{n}": _fixed_sql(n) for n in (256, 512, 1024)}
