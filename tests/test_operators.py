import math

import pytest
from pyspark.sql import functions as F

from docloom.config import Drift, Hybrid, Sparse
from docloom.errors import EvaluationError, IndexingError
from docloom.operators import corpus, dense, evaluate, hybrid, observe, retrieve, sparse
from docloom.plans import queries as plans
from docloom.streaming import metrics


def branch(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, score double")


def test_rrf(spark):
    d = branch(spark, [(1, "alpha", 1, 9.0), (1, "bravo", 3, 7.0), (1, "alpha", 5, 1.0)])
    s = branch(spark, [(1, "alpha", 2, 3.0), (1, "charlie", 1, 4.0)])
    got = hybrid.rrf(d, s).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["alpha", "charlie", "bravo"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62)
    assert [r.chunk_id for r in hybrid.rrf(s, s, Hybrid(top_k=1)).collect()] == ["charlie"]


def test_filters_leave_statistics_alone(spark):
    chunks = spark.createDataFrame([(1, "term alpha", "legal"), (2, "term beta", "financial"), (3, "gamma delta", "legal")], "chunk_id long, text string, domain string")
    q = spark.createDataFrame([(1, "term"), (2, "the"), (3, "")], "query_id int, question string")
    index = sparse.build(chunks)
    full = {r.chunk_id: r.score for r in sparse.scores(index, q).collect()}
    only = {r.chunk_id: r.score for r in sparse.scores(index, q, allowed=chunks.filter("domain = 'legal'").select("chunk_id")).collect()}
    assert only == {1: full[1]} and set(full) == {1, 2}
    assert full[1] == pytest.approx(math.log1p((3 - 2 + 0.5) / 2.5))
    plus = {r.chunk_id: r.score for r in sparse.scores(index, q, Sparse(variant="bm25_plus")).collect()}
    assert plus[1] == pytest.approx(2 * full[1])
    assert sparse.integrity(index).count() == 0


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a1 b1"), (2, "b1")], "chunk_id long, text string")
    sparse.build(chunks).write(str(tmp_path))
    again = sparse.SparseIndex.read(spark, str(tmp_path))
    assert sorted(map(tuple, again.df.collect())) == [("a1", 1), ("b1", 2)]


def test_bm25_by_term_beyond_the_bound(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 7) for _ in range(1 + (k + j) % 3)) or None) for k in range(60)] + [(3, "w1 w1")]
    index = sparse.build(spark.createDataFrame(rows, "chunk_id long, text string"))
    q = spark.createDataFrame([(1, "w0 w1 w1"), (2, "w5 w6 zz"), (3, ""), (4, None)], "query_id int, question string")
    found = lambda: {(r.query_id, r.chunk_id): round(r.score, 9) for r in sparse.scores(index, q).collect()}
    near = found()
    monkeypatch.setattr(sparse, "MAX_TERMS", 0)
    assert near and found() == near


def test_empty_index(spark):
    index = sparse.build(spark.createDataFrame([], "chunk_id long, text string"))
    assert index.stats.first() == (0, 0.0)
    assert sparse.scores(index, spark.createDataFrame([(1, "x")], "query_id int, question string")).count() == 0


def test_dense_search_makes_blocks(spark, monkeypatch):
    v = spark.range(1, 41).selectExpr("id AS chunk_id", "array(cos(id), sin(id)) AS vector", "id % 3 AS label")
    q = v.withColumnRenamed("chunk_id", "query_id")
    for same in (None, "label"):
        whole = sorted(map(tuple, dense.search(v, q, 3, same=same).collect()))
        with monkeypatch.context() as m:
            m.setattr(dense, "MAX_QUERIES", 15)
            assert sorted(map(tuple, dense.search(v, q, 3, same=same).collect())) == whole and len({r[0] for r in whole}) == 40


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id int, vector array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query_id int, vector array<double>")
    assert [r.chunk_id for r in dense.search(v, q, 3).orderBy("rank").collect()] == [1, 2, 3]
    with pytest.raises(IndexingError):
        dense.require_dimension(v, 3)
    docs = v.withColumn("document_id", F.col("chunk_id") % 2)
    new = docs.filter("chunk_id = 1").withColumn("chunk_id", F.lit(9))
    assert sorted(r.chunk_id for r in dense.replace_documents(docs, new, new.select("document_id")).collect()) == [2, 4, 9]
    assert {tuple(r) for r in dense.consistency(v.filter("chunk_id < 3"), v.filter("chunk_id > 1")).collect()} == {(1, "left_only"), (3, "right_only"), (4, "right_only")}


def test_hops(spark):
    q = spark.createDataFrame([(1, "How does Section 2 affect it?"), (2, "What is it?")], "query_id int, question string")
    first = spark.createDataFrame([(1, 1, "see  Section  7.4 and clause B"), (1, 2, "section 7.4; Appendix C-1"), (2, 1, "Schedule 1")], "query_id int, rank int, text string")
    assert [(r.hop, r.question) for r in hybrid.derived_queries(first, q).orderBy("hop").collect()] == [(2, "Section 7.4"), (3, "clause B")]
    assert {r.query_id for r in hybrid.derived_queries(first, q, mode="always").collect()} == {1, 2}
    assert hybrid.derived_queries(first, q, mode="off").count() == 0


def test_multi_hop_searches_derived_queries_with_the_filters(spark):
    rows = [("a", "x", "relief see section 7.4 and clause B"), ("b", "x", "section 7.4 text"), ("c", "y", "section 7.4 text"), ("d", "x", "clause b text")]
    chunks = spark.createDataFrame(rows, "chunk_id string, domain string, text string").withColumns({"document_id": F.lit(1), "source_date": F.lit(None).cast("date")})
    q = spark.createDataFrame([(1, "how relief", "x"), (2, "how relief", None), (3, "relief", "x")], "query_id int, question string, domain string")
    q = q.withColumns({"document_id": F.lit(None).cast("int"), "date_from": F.lit(None).cast("date"), "date_to": F.lit(None).cast("date")})
    index = sparse.build(chunks)
    search = lambda q: sparse.top_k(retrieve.filtered_hits(sparse.scores(index, q), chunks, q), 5)
    got = {}
    for r in hybrid.multi_hop(q, search, chunks).orderBy("query_id", "merged_rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.hop))
    assert got[1][0] == got[2][0] == ("a", 1) and got[3] == [("a", 1)]  # no cue, no second hop
    assert sorted(got[1][1:]) == [("b", 2), ("d", 3)] and sorted(got[2][1:]) == [("b", 2), ("c", 2), ("d", 3)]


def test_multi_hop_query_has_later_hops(spark, sf_dir):
    assert plans.multi_hop(spark, sf_dir).filter("hop > 1").count() > 0


def test_rerank(spark):
    c = spark.createDataFrame([(1, "a", 1, "red fox", "blue"), (1, "b", 2, "red fox", "a red fox"), (1, "c", 3, "red fox", "Key red")], "query_id int, chunk_id string, rank int, question string, text string")
    got = hybrid.rerank(c, 2, {"key": 1.0}).orderBy("rank").collect()
    assert [(r.chunk_id, r.pre_rank, round(r.rerank_score, 4)) for r in got] == [("c", 3, 1.001), ("b", 2, 0.002)]


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a"]), ([], []), ([], ["a"]), (["b"], [])], "r array<string>, s array<string>")
    got = df.select(evaluate.context_precision(F.col("r"), F.col("s")), evaluate.context_recall(F.col("r"), F.col("s"))).collect()
    assert [tuple(x) for x in got] == [(0.5, 1.0), (1.0, 1.0), (0.0, 0.0), (0.0, 1.0)]


def records(spark):
    r = spark.createDataFrame([("e1", "what grew", "revenue grew", "financial", ["c1"]), ("e2", "who", "nobody", "legal", ["c2"])], "example_id string, question string, reference_answer string, domain string, supporting_chunk_ids array<string>")
    o = spark.createDataFrame([("e1", ["c1", "c3"], "Revenue grew.", ["Revenue grew", " "], False), ("e2", ["c2"], "Insufficient context", [], True)], "example_id string, retrieved_chunk_ids array<string>, answer string, citation_claims array<string>, insufficient_context boolean")
    c = spark.createDataFrame([("e1", "c1", "In 2023  revenue GREW by 3%"), ("e1", "c3", "other"), ("e2", "c2", "x")], "example_id string, chunk_id string, text string")
    return r, o, c


def test_evaluate(spark):
    r, o, c = records(spark)
    got = {x.example_id: x for x in evaluate.evaluate(r, o, c).collect()}
    assert (got["e1"].context_precision, got["e1"].faithfulness, got["e1"].hallucinated) == (0.5, 1.0, False)
    assert got["e1"].answer_relevancy == pytest.approx(2 / 3) and got["e2"].faithfulness == 1.0
    slices = evaluate.metric_slices(evaluate.long_metrics(evaluate.evaluate(r, o, c)))
    assert slices.count() == 15 and {x.metric for x in evaluate.gate(slices, least=1).collect()} == {"context_precision", "answer_relevancy"}
    with pytest.raises(EvaluationError):
        evaluate.evaluate(r, o.filter("example_id = 'e1'"), c)


def test_claim_support_takes_the_smallest_best_chunk(spark):
    said = spark.createDataFrame([("e", "red fox runs"), ("e", "none at all")], "example_id string, claim string")
    ctx = spark.createDataFrame([("e", "b", "the red fox"), ("e", "a", "a red fox"), ("e", "c", "x")], "example_id string, chunk_id string, text string")
    got = {r.claim: (r.score, r.evidence) for r in evaluate.claim_support(said, ctx).collect()}
    assert got == {"red fox runs": (0.5, "a"), "none at all": (0.0, None)}


def test_regression(spark):
    cols = "metric string, domain string, count long, mean_score double"
    b = spark.createDataFrame([("m", None, 3, 0.9), ("m", "legal", 3, 0.8), ("n", None, 3, 0.5)], cols)
    c = spark.createDataFrame([("m", None, 3, 0.7), ("m", "legal", 3, 0.9), ("n", None, 4, 0.5)], cols)
    t = spark.createDataFrame([("m", None, 0.1, None, 1), ("m", "legal", 0.0, None, 1), ("n", None, 0.0, None, 1), ("z", None, 0.0, None, 1)], "metric string, domain string, max_drop double, min_score double, min_samples int")
    got = {(r.metric, r.domain): (r.status, r.blocking) for r in evaluate.compare_slices(b, c, t).collect()}
    assert got == {("m", None): ("degradation", True), ("m", "legal"): ("improvement", False), ("n", None): ("sample_size_mismatch", True), ("z", None): ("missing_metric", True)}


def test_pending(spark):
    configs = spark.createDataFrame([("k", "f")], "config_id string, config_fingerprint string")
    examples = spark.createDataFrame([("e1", "d"), ("e2", "d")], "example_id string, dataset_fingerprint string")
    done = "config_id string, example_id string, dataset_fingerprint string, config_fingerprint string"
    assert [r.example_id for r in evaluate.pending(configs, examples, spark.createDataFrame([("k", "e1", "d", "f")], done)).collect()] == ["e2"]
    with pytest.raises(EvaluationError):
        evaluate.pending(configs, examples, spark.createDataFrame([("k", "e1", "other", "f")], done))


def test_drift(spark):
    rows = [("baseline", 10.0)] * 30 + [("current", 13.0)] * 30
    df = spark.createDataFrame(rows, "side string, value double")
    assert observe.drift(df).first().status == "potential_shift"
    assert observe.drift(df, Drift(relative_shift_threshold=0.3)).first().status == "stable"
    assert observe.drift(df.limit(40)).first().status == "insufficient_data"


def test_latencies(spark):
    df = spark.createDataFrame([("r", float(x)) for x in (4, 1, 2, 3, 10)], "route string, ms double")
    r = observe.latency_summary(df, ["route"], "ms").first()
    assert (r["count"], r["min"], r["mean"], r.p50, r.p95, r.p99, r["max"]) == (5, 1, 4, 3, 10, 10, 10)
    hist = observe.histogram(df, ["route"], "ms", (1.0, 5.0))
    assert [(x.le, x.cumulative) for x in hist.orderBy(F.col("le").asc_nulls_last()).collect()] == [(1.0, 1), (5.0, 4), (None, 5)]
    assert observe.bucket_quantile(hist, ["route"], 0.5).first().quantile == pytest.approx(1 + 4 * (2.5 - 1) / 3)


def test_redaction(spark):
    df = spark.createDataFrame([('api_key="abc" rest',)], "m string")
    assert df.select(observe.without_secrets(F.col("m"))).first()[0] == 'api_key="[REDACTED]" rest'


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    one, two = (corpus.row_fingerprint(x, ["a", "b"]).first() for x in (df, df.repartition(5).orderBy(F.desc("a"))))
    assert one == two != corpus.row_fingerprint(df.withColumn("a", F.col("a") + 1), ["a", "b"]).first()


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make in (("rates", metrics.event_rates), ("drift", metrics.value_drift), ("runs", metrics.sessions)):
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() > 0
        got, all_ = spark.table(name).agg(F.sum("n")).first()[0], make(events).agg(F.sum("n")).first()[0]
        assert all_ == events.count() and 0 < got <= all_
