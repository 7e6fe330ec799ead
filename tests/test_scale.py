"""Steps that must not grow faster than their input: their plans, and their results where they have edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import Chunking, Context, Sparse
from docloom.errors import IndexingError
from docloom.functions import text, vectors
from docloom.operators import chunk, dense, evaluate, generate, retrieve, sparse
from docloom.plans import registry as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(rows, queries, k):
    """query_id, chunk_id, rank by plain Python."""
    out = []
    for q, x in queries:
        scores = []
        for c, v in rows:
            length = math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(a * a for a in x))
            scores.append((-round(sum(a * b for a, b in zip(v, x)) / length if length else 0.0, 9), c))
        out += [(q, c, i) for i, (_, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("key", ["long", "string"])
def test_dense_search_by_brute_force(spark, monkeypatch, key):
    """Copies, zeros and opposite vectors; parts of few pairs; no row for each pair of the two tables in the plan."""
    r = random.Random(3)
    rows = [(i if key == "long" else f"c{i:03}", [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(300)] + [(998 if key == "long" else "y", [0.0] * 3)]
    v = spark.createDataFrame(rows, f"chunk_id {key}, vector array<double>").repartition(5)
    queries = [(i, x) for i, (_, x) in enumerate(rows[:40])] + [(77, [0.0] * 3)]
    q = spark.createDataFrame(queries, "query_id int, vector array<double>")
    got = dense.search(v, q, 7)
    assert sorted((x.query_id, x.chunk_id, x.rank) for x in got.collect()) == brute(rows, queries, 7)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    monkeypatch.setattr(dense, "MAX_QUERIES", 9)
    monkeypatch.setattr(dense, "MAX_PAIRS", 50)
    assert sorted((x.query_id, x.chunk_id, x.rank) for x in dense.search(v, q, 7).collect()) == brute(rows, queries, 7)


def test_dense_search_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [-1.0, 0.0])], "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    got = {}
    for r in dense.search(v, q, 9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    assert got == {1: [(1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, -1.0)], 2: [(i, 0.0) for i in range(1, 6)]}
    assert dense.search(v, q.limit(0), 3).count() == 0 and dense.search(v.limit(0), q, 3).count() == 0
    with pytest.raises(Exception, match="different dimensions"):
        dense.search(v, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).collect()
    with pytest.raises(IndexingError):
        dense.matrix(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").toArrow()["v"])


def test_dense_search_keeps_nan_first(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0])], "chunk_id long, vector array<double>")
    got = dense.search(v, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"), 1).collect()
    assert [r.chunk_id for r in got] == [2] and np.isnan(got[0].score)


def test_dense_search_under_filters(spark):
    v = spark.range(1, 200).selectExpr("id AS chunk_id", "array(cos(id), sin(id)) AS vector", "named_struct('kind', id % 7) AS attributes")
    q = spark.range(1, 30).selectExpr("id AS query_id", "array(cos(id), sin(id)) AS vector", "named_struct('kind', if(id % 3 = 0, null, id % 7)) AS filters")
    where = lambda a, f: f["kind"].isNull() | (a["kind"] == f["kind"])
    got = sorted((r.query_id, r.chunk_id, r.rank) for r in dense.search(v, q, 4, where=where).collect())
    angle = lambda i: [math.cos(i), math.sin(i)]
    want = []
    for i in range(1, 30):
        want += brute([(c, angle(c)) for c in range(1, 200) if i % 3 == 0 or c % 7 == i % 7], [(i, angle(i))], 4)
    assert got == sorted(want)
    same = v.withColumn("label", F.when(F.col("chunk_id") % 5 > 0, F.col("chunk_id") % 5))
    asked = q.withColumn("label", F.when(F.col("query_id") % 5 > 0, F.col("query_id") % 5))
    want = [x for i in range(1, 30) if i % 5 for x in brute([(c, angle(c)) for c in range(1, 200) if c % 5 == i % 5], [(i, angle(i))], 4)]
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in dense.search(same, asked, 4, same="label").collect()) == sorted(want)


def test_contexts_are_made_without_a_group_each(spark, monkeypatch):
    """Queries of one and of many candidates side by side, in parts; no Python call for each query."""
    rows = [(f"q{i}", f"c{j}", "d", j, j, f"text {i} of {j} " * (1 + i % 5), "{}") for i in range(300) for j in range(1 + i % 3)] + [(None, "c", "d", 1, 1, "alone", "{}")]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "query_id string, chunk_id string, document_id string, rank int, pre_rank int, text string, metadata string").repartition(3)
    monkeypatch.setattr(generate, "MAX_CHARS", 500)
    got = generate.assemble(df, Context(max_context_tokens=10_000))
    assert "FlatMapGroups" not in plan(got)
    by = {r.query_id: r for r in got.collect()}
    assert len(by) == got.count() == 301 and by[None].included == ["c"]
    for i in range(300):
        texts = [f"text {i} of {j} " * (1 + i % 5) for j in range(1 + i % 3)]
        r = by[f"q{i}"]
        assert r.included + r.duplicates == [f"c{j}" for j in range(len(texts))] and r.token_count == len(r.rendered.split()) and not r.omitted
        assert r.rendered.startswith(generate.render("c0", 0, "d", "{}", texts[0], False))


def brute_segments(segments, config):
    out, before, held, used = [], None, [], 0
    for s in segments:
        n, v = len(s.split()), chunk.local_embedding(s)
        if held:
            length = np.linalg.norm(before) * np.linalg.norm(v)
            alike = float(before @ v) / length if length else 0.0
            if used + n > config.semantic_max_tokens or (alike < config.semantic_similarity_threshold and used >= config.semantic_min_tokens):
                out.append((" ".join(held), used, len(held)))
                held, used = [], 0
        held, used, before = [*held, s], used + n, v
    return out + [(" ".join(held), used, len(held))] * bool(held)


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.78])
def test_semantic_chunks_by_brute_force(spark, monkeypatch, threshold):
    """Documents of several units, sentences repeated so that likenesses meet the threshold; no Python call for each document."""
    r, words = random.Random(5), "Fluß red blue sea is a of one two Tree".split()
    texts = {f"d{i}": [" ".join(" ".join(r.choices(words, k=r.randint(1, 5))).capitalize() + "." for _ in range(r.randint(0, 40))) for _ in range(1 + i % 3)] for i in range(60)}
    rows = [(d, j, t) for d, own in texts.items() for j, t in enumerate(own)]
    units = spark.createDataFrame(r.sample(rows, len(rows)), "document_id string, ordinal int, text string").repartition(3)
    config = Chunking("semantic", 512, 0, semantic_min_tokens=3, semantic_max_tokens=30, semantic_similarity_threshold=threshold)
    monkeypatch.setattr(chunk, "MAX_SEGMENTS", 70)
    out = chunk.semantic_chunks(units, config)
    assert "FlatMapGroups" not in plan(out)
    got = {}
    for x in out.orderBy("document_id", "group").collect():
        got.setdefault(x.document_id, []).append((x.text, x.token_count, x.segment_count))
    split = lambda t: [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\[])", t) if s]
    want = {d: brute_segments([s for t in own for s in split(t)], config) for d, own in texts.items()}
    assert got == {d: x for d, x in want.items() if x}
    own = chunk.semantic_chunks(units, config, embed=lambda s, dim: chunk.local_embedding(s, dim))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, out.collect()))


ODD = ["§ 12.4 and §\t7", "a.b c.12 1.2.3 x-y-z+ U.S. e-mail A+ +5% -1,000.50% $AB.C $x 12,345 a1b2+ word.", "Straße naïve x\x1cy\xa0z", "the THE The-the of", "abcdefghijk.lm abcdefghij.lmnop a-b-c.d a-", "", None, "１２ x２ İ K", "n" * 50 + ".x"]


def test_tokens_in_python_are_those_of_spark(spark):
    r = random.Random(2)
    texts = ODD + ["".join(r.choices("aZ9.,-+%$§ \n\tthe", k=60)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plainly = F.transform(F.regexp_extract_all("t", F.lit(text.TOKEN), 0), lambda t: F.lower(F.when(t.startswith("§"), F.regexp_replace(t, r"\s+", "")).otherwise(t)))
    for i, t, tokens, all_tokens in df.select("i", "t", text.lexical_tokens(F.col("t")), plainly).collect():
        assert text.token_counts(t) == Counter(tokens or []) and text.token_counts(t, ()) == Counter(all_tokens or []), (i, t)


def corpus_of(spark, n, key="long"):
    r = random.Random(9)
    rows = [(str(i) if key == "string" else i, " ".join(r.choices(["alpha", "beta", "gamma", "delta", "rho", "tau", f"w{i}"], k=r.randint(0, 9))), r.choice(["legal", "financial", None]), i % 3, f"2024-0{1 + i % 9}-01") for i in range(n)]
    return spark.createDataFrame(rows, f"chunk_id {key}, text string, domain string, document_id long, d string").withColumn("source_date", F.to_date("d")).drop("d").repartition(4)


@pytest.mark.parametrize("key", ["long", "string"])
def test_bm25_search_is_top_k_of_all_scores(spark, monkeypatch, key):
    """Each task's best, in parts of few pairs, against the join; neither texts nor postings are shuffled."""
    chunks = corpus_of(spark, 300, key)
    index = sparse.build(chunks, attributes=retrieve.ATTRIBUTES)
    assert index.packed is not None and "Exchange" not in plan(index.packed) + plan(index.postings)
    asked = spark.createDataFrame([(1, "alpha beta beta"), (2, "w17 none"), (3, "the"), (4, None), (5, "rho tau alpha gamma")], "query_id int, question string")
    narrowed = asked.withColumns({"domain": F.when(F.col("query_id") % 2 == 1, "legal"), "date_from": F.lit("2024-03-01").cast("date")})
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in df.collect())
    for pairs in (2_000_000, 7):
        monkeypatch.setattr(sparse, "MAX_PAIRS", pairs)
        for config in (Sparse(), Sparse(variant="bm25_plus")):
            found = sparse.search(index, asked, 6, config)
            assert rows(found) == rows(sparse.top_k(sparse.scores(index, asked, config), 6)) != []
            assert "chunk_id" not in "".join(re.findall(r"hashpartitioning\((.*?)\)", plan(found)))
            want = sparse.top_k(retrieve.filtered_hits(sparse.scores(index, narrowed, config), chunks, narrowed), 6)
            assert rows(retrieve.by_terms(index, chunks, narrowed, 6, config)) == rows(want) != []
    plus = Sparse(variant="bm25_plus")
    assert [rows(x) for x in sparse.searches(index, asked, [(3, Sparse()), (5, plus)])] == [rows(sparse.search(index, asked, 3)), rows(sparse.search(index, asked, 5, plus))]
    for name in ("MAX_SEARCHED", "MAX_TERMS"):
        with monkeypatch.context() as m:
            m.setattr(sparse, name, 1)
            assert rows(sparse.search(index, asked, 6)) == rows(sparse.top_k(sparse.scores(index, asked), 6))
            assert rows(retrieve.by_terms(index, chunks, narrowed, 6)) == rows(sparse.top_k(retrieve.filtered_hits(sparse.scores(index, narrowed), chunks, narrowed), 6))


def test_bm25_search_of_keys_that_come_twice(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (1, "alpha gamma"), (2, "alpha"), (3, None)], "chunk_id long, text string").repartition(4)
    index, asked = sparse.build(chunks), spark.createDataFrame([(1, "alpha gamma")], "query_id int, question string")
    assert index.packed is None and index.stats.first().n == 4 and sorted(map(tuple, index.postings.select("chunk_id", "term", "tf").collect())) == [(1, "alpha", 2), (1, "beta", 1), (1, "gamma", 1), (2, "alpha", 1)]
    assert [(r.chunk_id, r.rank) for r in sparse.search(index, asked, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_chunks_that_hold_a_question(spark, monkeypatch):
    texts = ["x (a|b)* [c] \\d+ . y", "x (a|b)* [c] \\d+ . longer than the first thirty-two of it", "ab", None, "line\nend § ü€", "", "nothing"]
    asked = ["(a|b)* [c] \\d+ .", "(a|b)* [c] \\d+ . longer than the first thirty-two of it", "line\nend § ü€", "", None, "absent"]
    c, q = (spark.createDataFrame(list(enumerate(x)), s) for x, s in ((texts, "chunk_id long, text string"), (asked, "query_id long, question string")))
    want = sorted((i, j) for i, a in enumerate(asked) for j, t in enumerate(texts) if a is not None and t is not None and a in t)
    for questions in (q, q.filter("question <> ''"), q.limit(0)):
        found = evaluate.holding(c, questions)
        assert "MapInArrow" in plan(found) or questions.isEmpty()
        some = {r.query_id for r in questions.collect()}
        assert sorted(map(tuple, found.collect())) == [x for x in want if x[0] in some]
    monkeypatch.setattr(evaluate, "MAX_BEGINNINGS", 2)
    assert sorted(map(tuple, evaluate.holding(c, q).collect())) == want


@pytest.mark.parametrize("name", ["regression_compare", "domain_winners", "hop_merge", "multi_hop"])
def test_one_index_serves_all_searches(spark, sf_dir, monkeypatch, name):
    built = []
    real = sparse.build
    monkeypatch.setattr(sparse, "build", lambda *a, **b: built.append(1) or real(*a, **b))
    assert plans.QUERIES[name](spark, sf_dir).count() > 0 and len(built) == 1


def test_results_meet_texts_where_these_lie(spark, monkeypatch):
    few = spark.createDataFrame([(1, 5), (2, 5), (3, 7)], "query_id int, chunk_id long")
    many = spark.range(50).selectExpr("id AS chunk_id", "cast(id AS string) AS text")
    with_texts = sparse.beside(few, many, "chunk_id")
    assert "Exchange hashpartitioning" not in plan(with_texts) and with_texts.columns == ["query_id", "chunk_id", "text"]
    monkeypatch.setattr(sparse, "MAX_FEW", 2)
    assert sorted(map(tuple, sparse.beside(few, many, "chunk_id").collect())) == sorted(map(tuple, with_texts.collect())) == [(1, 5, "5"), (2, 5, "5"), (3, 7, "7")]


def test_hash_vectors_by_brute_force(spark):
    texts = ["a b a", "Der Fluß", "x\x1cy z\xa0w　v", "", None, " \t"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").withColumn("attributes", F.struct("k"))
    found = vectors.hash_vectors(df, "k", "t", exact=True, keep=("attributes",))
    got = {r.k: r.vector for r in found.collect()}
    assert "hashpartitioning" not in plan(found) and set(got) == {0, 1, 2} and all(r.attributes.k == r.k for r in found.collect())
    for i in (0, 1):
        assert got[i] == chunk.local_embedding(texts[i]).tolist()
    one = np.zeros(64)
    for word in ("x\x1cy", "z", "w", "v"):
        one += vectors.WordBuckets().counts([[word]])[0]
    assert got[2] == pytest.approx((one / np.linalg.norm(one)).tolist())
    assert sorted(map(tuple, vectors.hash_embedding(df, "k", "t").filter("k = 0").select("bucket", "value").collect())) == [(i, x) for i, x in enumerate(got[0]) if x]
