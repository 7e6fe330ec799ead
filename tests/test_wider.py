"""Governance, search, service and runs: what the registered queries don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import cli
from docloom.config import CHUNKINGS, Context, Hybrid
from docloom.errors import CorpusError, EvaluationError, GenerationError, IndexingError, RetrievalError
from docloom.operators import answer, chunk, corpus, generate, hybrid, manifest, retrieve, run, sparse
from docloom.plans import queries as plans
from docloom.plans.adapt import corpus as corpus_table
from docloom.sources import records
from docloom.stage import shared_folder

DOCS = "document_id long, checksum_sha256 string, domain string, relative_path string, split string"


def test_manifest_is_checked_when_read(spark):
    docs = spark.createDataFrame([(1, "a", "legal", "development/legal/a.html", "development"), (2, "b", "legal", "evaluation/legal/b.html", "evaluation")], DOCS)
    path = shared_folder(spark)
    manifest.write(docs, path)
    assert manifest.read(spark, path).count() == 2
    docs.withColumn("split", F.lit("evaluation")).write.mode("overwrite").parquet(f"{path}/documents")
    with pytest.raises(CorpusError, match="fingerprint"):
        manifest.read(spark, path)
    with pytest.raises(CorpusError, match="both splits"):
        manifest.write(docs.withColumn("checksum_sha256", F.lit("a")), path)
    outside = docs.withColumn("relative_path", F.concat(F.lit("../"), "relative_path"))
    manifest.write(outside, path)
    with pytest.raises(CorpusError, match="outside"):
        manifest.read(spark, path)
    assert manifest.subset(docs, "legal", "evaluation").count() == 1 and manifest.subset(docs, split="none").count() == 0


def test_index_is_checked_when_read(spark):
    index = sparse.build(spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta"), (3, "")], "chunk_id long, text string"))
    path = shared_folder(spark)
    index.write(path)
    assert sparse.SparseIndex.read(spark, path, check=True).stats.first().n == 3
    index.df.withColumn("df", F.lit(9).cast("long")).write.mode("overwrite").parquet(f"{path}/df")
    with pytest.raises(IndexingError, match="contradicts"):
        sparse.SparseIndex.read(spark, path, check=True)
    index.postings.filter("chunk_id = 1").write.mode("overwrite").parquet(f"{path}/postings")
    with pytest.raises(IndexingError, match="fingerprint"):
        sparse.SparseIndex.read(spark, path, check=True)


CHUNKS = "chunk_id long, document_id long, text string, domain string, source_date date"


def chunks(spark):
    rows = [(1, 10, "term alpha of the first", "legal", "2024-01-01"), (2, 10, "term beta", "financial", None), (3, 11, "gamma delta", "legal", "2024-06-01")]
    return spark.createDataFrame([(*r[:4], r[4]) for r in rows], CHUNKS.replace("date date", "date string")).withColumn("source_date", F.to_date("source_date"))


def test_hybrid_search_filters_both_branches(spark):
    search = retrieve.HybridSearch.build(chunks(spark), config=Hybrid(top_k=2))
    q = spark.createDataFrame([(1, "term", "legal"), (2, "term", None)], "query_id long, question string, domain string")
    got = search.search(q)
    assert {r.chunk_id for r in got.filter("query_id = 1").collect()} == {1, 3} and got.filter("query_id = 2").count() == 2
    assert search.rebuilt(got).filter("text is null").count() == 0
    dated = spark.createDataFrame([(1, "term beta")], "query_id long, question string").withColumn("date_from", F.lit("2024-02-01").cast("date"))
    assert {r.chunk_id for r in search.search(dated).collect()} == {3}  # a chunk without date fails any bound
    for bad in (q.withColumn("question", F.lit(" ")), dated.withColumn("date_to", F.lit("2024-01-01").cast("date"))):
        with pytest.raises(RetrievalError):
            search.search(bad)
    with pytest.raises(RetrievalError):
        search.rebuilt(got.withColumn("chunk_id", F.lit(99).cast("long")))


def test_service(spark):
    texts = chunks(spark).withColumn("metadata", F.lit("{}"))
    index = sparse.build(texts)
    q = spark.createDataFrame([(1, "term alpha"), (2, "hello!"), (3, "nothing known")], "query_id long, question string")
    find = lambda x: sparse.top_k(sparse.scores(index, x), 5)
    got = {r.query_id: r for r in answer.AnswerService(find, texts).answers(q).collect()}
    assert got[1].answer == "term alpha of the first" and got[1].cited_chunk_ids == ["1"] and got[1].errors == []
    assert not got[2].retrieval_required and got[2].insufficient_context and got[3].insufficient_context and got[3].errors == []
    reply = lambda p: F.when(p.contains('id="1"'), F.lit(json.dumps({"answer": "a", "citations": [{"chunk_id": "1", "claim": "c"}], "insufficient_context": False}))).otherwise(F.lit(json.dumps({"answer": answer.REFUSAL, "citations": [], "insufficient_context": True})))
    got = {r.query_id: r for r in answer.AnswerService(find, texts, generator=reply).answers(q).collect()}
    assert got[1].cited_chunk_ids == ["1"] and got[3].insufficient_context
    with pytest.raises(GenerationError):
        answer.AnswerService(find, texts, generator=lambda p: F.lit("never JSON")).answers(q)


def test_run_resumes(spark):
    configs = spark.createDataFrame([("a", "f")], "config_id string, config_fingerprint string")
    examples = spark.createDataFrame([(i, "d") for i in range(6)], "example_id long, dataset_fingerprint string")
    path, asked = shared_folder(spark), []

    def produce(todo, attempt):
        asked.append(sorted(r.example_id for r in todo.collect()))
        return todo.filter(F.col("example_id") < 2 * attempt).withColumn("observation", F.lit("{}"))

    with pytest.raises(EvaluationError):
        run.resume(configs, examples, produce, path, attempts=2)
    assert asked == [[0, 1, 2, 3, 4, 5], [2, 3, 4, 5]]
    done = run.resume(configs, examples, lambda todo, _: todo.withColumn("observation", F.lit("{}")), path)
    assert done.count() == 6
    with pytest.raises(EvaluationError, match="another run"):
        run.resume(configs.withColumn("config_fingerprint", F.lit("g")), examples, produce, path)
    assert run.run_id("d", ["b", "a"]) == run.run_id("d", ["a", "b"]) and run.environment(spark, "r")["spark"] == spark.version


def test_chunk_strategies(spark):
    rows = [("d", 0, "e0", "title", "Top", 1, "Top"), ("d", 1, "e1", "text", "One two. Three four.", 1, "Top"), ("d", 2, "e2", "table", "h\tk\n" + "\n".join(f"a{i}\tb{i}" for i in range(300)), 2, "Top"), ("d", 3, "e3", "text", "After it.", 2, "Top")]
    e = spark.createDataFrame(rows, "document_id string, ordinal int, element_id string, kind string, text string, page_number int, section_hint string").withColumn("domain", F.lit("legal"))
    fixed = chunk.chunks(e, CHUNKINGS["fixed_256"]).orderBy("ordinal").collect()
    assert [r.kind for r in fixed] == ["text", *["table"] * (len(fixed) - 2), "text"] and len(fixed) == 5 and [r.ordinal for r in fixed] == list(range(5))
    assert fixed[0].text == "Top One two. Three four." and len({r.chunk_id for r in fixed}) == 5
    semantic = chunk.chunks(e, CHUNKINGS["semantic"]).orderBy("ordinal").collect()
    assert semantic[0].kind == "semantic" and semantic[-1].text == "After it." and "table" in {r.kind for r in semantic}


def brute_context(rows, most, least, near):
    """The context of one query, step by step."""
    import re

    kept, copies = [], []
    for r in sorted(rows, key=lambda r: (r.rank, r.pre_rank, r.chunk_id)):
        norm = " ".join(r.text.casefold().split())
        words = set(re.findall("[A-Za-z0-9]+", norm))
        if any(norm == n or (words and w and len(words & w) / len(words | w) >= near) for n, w, _ in kept):
            copies.append(r.chunk_id)
        else:
            kept.append((norm, words, r))
    blocks, inside, out = [], [], []
    total = lambda b: len(generate.SEPARATOR.join(b).split())
    for i, (_, _, r) in enumerate(kept):
        make = lambda t, s: generate.render(r.chunk_id, r.rank, r.document_id, r.metadata, t, s)  # noqa: B023, E731
        if total([*blocks, make(r.text, False)]) <= most:
            blocks.append(make(r.text, False))
            inside.append(r.chunk_id)
            continue
        w = r.text.split()
        fits = [k for k in range(least, len(w) + 1) if total([*blocks, make(" ".join(w[:k]), True)]) <= most]
        if fits:
            blocks.append(make(" ".join(w[: fits[-1]]), True))
            inside.append(r.chunk_id)
        else:
            out.append(r.chunk_id)
        out += [x.chunk_id for _, _, x in kept[i + 1 :]]
        break
    return generate.SEPARATOR.join(blocks), inside, out, copies


@pytest.mark.parametrize("most", [60, 400, 1200])
def test_context_by_brute_force(spark, sf_dir, most):
    r = hybrid.rerank(plans._candidates(spark, sf_dir), 20).withColumn("metadata", F.to_json(F.struct("document_id")))
    rows = r.select(*(F.col(c).cast("string").alias(c) for c in ("query_id", "chunk_id", "document_id")), "rank", "pre_rank", "text", "metadata").collect()
    by = {}
    for x in rows:
        by.setdefault(x.query_id, []).append(x)
    config = Context(max_context_tokens=most)
    got = generate.assemble(r, config).collect()
    assert len(got) == len(by)
    for g in got:
        want = brute_context(by[g.query_id], most, config.min_truncated_chunk_tokens, config.near_duplicate_jaccard_threshold)
        assert (g.rendered, g.included, g.omitted, g.duplicates) == want


def test_multi_hop_by_brute_force(spark, sf_dir):
    """The derived queries, and each of their lists, against plain Python over the same search."""
    texts = corpus_table(spark, sf_dir).withColumn("text", F.concat(F.lit("see Section "), F.col("chunk_id").cast("string"), F.lit(" ."), "text"))
    index = sparse.build(texts)
    search = lambda q: sparse.top_k(sparse.scores(index, q), 5)
    asked = plans.questions(spark, sf_dir).filter("query_id % 20 = 0")
    got = {}
    for r in hybrid.multi_hop(asked, search, texts, mode="always").collect():
        got.setdefault(r.query_id, []).append(r)
    first = {}
    for r in search(asked).orderBy("query_id", "rank").collect():
        first.setdefault(r.query_id, []).append(r)
    assert set(got) == set(first)
    derived = [(q * 10 + h, f"Section {r.chunk_id}") for q, rows in first.items() for h, r in enumerate(rows[:2], 2)]
    later = {}
    for r in search(spark.createDataFrame(derived, "query_id long, question string")).orderBy("query_id", "rank").collect():
        later.setdefault(r.query_id, []).append(r)
    for q, rows in first.items():
        order, hops = [], {}
        for h, found in [(1, rows), (2, later.get(q * 10 + 2, [])), (3, later.get(q * 10 + 3, []))]:
            for r in found:
                if r.chunk_id not in hops:
                    order.append(r.chunk_id)
                hops.setdefault(r.chunk_id, []).append(h)
        assert [(r.chunk_id, list(r.hops)) for r in sorted(got[q], key=lambda r: r.merged_rank)] == [(c, hops[c]) for c in order]
    trace = {r.query_id: r for r in hybrid.multi_hop_trace(asked, hybrid.derived_queries(search(asked).join(texts.select("chunk_id", "text"), "chunk_id"), asked, mode="always")).collect()}
    assert all(t.triggered and t.hops == [1, 2, 3] for q, t in trace.items() if len(first[q]) > 1)


def test_fingerprint_ignores_order_only(spark):
    rows = spark.createDataFrame([(i, f"h{i}") for i in range(50)], "a long, b string")
    one = corpus.row_fingerprint(rows, ["a", "b"]).first()
    assert one == corpus.row_fingerprint(rows.repartition(7).select("b", "a"), ["b", "a"]).first() and one != corpus.row_fingerprint(rows.filter("a <> 3"), ["a", "b"]).first()


def test_query_cache_and_reports(spark):
    path = shared_folder(spark)
    rows = spark.createDataFrame([("k", "old"), ("x", "y")], "cache_key string, payload string")
    records.cache_put(rows, path, 100)
    records.cache_put(rows.limit(1).withColumn("payload", F.lit("new")), path, 200)
    asked = spark.createDataFrame([("k",), ("x",), ("z",)], "cache_key string")
    assert {r.cache_key: r.payload for r in records.cache_get(asked, path, 250, 100).collect()} == {"k": "new", "x": None, "z": None}
    slices = spark.createDataFrame([("m", None, 2, 0.5), ("m", "legal", 1, 1.0)], "metric string, domain string, count long, mean_score double")
    out = json.loads(records.report_json(slices, spark.createDataFrame([("unknown", 3)], "category string, n long")))
    assert out["slices"][0] == {"metric": "m", "domain": None, "count": 2, "mean_score": 0.5} and out["failures"] == {"unknown": 3}


def test_cli_from_files_to_search(spark, tmp_path, capsys):
    for name, text in (("a", "The term alpha appears. All of it."), ("b", "Only beta here.")):
        folder = tmp_path / "corpus" / "evaluation" / "legal"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.html").write_text(f"<html><body><h1>{name}</h1><p>{text}</p></body></html>")
    run_ = lambda *a: cli.main([str(x) for x in a], spark)
    assert run_("scan", tmp_path / "corpus", tmp_path / "manifest") == 0
    assert manifest.read(spark, str(tmp_path / "manifest")).count() == 2
    assert run_("parse", tmp_path / "corpus", tmp_path / "parsed", "--domain", "legal") == 0
    assert run_("cut", tmp_path / "parsed", tmp_path / "chunks") == 0
    assert run_("index", tmp_path / "chunks", tmp_path / "index") == 0
    capsys.readouterr()
    assert run_("search", tmp_path / "index", "alpha") == 0
    assert len(capsys.readouterr().out.splitlines()) == 1
    assert run_("scan", tmp_path / "corpus", tmp_path / "again", "--strict") == 0
    (tmp_path / "corpus" / "evaluation" / "legal" / "c.txt").write_text("x")
    assert run_("scan", tmp_path / "corpus", tmp_path / "again", "--strict") == 1
