from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import language_id, mixing, packing
from docloom.llm.common import documents, staged
from docloom.llm.encoders import Encoder, tokenizer_file
from tests.llm.test_exact_and_tokens import ROWS, SCHEMA, check_pieces
from tests.llm.test_near_and_passages import brute_classes, brute_line_drops


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = documents(spark, sf_dir)
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        out[name] = docs
        assert name == "packing" or docs.columns == columns
    n = documents(spark, sf_dir).count()
    # language: what the operator rejects is gone, nothing else
    rejected = {r.doc_id for r in language_id.identify(documents(spark, sf_dir)).filter("rejected").collect()}
    assert {r.doc_id for r in out["language_id"].collect()} == {r.doc_id for r in documents(spark, sf_dir).collect()} - rejected
    # lines: brute force over what language left
    assert {r.doc_id: r.text for r in out["line_dedup"].collect()} == brute_line_drops(spark, out["language_id"].select("doc_id", "text"))
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].collect())
    # mix: each row as often as taken, sources near their targets
    taken = Counter(r.doc_id for r in out["mixing"].collect())
    plan = mixing.mix(out["near_dedup"]).collect()
    assert taken == Counter({r.doc_id: r.copies for r in plan if r.copies}) and max(taken.values()) <= 3
    for source in {tuple(r.sources) for r in plan}:
        rows = [r for r in plan if tuple(r.sources) == source]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(0.02 * rows[0].target, min((r.size for r in rows if r.size), default=0))
    # packing: every id of every row in one piece
    tok = Encoder(tokenizer_file("byte_bpe_50k.json")).tok
    once = packing.packed(out["mixing"].dropDuplicates(["doc_id"]), tokenizer_file("byte_bpe_50k.json")).collect()
    ids_of = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in out["mixing"].collect()}
    assert check_pieces(once, ids_of) == 0
    assert sum(r.length for r in out["packing"].collect()) == sum(len(ids_of[d]) * k for d, k in taken.items())
    assert 0.9 * n <= out["language_id"].count() <= n
    assert out["line_dedup"].count() == out["language_id"].count()
    texts = [(r.doc_id, r.text) for r in out["line_dedup"].collect()]
    assert {r.doc_id for r in out["near_dedup"].collect()} == set(brute_classes(texts).values())
    ids = {r.doc_id for r in out["near_dedup"].collect()}
    assert {r.doc_id for r in out["mixing"].collect()} <= ids
    pieces = out["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in out["mixing"].collect()}
    assert sum(r.length for r in pieces if r.start == 0) > 0


def test_pipeline_of_odd_rows_and_nothing(spark, tmp_path):
    for k, rows in enumerate((ROWS, [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert bool(got) == bool(rows)


def test_stages_keep_columns_of_clashing_names(spark, sf_dir):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "copies", "place", "at", "id", "h", "label", "node", "band", "_drop", "line", "n_lines", "score", "nth", "bits")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
        docs = staged(out)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
