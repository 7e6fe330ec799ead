import io
import json
import random
import unicodedata
import uuid
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.config import Chunking, Cleaning, Context
from docloom.errors import ConfigurationError, DocumentParseError, EvaluationError
from docloom.functions import ids, text
from docloom.functions.vectors import cosine, dense, hash_embedding
from docloom.operators import chunk, clean, corpus, generate
from docloom.sources import loaders, records


def values(spark, rows, expr, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_normalize(spark):
    odd = [(" a b﻿\x00 c ",), ("trans-\n  port 2-\n3",), ("x\r\ny\rz",), ("ﬁ ½",), (None,)]
    assert values(spark, odd, text.normalize_text(F.col("t"))) == ["a b c", "transport 23", "x y z", "fi 1⁄2", None]
    assert values(spark, [("a  b\t c \n\n d\x0b",)], text.normalize_text(F.col("t"), F.lit("table"))) == ["a b\tc\n\nd"]


def test_signatures(spark):
    rows = [("ACME Report  Page 3 of 10",), ("page 7",), ("7 / 9",), ("Draft | 12",), ("Straße — 4",), ("Plan 2024",)]
    assert values(spark, rows, text.pattern_signature(F.col("t"))) == ["acme report page <page> of <total>", "page <page>", "<page-number>", "draft | <page>", "strasse — <page>", "plan 2024"]
    assert values(spark, rows, text.is_page_number(F.col("t"))) == [False, True, True, False, False, False]


def test_lexical_tokens(spark):
    rows = [("The 10-K for Q3: $AAPL, BRK.B up 12.5% on EBITDA revenue",), ("Section 7.4 and § 12.2 govern non-compete of the NDA",), ("RRF and BM25+ feed cross-encoder; Eq. 3",)]
    got = values(spark, rows, text.lexical_tokens(F.col("t")))
    assert got == [["10-k", "q3", "$aapl", "brk.b", "up", "12.5%", "ebitda", "revenue"], ["section", "7.4", "§12.2", "govern", "non-compete", "nda"], ["rrf", "bm25+", "feed", "cross-encoder", "eq", "3"]]


def test_similarity(spark):
    df = spark.createDataFrame([("a b c d", "a b c d e"), ("", ""), ("a", "")], "x string, y string")
    assert [r[0] for r in df.select(text.jaccard(text.comparison_tokens(F.col("x")), text.comparison_tokens(F.col("y")))).collect()] == [0.8, 1.0, 0.0]


def test_sentences_and_small_talk(spark):
    assert values(spark, [("One. Two is 2.5 long! then? [3] Four",)], text.sentences(F.col("t"))) == [["One.", "Two is 2.5 long! then?", "[3] Four"]]
    assert values(spark, [("Hello!",), ("Thank  you.",), ("hello world",)], text.is_small_talk(F.col("t"))) == [True, True, False]
    assert values(spark, [("Section 7.4 x",), ("7.4.1",), ("7 x",)], text.starts_legal_clause(F.col("t"))) == [True, True, False]


def test_ids(spark):
    ns = uuid.uuid4()
    assert values(spark, [("chk_1",)], ids.uuid5(ns, F.col("t"))) == [str(uuid.uuid5(ns, "chk_1"))]
    a, b = values(spark, [("x",), (None,)], ids.element_id(F.lit("d"), F.lit(0), F.lit("text"), F.col("t"), F.lit(None), F.lit("f")))
    assert a.startswith("elm_") and len(a) == 36 and a != b


def test_hash_embedding(spark):
    rows = spark.createDataFrame([(1, "Der Fluß fließt fluss"), (2, "a b a")], "k long, t string")
    got = {r.k: r.vector for r in dense(hash_embedding(rows, "k", "t", exact=True), "k").collect()}
    assert got[1] == pytest.approx(chunk.local_embedding("Der Fluß fließt fluss").tolist())
    assert got[2] == pytest.approx(chunk.local_embedding("a b a").tolist())
    two = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in two.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, pytest.approx(2**-0.5)]


def test_configs():
    assert Cleaning().fingerprint == Cleaning().fingerprint != Cleaning(dedup_min_pages=4).fingerprint
    for bad in (lambda: Chunking(chunk_size=4, chunk_overlap=4), lambda: Cleaning(unicode_form="NFD"), lambda: Context(max_context_tokens=0)):
        with pytest.raises(ConfigurationError):
            bad()


PAGE = b"""<html><head><style>x</style></head><body><header>Top</header><h2>Part <b>one</b></h2><p>Text &amp; more</p><ul><li>item <p>inner</p></li></ul>
<hr class="page-break"><table><tr><th>k</th><td> v </td></tr><tr><td>1</td><td>2</td></tr></table><p class="caption">Fig</p><p>Table 2 shows</p><script>no</script><footer>End</footer></body></html>"""


def test_html():
    got = [e[:2] for e in loaders.parse_html(PAGE)]
    assert got == [("title", "Top"), ("title", "Part one"), ("text", "Text & more"), ("list_item", "item inner"), ("page_break", ""), ("table", "k\tv\n1\t2"), ("caption", "Fig"), ("caption", "Table 2 shows"), ("footer", "End")]
    assert loaders.parse_html(PAGE, strict_header=True)[0][0] == "header"
    assert {e[3] for e in loaders.parse_html(PAGE)[1:]} == {"Part one"}


def docx(body, styles="", header=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def p(t, style=None, extra=""):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t>{extra}</w:r></w:p>"


def test_docx():
    body = p("Intro", "H1") + p("1. first", None, '<w:br w:type="page"/>') + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>" + p("Body")
    got = loaders.parse_docx(docx(body, '<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style>', "Head"))
    assert [e[:3] for e in got] == [("title", "Intro", 1), ("list_item", "1. first", 1), ("page_break", "", 1), ("table", "a\tb", 2), ("text", "Body", 2), ("header", "Head", None)]


def test_scan_and_parse(spark, tmp_path):
    for name, data in (("evaluation/legal/a_b-c.html", PAGE), ("development/financial/x.docx", b"no zip"), ("development/research/p.pdf", b"%PDF"), ("development/research/n.txt", b"t")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = loaders.scan_corpus(spark, str(tmp_path))
    by = {r.relative_path: r for r in files.drop("content").collect()}
    assert by["evaluation/legal/a_b-c.html"].logical_title == "a b c" and by["evaluation/legal/a_b-c.html"].domain == "legal" and not by["development/research/n.txt"].supported
    elements = loaders.parse(files.filter("supported")).cache()
    assert elements.filter("error is null").count() == 9
    assert loaders.failures(elements).count() == 2
    with pytest.raises(DocumentParseError):
        loaders.failures(elements, most=1)
    assert loaders.with_element_ids(elements).select("element_id").distinct().count() == 9
    manifest = files.select("relative_path", "checksum_sha256")
    assert corpus.manifest_files(manifest, files.filter("relative_path not like '%txt'")).collect()[0].reason == "missing"


def element(spark, rows):
    return spark.createDataFrame([(f"d{r[0]}", i, f"e{i}", *r[1:]) for i, r in enumerate(rows)], "document_id string, ordinal int, element_id string, kind string, text string, page_number int")


def test_cleaning(spark):
    notice = "This report is confidential and not for distribution to any other party"
    rows = [(1, "header", f"Acme  Page {n} of 3", n) for n in (1, 2, 3)] + [(1, "footer", str(n), n) for n in (1, 2, 3)] + [(1, "text", notice + (" now" if n == 3 else ""), n) for n in (1, 2, 3)]
    rows += [(1, "text", "Said twice", 1), (1, "text", "Said twice", 2), (1, "text", " \x00", 1), (1, "table", "", 1), (2, "header", "Once", 1)]
    got = clean.clean(element(spark, rows), Cleaning(dedup_similarity_threshold=0.9)).cache()
    reasons = [r.reason for r in got.orderBy("ordinal").collect()]
    assert reasons == ["repeated_header"] * 3 + ["page_number"] * 3 + [None, "duplicate_boilerplate", "near_duplicate_boilerplate", None, None, "empty_after_normalization", None, None]
    s = {r.document_id: r for r in clean.stats(got).collect()}
    assert (s["d1"].elements_out, s["d1"].boilerplate_removed, s["d1"].page_numbers_removed, s["d1"].tables_preserved, s["d2"].elements_out) == (4, 8, 3, 1, 1)
    assert [r.clean_ordinal for r in got.filter("reason is null and document_id = 'd1'").orderBy("ordinal").collect()] == [0, 1, 2, 3]


def test_windows_and_tables(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(281)))), (2, "a"), (3, "")], "k long, text string")
    got = [(r.k, r.start, r.token_count, r.overlap_tokens) for r in chunk.fixed_chunks(df, "k", "text", Chunking()).orderBy("k", "ordinal").collect()]
    assert got == [(1, 0, 256, 0), (1, 224, 57, 32), (2, 0, 1, 0)]
    t = spark.createDataFrame([("d", 0, "h1\th2\na b\tc\nd\te\nf g h i j\tk"), ("d", 1, "h\nx"), ("d", 2, " ")], "document_id string, ordinal int, text string")
    got = [(r.ordinal, r.group, r.text, r.row_start, r.row_end, r.repeated_header, r.oversized) for r in chunk.table_chunks(t, Chunking("table", 6, 0)).orderBy("ordinal", "group").collect()]
    assert got == [(0, 0, "h1\th2\na b\tc", 1, 2, False, False), (0, 1, "h1\th2\nd\te", 2, 3, True, False), (0, 2, "h1\th2\nf g h i j\tk", 3, 4, True, True), (1, 0, "h\nx", 0, 2, False, False)]


def test_blocks(spark):
    rows = [(1, "text", "a b", 1), (1, "text", "7.1 Scope c", 2), (1, "table", "t\tu", 2), (1, "text", "d", 3), (1, "page_break", "", 3)]
    e = element(spark, rows).withColumns({"section_hint": F.lit("s"), "domain": F.lit("legal")})
    assert [r.block for r in chunk.blocks(e, Chunking()).orderBy("ordinal").collect()] == [0, 1, 2, 3]
    got = chunk.block_chunks(e, Chunking(section_aware=False)).orderBy("block").collect()
    assert [(r.text, r.element_ids, r.pages) for r in got] == [("a b 7.1 Scope c", ["e0", "e1"], [1, 2]), ("d", ["e3"], [3])]


def test_semantic_chunks(spark):
    like, other = "red red red red.", "Blue blue blue blue."
    units = spark.createDataFrame([("d", 0, f"{like.capitalize()} {like.capitalize()} {other}")], "document_id string, ordinal int, text string")
    got = chunk.semantic_chunks(units, Chunking("semantic", 512, 0, semantic_min_tokens=4)).orderBy("group").collect()
    assert [(r.segment_count, r.token_count) for r in got] == [(2, 8), (1, 4)]


def test_context(spark):
    rows = [("q", "c1", "d", 1, 1, "alpha beta gamma", "{}"), ("q", "c2", "d", 2, 2, "Alpha  beta gamma", "{}"), ("q", "c3", "d", 3, 3, " ".join(map(str, range(40))), "{}"), ("q", "c4", "d", 4, 4, "omega", "{}")]
    df = spark.createDataFrame(random.Random(0).sample(rows, 4), "query_id string, chunk_id string, document_id string, rank int, pre_rank int, text string, metadata string")
    r = generate.assemble(df, Context(max_context_tokens=40)).collect()[0]
    assert (r.included, r.omitted, r.duplicates, r.truncated) == (["c1", "c3"], ["c4"], ["c2"], True)
    assert r.token_count == len(r.rendered.split()) <= 40


def test_answer_errors(spark):
    df = spark.createDataFrame([("fine", ["a"], False), ("fine", ["z"], False), ("fine", [], False), ("Insufficient context.", ["a"], True), ("no", [], True)], "answer string, cited array<string>, no boolean")
    got = [r[0] for r in df.select(generate.answer_errors(F.col("answer"), F.col("cited"), F.array(F.lit("a")), F.col("no"))).collect()]
    assert got == [[], ["unknown_citation"], ["no_citation"], ["refusal_with_citations"], ["refusal_without_phrase"]]


def test_records(spark, tmp_path):
    line = {"example_id": "e1", "question": "q", "supporting_document_ids": ["d"], "table_parsing_required": True}
    (tmp_path / "ok.jsonl").write_text(json.dumps(line) + "\n\n" + json.dumps(line | {"example_id": "e0"}) + "\n")
    df = records.read_jsonl(spark, str(tmp_path / "ok.jsonl"))
    assert df.count() == 2
    records.write_jsonl(df, str(tmp_path / "out"))
    assert records.read_jsonl(spark, str(tmp_path / "out")).count() == 2
    records.write_review_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().supporting_document_ids == "d"
    for bad in ("{", json.dumps(line | {"more": 1})):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(EvaluationError):
            records.read_jsonl(spark, str(tmp_path / "bad.jsonl"))


def test_casefold_over_the_alphabet(spark):
    chars = [chr(c) for c in range(32, 0x250)]
    got = values(spark, [(c,) for c in chars], text.casefold(F.col("t"), exact=True))
    assert got == [c.casefold() for c in chars]
    assert pd.Series(values(spark, [(c,) for c in chars], text.nfkc(F.col("t")))).tolist() == [unicodedata.normalize("NFKC", c) for c in chars]
