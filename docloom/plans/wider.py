"""Further registered queries: governance, checks, the service and runs; with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import CHUNKINGS, Chunking, Cleaning, Context, Drift, Hybrid, Sparse
from docloom.functions import ids
from docloom.functions.text import REFERENCE, REFUSALS, RELATION_CUES, SMALL_TALK, is_page_number, is_small_talk, pattern_signature, sentences
from docloom.operators import answer, chunk, clean, corpus, dense, evaluate, generate, hybrid, manifest, observe, retrieve, run, sparse
from docloom.plans import queries as q
from docloom.plans.adapt import SQL as TABLES
from docloom.plans.adapt import corpus as corpus_table
from docloom.plans.adapt import domain, filtered_questions, questions, read
from docloom.sources import records
from docloom.stage import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# -- corpus and manifest

_PATHS = "CASE WHEN doc_id % 7 = 0 THEN 'evaluation/sports/' WHEN doc_id % 11 = 0 THEN '' ELSE split || '/' || domain || '/' END || 'Annual_report-' || doc_id || '.html'"


@registered(f"""WITH {TABLES}, p AS (SELECT document_id AS doc_id, split, domain FROM corpus), r AS (SELECT doc_id, {_PATHS} AS relative_path FROM p),
s AS (SELECT *, string_split(relative_path, '/') AS a FROM r), k AS (SELECT *, len(a) >= 3 AND a[1] IN ('development', 'evaluation') AND a[2] IN ('financial', 'legal', 'research') AS ok FROM s)
SELECT doc_id, relative_path, CASE WHEN ok THEN a[1] END AS split, CASE WHEN ok THEN a[2] END AS domain, 'Annual report ' || doc_id AS logical_title FROM k""")
def corpus_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and titles from the paths of files."""
    c = corpus_table(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "split", "domain")
    folder = F.when(F.col("doc_id") % 7 == 0, "evaluation/sports/").when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat("split", F.lit("/"), "domain", F.lit("/")))
    path = F.concat(F.lit("/data/corpus/"), folder, F.lit("Annual_report-"), F.col("doc_id").cast("string"), F.lit(".html"))
    return c.select("doc_id", *(x.alias(n) for n, x in corpus.parse_layout(path, "/data/corpus").items()), corpus.logical_title(path).alias("logical_title"))


@registered(f"""WITH {TABLES}, m AS (SELECT document_id AS d, CASE WHEN document_id % 19 = 0 THEN '../' || relative_path ELSE relative_path END AS relative_path FROM corpus)
SELECT relative_path, CASE WHEN d % 19 = 0 THEN 'outside_root' WHEN d % 17 = 0 THEN 'missing' ELSE 'checksum' END AS reason FROM m WHERE d % 19 = 0 OR d % 17 = 0 OR d % 13 = 0""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a manifest whose files are elsewhere, gone or changed."""
    c = corpus_table(spark, sf_dir)
    d = F.col("document_id")
    entries = c.select(F.when(d % 19 == 0, F.concat(F.lit("../"), "relative_path")).otherwise(F.col("relative_path")).alias("relative_path"), "checksum_sha256")
    files = c.filter(d % 17 != 0).select("relative_path", F.when(d % 13 == 0, "changed").otherwise(F.col("checksum_sha256")).alias("checksum_sha256"))
    return corpus.manifest_files(entries, files)


def _fingerprint_sql(rows: str, json: str, head: str = "") -> str:
    word = lambda i: f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT)"
    words = " || '-' || ".join(f"coalesce({word(i)}::VARCHAR, '0')" for i in range(4))
    return f"WITH {head} f AS (SELECT sha256({json}) AS h FROM {rows}) SELECT count(*) AS n, sha256(count(*)::VARCHAR || '-' || {words}) AS fingerprint FROM f"


_ENTRY = """'{"checksum_sha256":"' || checksum_sha256 || '","domain":"' || domain || '","relative_path":"' || relative_path || '","split":"' || split || '"}'"""
SQL["corpus_fingerprint"] = _fingerprint_sql("corpus", _ENTRY, f"{TABLES},")


@registered(_fingerprint_sql("corpus WHERE split = 'evaluation' AND domain = 'legal' AND checksum_sha256 NOT IN (SELECT checksum_sha256 FROM corpus GROUP BY 1 HAVING min(split) <> max(split))", _ENTRY, f"{TABLES},"))
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest without leaks, written, read with all checks, a subset of it named by its fingerprint."""
    c = corpus_table(spark, sf_dir)
    clean_ = c.join(corpus.split_leakage(c, "checksum_sha256").select("checksum_sha256"), "checksum_sha256", "left_anti").select("document_id", *manifest.IDENTITY)
    path = shared_folder(spark, "manifest")
    manifest.write(clean_, path)
    return corpus.row_fingerprint(manifest.subset(manifest.read(spark, path), "legal", "evaluation"), manifest.IDENTITY)


@registered(_fingerprint_sql("benchmark", """'{"item_id":' || item_id || ',"question_sha256":"' || sha256(text) || '"}'"""))
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("question_sha256"))
    return corpus.row_fingerprint(rows, ["item_id", "question_sha256"])


@registered(_fingerprint_sql("post", """'{"chunk_id":' || chunk_id || ',"dl":' || dl || ',"term":"' || term || '","tf":' || tf || '}'""", f"{TABLES}, {q._INDEX},"))
def index_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a BM25 index that was written and read back."""
    path = shared_folder(spark, "index")
    sparse.build(corpus_table(spark, sf_dir)).write(path)
    return sparse.fingerprint(sparse.SparseIndex.read(spark, path))


@registered(f"""WITH {TABLES}, {q._INDEX} SELECT 'document_frequency' AS rule, term AS key FROM freq WHERE length(term) % 7 = 0""")
def index_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index whose document frequencies were tampered with."""
    i = sparse.build(corpus_table(spark, sf_dir))
    df = i.df.withColumn("df", F.when(F.length("term") % 7 == 0, F.col("df") + 1).otherwise(F.col("df")))
    return sparse.integrity(sparse.SparseIndex(i.postings, df, i.stats))


_NAMESPACE = uuid.NAMESPACE_URL


@registered(f"""WITH h AS (SELECT vec_id, sha1(unhex('{_NAMESPACE.hex}') || encode('chunk:' || vec_id)) AS h FROM embeddings)
SELECT vec_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(hex((((('0x' || substr(h, 17, 2))::INT & 63) | 128)::UTINYINT)::INT)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", ids.uuid5(_NAMESPACE, F.concat(F.lit("chunk:"), F.col("vec_id").cast("string"))).alias("point_id"))


_STAGES = {"cleaning": Cleaning(), "sparse": Sparse(), "bm25_plus": q.PLUS, "hybrid": Hybrid(), "context": Context(), "drift": Drift()} | {k: c for k, c in CHUNKINGS.items()}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stage_sql() -> str:
    import json
    from dataclasses import asdict

    return " UNION ALL ".join(f"SELECT {_literal(k)} AS stage, sha256({_literal(json.dumps(asdict(c), sort_keys=True, separators=(',', ':')))}) AS fingerprint" for k, c in _STAGES.items())


@registered(_stage_sql())
def stage_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, c.fingerprint) for k, c in _STAGES.items()], "stage string, fingerprint string")


# -- cleaning and chunking

_LINES = """l AS (SELECT doc_id, i - 1 AS i, a[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), range(1, len(a) + 1) t(i))"""
_BLANK = r"regexp_matches({}, '[^\s\x{{a0}}\x{{85}}\x{{1c}}-\x{{1f}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')"


@registered(r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Annual  Report ' || doc_id WHEN 1 THEN 'Page ' || doc_id || ' of 90' WHEN 2 THEN ' p. ' || doc_id ELSE 'Annual Report | ' || doc_id END AS t FROM documents),
s AS (SELECT doc_id, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS t FROM t),
p AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '\bpage\s+\d+\s+(?:of|/)\s*\d+\b', 'page <page> of <total>', 'g'), '\bpage\s+\d+\b', 'page <page>', 'g') AS p FROM s)
SELECT doc_id, CASE WHEN regexp_matches(p, '^\s*(?:p(?:age)?\.?\s*)?\d+(?:\s*/\s*\d+)?\s*$') THEN '<page-number>' ELSE regexp_replace(p, '(^|[|—–-]\s*)\d+\s*$', '\1<page>') END AS signature,
       regexp_matches(t, '^(?:\s*(?:p(?:age)?\.?\s*)?\d+(?:\s*/\s*\d+)?\s*|page\s+\d+|page\s+\d+\s+(?:of|/)\s*\d+)$') AS is_page FROM p""")
def page_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of headers and footers when pages vary."""
    n = F.col("doc_id").cast("string")
    t = F.element_at(F.array(F.concat(F.lit("Annual  Report "), n), F.concat(F.lit("Page "), n, F.lit(" of 90")), F.concat(F.lit(" p. "), n), F.concat(F.lit("Annual Report | "), n)), (F.col("doc_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", pattern_signature(t, exact=False).alias("signature"), is_page_number(t, exact=False).alias("is_page"))


@registered(f"""WITH {_LINES}, p AS (SELECT doc_id, count(DISTINCT i // 10) AS pages FROM l GROUP BY 1)
SELECT doc_id::VARCHAR AS document_id, CASE WHEN pages >= 2 THEN pages ELSE 0 END AS n_suppressed, pages AS n_footers FROM p""")
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers that recur over the pages of a document."""
    rows = clean.with_repeats(clean.prepared(q._line_elements(spark, sf_dir), exact=False), exact=False)
    return rows.filter("kind = 'footer'").groupBy("document_id").agg(F.count_if(F.col("reason") == "page_number").alias("n_suppressed"), F.count(F.lit(1)).alias("n_footers"))


@registered(rf"""WITH {_LINES},
a AS (SELECT doc_id, regexp_replace(regexp_replace(line, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{ad}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g') AS t FROM l),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\s\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM a)
SELECT doc_id::VARCHAR AS document_id, count(*) FILTER (WHERE length(t) BETWEEN 24 AND 320 AND ({" OR ".join(f"contains(replace(lower(t), 'ß', 'ss'), {_literal(m)})" for m in Cleaning().boilerplate_markers)})) AS n_eligible,
       count(*) FILTER (WHERE t = '') AS n_empty FROM b GROUP BY 1""")
def boilerplate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that may be boilerplate, and lines that normalisation leaves empty."""
    rows = clean.with_repeats(clean.prepared(q._line_elements(spark, sf_dir).filter("kind = 'text'"), exact=False), exact=False)
    return rows.groupBy("document_id").agg(F.count_if(clean.eligible(exact=False)).alias("n_eligible"), F.count_if(F.col("clean_text") == "").alias("n_empty"))


_CLAUSE = r"regexp_matches(line, '(?i)^\s*(?:section\s+)?\d+(?:\.\d+)+\b')"
_BLOCKS = f"""{_LINES}, u AS (SELECT *, {_CLAUSE} OR row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 AS f FROM l WHERE {_BLANK.format("line")}),
k AS (SELECT doc_id, i, line, sum(f::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM u)"""


@registered(f"WITH {_BLOCKS} SELECT doc_id::VARCHAR AS document_id, count(*) AS n_units, count(DISTINCT block) AS n_blocks FROM k GROUP BY 1")
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunkable units, and the blocks that chunks may span."""
    e = q._line_elements(spark, sf_dir).filter("kind = 'text'").withColumn("domain", F.lit("legal"))
    return chunk.blocks(e, CHUNKINGS["fixed_256"]).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_distinct("block").alias("n_blocks"))


@registered(f"""WITH {_BLOCKS},
w AS (SELECT doc_id, block, i, {q._WS.format("line")} AS ws FROM k), t AS (SELECT doc_id, block, flatten(list(ws ORDER BY i)) AS t, flatten(list(list_transform(ws, lambda x: i) ORDER BY i)) AS e FROM w GROUP BY 1, 2),
n AS (SELECT doc_id, block, t, e, unnest(range(CASE WHEN len(t) <= 256 THEN 1 ELSE 1 + ceil((len(t) - 256) / 224.0)::INT END)) AS win FROM t WHERE len(t) > 0),
c AS (SELECT doc_id, block, win, t[win * 224 + 1 : win * 224 + 256] AS p, e[win * 224 + 1 : win * 224 + 256] AS e, len(t) AS n FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, win) - 1 AS ordinal FROM c)
SELECT doc_id::VARCHAR AS document_id, ordinal::INT AS ordinal, 'chk_' || substr(sha256(doc_id || chr(31) || ordinal || chr(31) || '{CHUNKINGS["fixed_256"].fingerprint}' || chr(31) || array_to_string(p, ' ')), 1, 32) AS chunk_id,
       len(p)::INT AS token_count, CASE WHEN win = 0 THEN 0 ELSE least(32, n - win * 224) END::INT AS overlap_tokens, len(list_distinct(e))::INT AS n_elements, (list_min(e) // 10 + 1)::INT AS first_page, (list_max(e) // 10 + 1)::INT AS last_page FROM o""")
def block_chunk_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of blocks with their ids and where their words come from."""
    c = q.block_chunks(spark, sf_dir)
    return c.select("document_id", F.col("ordinal").cast("int").alias("ordinal"), "chunk_id", "token_count", "overlap_tokens", F.size("element_ids").alias("n_elements"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"))


_TABLE = f"""o AS (SELECT o_custkey, list_sort(list(o_orderkey || chr(9) || o_orderpriority || chr(9) || o_orderstatus)) AS r FROM orders GROUP BY 1),
t AS (SELECT o_custkey, r, list_transform(r, lambda x: len({q._WS.format("x")})) AS c FROM o)"""
_GROUPS = """,
g AS (SELECT o_custkey, 1 AS i, 0 AS grp, 3 + c[1] AS used FROM big
  UNION ALL SELECT g.o_custkey, i + 1, CASE WHEN used + c[i + 1] > 16 THEN grp + 1 ELSE grp END, CASE WHEN used + c[i + 1] > 16 THEN 3 + c[i + 1] ELSE used + c[i + 1] END FROM g JOIN big USING (o_custkey) WHERE i < len(c))"""
SQL["table_chunks"] = f"""WITH RECURSIVE {_TABLE}, big AS (SELECT * FROM t WHERE 3 + list_sum(c) > 16) {_GROUPS}
SELECT o_custkey::VARCHAR AS document_id, 0 AS ordinal, 0 AS "group", 'key' || chr(9) || 'priority' || chr(9) || 'status' || chr(10) || array_to_string(r, chr(10)) AS text, (3 + list_sum(c))::INT AS token_count, 0 AS row_start, (1 + len(r))::INT AS row_end, false AS repeated_header, false AS oversized
FROM t WHERE 3 + list_sum(c) <= 16
UNION ALL SELECT o_custkey::VARCHAR, 0, grp, 'key' || chr(9) || 'priority' || chr(9) || 'status' || chr(10) || string_agg(r[i], chr(10) ORDER BY i), (3 + sum(c[i]))::INT, min(i)::INT, (max(i) + 1)::INT, grp > 0, 3 + sum(c[i]) > 16 AND count(*) = 1 FROM g JOIN big USING (o_custkey) GROUP BY o_custkey, grp"""


@registered(f"WITH {_TABLE}, n AS (SELECT 3 + list_sum(c) AS n FROM t) SELECT count(*) AS tables, count(*) FILTER (WHERE n > 16) AS fragmented, round(count(*) FILTER (WHERE n > 16) / count(*), 6) AS rate FROM n")
def table_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that plain windows cut to pieces."""
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus"))).alias("r"))
    t = rows.select("o_custkey", F.array_join(F.concat(F.array(F.lit("key\tpriority\tstatus")), "r"), "\n").alias("text"))
    cut = chunk.fixed_chunks(t, "o_custkey", "text", Chunking("fixed_16", 16, 0))
    return chunk.fragmentation(cut.select(F.col("o_custkey").alias("element_id"), F.struct("o_custkey", "ordinal").alias("chunk_id"), F.lit(False).alias("row_group"))).withColumn("rate", F.round("rate", 6))


@registered(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+([A-Z0-9\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, max(length(trim(s, ' ')))::INT AS longest FROM s WHERE trim(s, ' ') <> '' GROUP BY 1""")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("s")).alias("longest"))


@registered(f"""WITH {TABLES}, c AS ({" UNION ALL ".join(map(q._strategy_sql, (256, 512)))}), s AS (SELECT strategy, domain, count(*) AS chunks, sum(token_count) AS tokens FROM c WHERE domain <> 'legal' GROUP BY 1, 2),
d AS (SELECT DISTINCT strategy, unnest(['financial', 'legal', 'research']) AS domain FROM c)
SELECT strategy, domain, coalesce(chunks, 0) AS chunks FROM d LEFT JOIN s USING (strategy, domain)""")
def ablation_of_empty_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every domain appears, also one without chunks."""
    parts = [chunk.fixed_chunks(corpus_table(spark, sf_dir), "chunk_id", "text", CHUNKINGS[f"fixed_{n}"]).select(F.lit(f"fixed_{n}").alias("strategy"), domain("chunk_id").alias("domain"), "token_count", "overlap_tokens") for n in (256, 512)]
    return chunk.ablation(reduce(DataFrame.unionByName, parts).filter("domain <> 'legal'")).select("strategy", "domain", "chunks")


# -- retrieval

_ALLOWED = f"(query_id % 2 <> 0 OR c.domain = {q._DAYS}[query_id % 3 + 1]) AND source_date >= DATE '2024-02-01' AND (query_id % 3 <> 0 OR source_date <= DATE '2024-10-01')"


@registered(f"WITH {TABLES} SELECT query_id, count(c.chunk_id) AS n FROM questions LEFT JOIN corpus c ON {_ALLOWED} GROUP BY 1")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each query's filters leave."""
    return retrieve.filtered_counts(corpus_table(spark, sf_dir), filtered_questions(spark, sf_dir).drop("document_id"))


@registered(f"""WITH {TABLES} SELECT query_id, 'dates_reversed' AS rule FROM questions WHERE query_id % 5 = 0
UNION ALL SELECT query_id, 'blank_question' FROM questions WHERE query_id % 7 = 0""")
def query_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = filtered_questions(spark, sf_dir)
    asked = asked.withColumns({"date_to": F.when(F.col("query_id") % 5 == 0, F.lit("2024-01-15").cast("date")), "question": F.when(F.col("query_id") % 7 == 0, " \t").otherwise(F.col("question"))})
    return retrieve.query_violations(asked)


@registered("""SELECT vec_id AS chunk_id, 2::BIGINT AS versions FROM embeddings WHERE vec_id % 29 = 0""")
def identity_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that two branches give different contents."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    other = v.withColumn("label", F.when(F.col("chunk_id") % 29 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return retrieve.collisions(v, other, payload=("label",))


@registered(f"""WITH {TABLES} SELECT query_id, 'duplicate_index' AS rule FROM questions WHERE query_id % 6 = 0 UNION ALL SELECT query_id, 'index_out_of_range' FROM questions WHERE query_id % 4 = 0""")
def rerank_index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's answers that name candidates twice or beyond the last."""
    asked = questions(spark, sf_dir).select("query_id")
    n = F.col("query_id")
    given = asked.select("query_id", F.explode(F.array(F.lit(0), F.when(n % 6 == 0, 0).otherwise(1), F.when(n % 4 == 0, 5).otherwise(2))).alias("index"))
    return retrieve.index_violations(given, asked.withColumn("n", F.lit(5)))


_HASHED = """h_{0} AS (SELECT {1} AS k, sha256(w) AS h FROM (SELECT {1}, unnest({2}) AS w FROM {3})),
b_{0} AS (SELECT k, (('0x' || substr(h, 1, 4))::INT % 64)::INT AS bucket, sum(CASE WHEN ('0x' || substr(h, 5, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS s FROM h_{0} GROUP BY 1, 2),
v_{0} AS (SELECT k, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY k)) AS v FROM b_{0} WHERE s <> 0)"""
_RULES = ", ".join(f"('{k}', {p}, '{' '.join(e.split())}')" for k, p, e in q.RULES)
_EXPANDED = rf"""rules(key, position, expansion) AS (VALUES {_RULES}),
xh AS (SELECT query_id, key, position, expansion, lower(expansion) AS name FROM plainq JOIN rules ON contains(replace(lower(question), 'ß', 'ss'), key) WHERE lower(expansion) <> trim(lower(question))),
xf AS (SELECT query_id, name, arg_min(expansion, (key, position)) AS expansion, min((key, position)) AS o FROM xh GROUP BY 1, 2),
xr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS r FROM xf),
xx AS (SELECT query_id, string_agg(expansion, ' ' ORDER BY r) AS s FROM xr WHERE r <= 3 GROUP BY 1),
questions AS (SELECT query_id, trim(regexp_replace(question, '\s+', ' ', 'g')) || coalesce(' ' || s, '') AS question FROM plainq LEFT JOIN xx USING (query_id))"""


def _hybrid_sql(where: str = "") -> str:
    tables = TABLES.replace("questions AS", "plainq AS")
    fold = "replace(lower({}), 'ß', 'ss')"
    return f"""WITH {tables}, {_EXPANDED}, {q._INDEX}, {q._scores("plain", where=where)},
{_HASHED.format("c", "chunk_id", q._WS.format(fold.format("text")), "corpus")}, {_HASHED.format("q", "query_id", q._WS.format(fold.format("question")), "questions")},
sims AS (SELECT v_q.k AS query_id, v_c.k AS chunk_id, sum(v_q.v * v_c.v) AS score FROM v_q JOIN v_c USING (bucket) GROUP BY 1, 2),
every AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT k AS query_id FROM v_q) CROSS JOIN (SELECT DISTINCT k AS chunk_id FROM v_c) LEFT JOIN sims USING (query_id, chunk_id) {where}),
near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM every),
d AS (SELECT * FROM near WHERE rank <= 20), s AS (SELECT * FROM plain WHERE rank <= 20),
b AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score FROM d FULL JOIN s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, least(dense_rank, sparse_rank), chunk_id) AS rank FROM b)
SELECT query_id, chunk_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, round(score, 9) AS score, rank::INT AS rank FROM r WHERE rank <= 20"""


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(q.RULES, "key string, position int, expansion string")


def _fused(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", "dense_rank", "sparse_rank", F.round("score", 9).alias("score"), "rank")


@registered(_hybrid_sql())
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded questions, by hash embeddings and BM25, fused: one operator."""
    return _fused(retrieve.HybridSearch.build(corpus_table(spark, sf_dir), _rules(spark)).search(questions(spark, sf_dir)))


@registered(_hybrid_sql(f"JOIN corpus c USING (chunk_id) WHERE {_ALLOWED}"))
def hybrid_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, both branches under each query's filters."""
    return _fused(retrieve.HybridSearch.build(corpus_table(spark, sf_dir), _rules(spark)).search(filtered_questions(spark, sf_dir)))


@registered("""SELECT vec_id AS chunk_id, 'dimension' AS rule FROM embeddings WHERE vec_id % 31 = 0 UNION ALL SELECT vec_id, 'not_finite' FROM embeddings WHERE vec_id % 37 = 0
UNION ALL SELECT vec_id, 'missing' FROM embeddings WHERE vec_id % 41 = 0 AND vec_id % 31 <> 0 AND vec_id % 37 <> 0""")
def vector_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    n, size = F.col("chunk_id"), len(v.first().vector)
    odd = F.when(n % 37 == 0, F.transform("vector", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("vector"))
    bad = v.withColumn("vector", F.when(n % 31 == 0, F.concat(odd, F.array(F.lit(0.0)))).otherwise(odd)).filter((n % 41 != 0) | (n % 31 == 0) | (n % 37 == 0))
    return dense.vector_violations(bad, size, v.select("chunk_id"))


@registered("""SELECT vec_id AS chunk_id, vec_id % 50 AS document_id, CASE WHEN vec_id % 50 < 5 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 50 >= 5 OR vec_id % 3 = 0""")
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose vectors are replaced: what they had is gone, also where the new rows are fewer."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 50).alias("document_id"), "label")
    new = v.filter("document_id < 5 and chunk_id % 3 = 0").withColumn("label", F.lit(-1))
    return dense.replace_documents(v, new, v.filter("document_id < 5").select("document_id").distinct())


_CUES = " OR ".join(f"contains(replace(lower(text), 'ß', 'ss'), {_literal(c)})" for c in RELATION_CUES)


@registered(rf"""SELECT item_id AS query_id, ({_CUES}) AS needs_second_hop, len(regexp_extract_all('See Section 4.' || item_id || ', clause 7-b and ' || text, '{REFERENCE}'))::INT AS n_references FROM benchmark""")
def reference_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions ask for a relation, and the references in their texts."""
    asked = questions(spark, sf_dir)
    text = F.concat(F.lit("See Section 4."), F.col("query_id").cast("string"), F.lit(", clause 7-b and "), "question")
    return asked.select("query_id", hybrid.needs_second_hop(F.col("question")).alias("needs_second_hop"), F.size(F.regexp_extract_all(text, F.lit(REFERENCE), 0)).alias("n_references"))


# -- answers

_SMALL = f"trim(regexp_replace(trim(regexp_replace(replace(lower(t), 'ß', 'ss'), '\\s+', ' ', 'g')), '[^a-z ]+', '', 'g')) IN ({', '.join(map(_literal, SMALL_TALK))})"
_REFUSED = " OR ".join(f"contains(replace(lower(t), 'ß', 'ss'), {_literal(p)})" for p in REFUSALS)


@registered(rf"""WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Thank  you!' WHEN 1 THEN text || ' insufficient Context' ELSE text END AS t FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, NOT ({_SMALL}) AS retrieval_required, ({_REFUSED}) AS refusal FROM c""")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that need retrieval, and those that refuse."""
    c = read(spark, sf_dir, "conversations").filter("text is not null")
    t = F.when(F.col("turn") % 4 == 0, "Thank  you!").when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" insufficient Context"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", (~is_small_talk(t)).alias("retrieval_required"), generate.is_refusal(t).alias("refusal"))


_TOP = f"""{q._BASE}, c AS (SELECT query_id, chunk_id, rank, replace(lower(question), 'ß', 'ss') AS q, replace(lower(text), 'ß', 'ss') AS t, text FROM plain JOIN questions USING (query_id) JOIN corpus USING (chunk_id) WHERE rank <= 20),
sc AS (SELECT query_id, chunk_id, rank, text, 0.001 * len(list_intersect(list_distinct({q._WS.format("q")}), list_distinct({q._WS.format("t")}))) AS score FROM c),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank, chunk_id) AS final FROM sc)"""


@registered(f"""{_TOP}, a AS (SELECT query_id, chunk_id, trim(text, ' ') AS t FROM top WHERE final = 1)
SELECT query_id, sha256(coalesce(t, {_literal(answer.REFUSAL)})) AS answer_sha256, coalesce(chunk_id::VARCHAR, '') AS cited, chunk_id IS NULL AS insufficient_context, CASE WHEN chunk_id IS NOT NULL AND ({_REFUSED}) THEN 'refusing_answer' ELSE '' END AS errors FROM questions LEFT JOIN a USING (query_id)""")
def answer_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions through the whole service with its deterministic generator; the context has room for any first chunk."""
    texts = corpus_table(spark, sf_dir).select("chunk_id", "document_id", "text", F.to_json(F.struct("document_id", "domain")).alias("metadata"))
    index = sparse.build(corpus_table(spark, sf_dir))
    service = answer.AnswerService(lambda x: sparse.search(index, x, 20), texts, context=Context(max_context_tokens=1_000_000))
    out = service.answers(questions(spark, sf_dir))
    return out.select("query_id", F.sha2(F.col("answer").cast("binary"), 256).alias("answer_sha256"), F.array_join("cited_chunk_ids", ",").alias("cited"), "insufficient_context", F.array_join("errors", ",").alias("errors"))


SQL["grounded_answers"] = f"""{_TOP}, a AS (SELECT query_id, chunk_id, trim(text, ' ') AS t FROM top WHERE final = 1)
SELECT query_id, sha256(coalesce(t, {_literal(answer.REFUSAL)})) AS answer_sha256, coalesce(chunk_id::VARCHAR, '') AS cited, chunk_id IS NULL AS insufficient_context, CASE WHEN chunk_id IS NOT NULL AND ({_REFUSED}) THEN 'refusing_answer' ELSE '' END AS errors FROM questions LEFT JOIN a USING (query_id)"""


@registered(r"""WITH r AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
SELECT doc_id AS query_id, CASE k WHEN 0 THEN 'malformed' WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'unknown_citation' WHEN 4 THEN 'no_citation' WHEN 5 THEN 'blank_answer' ELSE '' END AS errors,
       CASE WHEN k IN (3, 6) THEN 1 ELSE 0 END::INT AS n_cited FROM r""")
def answer_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a generator that break the form or the rules."""
    n = F.col("doc_id")
    cite = lambda c: F.concat(F.lit('"citations":[{"chunk_id":"'), c, F.lit('","claim":"x"}],"insufficient_context":false}'))
    own = n.cast("string")
    kinds = [
        F.lit("not json"), F.lit('{"answer":"a","citations":[],"insufficient_context":false,"note":1}'), F.lit('{"answer":"a","citations":[]}'), F.concat(F.lit('{"answer":"a",'), cite(F.lit("other"))), F.lit('{"answer":"a","citations":[],"insufficient_context":false}'),
        F.lit('{"answer":" ","citations":[],"insufficient_context":true}'), F.concat(F.lit('{"answer":"a",'), cite(own)), F.lit('{"answer":"There is not enough evidence.","citations":[],"insufficient_context":true}'),
    ]
    replies = read(spark, sf_dir, "documents").select(n.alias("query_id"), F.element_at(F.array(*kinds), (n % 8 + 1).cast("int")).alias("reply"), F.array(own).alias("allowed"))
    return answer.checked(replies).select("query_id", F.array_join("errors", ",").alias("errors"), F.size("cited_chunk_ids").alias("n_cited"))


@registered("""SELECT doc_id AS query_id, 'ok ' || doc_id AS answer, doc_id % 3 = 0 AS repaired FROM documents""")
def answer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies without a citation are asked for once more and then have one."""
    n = F.col("doc_id").cast("string")
    asked = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.concat(F.when(F.col("doc_id") % 3 == 0, "#forget").otherwise("#cite"), F.lit(" "), n).alias("prompt"), F.array(n).alias("allowed"))
    name = lambda p: F.regexp_extract(p, r"^#\w+ (\d+)", 1)
    cites = lambda p: p.startswith("#cite") | p.contains("Correct it")
    generator = lambda p: F.concat(F.lit('{"answer":"ok '), name(p), F.lit('","citations":['), F.when(cites(p), F.concat(F.lit('{"chunk_id":"'), name(p), F.lit('","claim":"c"}'))).otherwise(""), F.lit('],"insufficient_context":false}'))
    return answer.generated(asked, generator).select("query_id", "answer", "repaired")


def _block(chunk_id: Column, text: Column) -> Column:
    meta = F.to_json(F.struct(F.col("document_id"), F.col("domain"), F.col("relative_path"), F.col("source_date"), F.col("split")))
    return F.concat(F.lit('[CONTEXT_CHUNK id="'), chunk_id, F.lit('" rank="1" document_id="'), F.col("document_id").cast("string"), F.lit('" truncated="false"]\nSOURCE_METADATA: '), meta, F.lit("\nCONTENT:\n"), text, F.lit("\n[/CONTEXT_CHUNK]"))


@registered(f"""WITH {TABLES}, b AS (SELECT chunk_id, '[CONTEXT_CHUNK id="' || chunk_id || '" rank="1" document_id="' || document_id || '" truncated="false"]' || chr(10) || 'SOURCE_METADATA: ' ||
  '{{"document_id":' || document_id || ',"domain":"' || domain || '","relative_path":"' || relative_path || '","source_date":"' || source_date || '","split":"' || split || '"}}' || chr(10) || 'CONTENT:' || chr(10) || text || chr(10) || '[/CONTEXT_CHUNK]' AS b FROM corpus)
SELECT chunk_id, sha256(b) AS block_sha256, len({q._WS.format("b")})::INT AS n_tokens FROM b""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk as a context of its own: metadata, block and token count."""
    c = corpus_table(spark, sf_dir).withColumns({"query_id": F.col("chunk_id"), "rank": F.lit(1), "pre_rank": F.lit(1), "metadata": F.to_json(F.struct("document_id", "domain", "relative_path", "source_date", "split"))})
    got = generate.assemble(c, Context(max_context_tokens=10_000_000))
    return got.select(F.col("query_id").cast("long").alias("chunk_id"), F.sha2(F.col("rendered").cast("binary"), 256).alias("block_sha256"), F.col("token_count").alias("n_tokens"))


# -- evaluation and runs


@registered(q.SQL["failure_taxonomy"].replace("SELECT example_id, CASE WHEN len(c) = 0 THEN 'unknown' ELSE array_to_string(c, ',') END AS categories FROM c WHERE len(c) > 0 OR worst < 1", "SELECT category, count(*) AS n FROM (SELECT unnest(CASE WHEN len(c) = 0 THEN ['unknown'] ELSE c END) AS category FROM c WHERE len(c) > 0 OR worst < 1) GROUP BY 1"))
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failure_histogram(q.failure_taxonomy(spark, sf_dir).select("example_id", F.split("categories", ",").alias("categories")))


@registered(f"""{q._EVAL} SELECT metric, count, round(mean_score, 6) AS mean_score FROM m20_slices WHERE domain IS NULL AND (mean_score < 0.8 OR count < 3)""")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall metrics below the floors of a release."""
    return evaluate.gate(evaluate.metric_slices(q._long(q._retrieval(spark, sf_dir)))).select("metric", "count", F.round("mean_score", 6).alias("mean_score"))


@registered("""SELECT * FROM (VALUES ('a', 'passed_below_floor'), ('c', 'failed_without_cause'), ('d', 'metric_missing'), ('e', 'metric_missing')) t(config_id, rule)""")
def release_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases whose verdict their slices contradict."""
    slices = [(c, m, 10, 0.5 if c in "ab" and m == "faithfulness" else 0.9) for c in "abcd" for m in evaluate.METRICS if (c, m) != ("d", "faithfulness")]
    rows = spark.createDataFrame(slices, "config_id string, metric string, count long, mean_score double").withColumn("domain", F.lit(None).cast("string"))
    gates = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", True), ("e", True)], "config_id string, passed boolean")
    return evaluate.release_violations(gates, rows)


@registered("""SELECT 'without_observation' AS rule, item_id::VARCHAR AS key FROM benchmark WHERE item_id % 10 = 0 UNION ALL SELECT 'without_record', item_id::VARCHAR FROM benchmark WHERE item_id % 9 = 0 AND item_id % 10 <> 0
UNION ALL SELECT 'duplicate_observation', item_id::VARCHAR FROM benchmark WHERE item_id % 8 = 0 AND item_id % 10 <> 0 UNION ALL SELECT 'other_question', item_id::VARCHAR FROM benchmark WHERE item_id % 7 = 0 AND item_id % 10 <> 0 AND item_id % 9 <> 0""")
def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why records and observations can't be evaluated together."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("example_id"), F.col("text").alias("question"))
    n = F.col("example_id")
    seen = b.filter(n % 10 != 0).withColumn("question", F.when(n % 7 == 0, "another").otherwise(F.col("question")))
    return evaluate.observation_violations(b.filter(n % 9 != 0).unionByName(b.filter((n % 9 == 0) & (n % 10 == 0))), seen.unionByName(seen.filter(n % 8 == 0)))


@registered("""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'unknown_field' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'score_out_of_range' WHEN 4 THEN 'unknown_verdict' END AS judge_error, CASE WHEN doc_id % 7 > 4 THEN 0.5::DOUBLE END AS score FROM documents""")
def judge_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of a judge in strict form."""
    said = ["[", '{"score":0.5,"verdict":"supported","rationale":"r","x":1}', '{"score":0.5,"verdict":"supported"}', '{"score":1.5,"verdict":"supported","rationale":"r"}', '{"score":0.5,"verdict":"maybe","rationale":"r"}', '{"score":0.5,"verdict":"supported","rationale":"r"}', '{"score":0.5,"verdict":"irrelevant","rationale":""}']
    rows = read(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % 7 + 1).cast("int")).alias("o"))
    return rows.withColumns(evaluate.judgement(F.col("o"))).select("doc_id", "judge_error", F.when(F.col("judge_error").isNull(), F.col("score")).alias("score"))


@registered(f"""WITH {q._PAIRS}, c AS (SELECT DISTINCT example_id, question, trim(c) AS claim FROM (SELECT example_id, question, unnest(string_split(regexp_replace(trim(answer), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS c FROM p) WHERE trim(c) <> ''),
n AS (SELECT example_id, trim(regexp_replace(lower(claim), '\\s+', ' ', 'g')) AS claim, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS q FROM c),
s AS (SELECT example_id, CASE WHEN contains(q, claim) THEN 1.0 WHEN len({q._JTOK.format("claim")}) > 0 AND len(list_intersect({q._JTOK.format("claim")}, {q._JTOK.format("q")})) / len({q._JTOK.format("claim")}) >= 0.5 THEN 0.5 ELSE 0.0 END AS score FROM n),
f AS (SELECT example_id, avg(score) AS f FROM s GROUP BY 1),
e AS (SELECT example_id, {q._DAYS}[example_id % 3 + 1] AS domain, CASE WHEN example_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS context_precision, 1.0 AS context_recall, coalesce(f, 0.0) AS faithfulness,
  CASE WHEN len({q._JTOK.format("answer")}) = 0 OR len({q._JTOK.format("question")}) = 0 THEN 0.0 ELSE len(list_intersect({q._JTOK.format("answer")}, {q._JTOK.format("question")})) / len({q._JTOK.format("question")}) END AS answer_relevancy FROM p LEFT JOIN f USING (example_id)),
m AS (SELECT example_id, domain, unnest(['context_precision', 'context_recall', 'faithfulness', 'answer_relevancy', 'hallucination']) AS metric, unnest([context_precision, context_recall, faithfulness, answer_relevancy, (faithfulness < 0.8)::INT]) AS score FROM e)
SELECT metric, domain, count(*) AS count, round(avg(score), 6) AS mean_score FROM m GROUP BY GROUPING SETS ((metric), (metric, domain))""")
def evaluation_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and observations to metrics to slices: turns judged by the turn before as their context."""
    p = q._turn_pairs(spark, sf_dir)
    n = F.col("example_id")
    own = F.array(n.cast("string"))
    rec = p.select("example_id", "question", F.lit("").alias("reference_answer"), domain("example_id").alias("domain"), own.alias("supporting_chunk_ids"))
    obs = p.select("example_id", F.when(n % 2 == 0, F.array(n.cast("string"), F.lit("other"))).otherwise(own).alias("retrieved_chunk_ids"), "answer", F.array().cast("array<string>").alias("citation_claims"), F.lit(False).alias("insufficient_context"))
    out = evaluate.evaluate(rec, obs, p.select("example_id", F.col("example_id").alias("chunk_id"), F.col("question").alias("text")))
    return evaluate.metric_slices(evaluate.long_metrics(out)).withColumn("mean_score", F.round("mean_score", 6))


@registered("""SELECT config_id, item_id AS example_id, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM benchmark CROSS JOIN (VALUES ('dense'), ('hybrid')) c(config_id)""")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which a third fails at first, made again from its checkpoints."""
    configs = spark.createDataFrame([("dense", "c1"), ("hybrid", "c2")], "config_id string, config_fingerprint string")
    examples = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("example_id"), F.lit("d").alias("dataset_fingerprint"))
    path = shared_folder(spark, "run")
    made = lambda todo, attempt: todo.filter((F.col("example_id") % 3 != 0) | F.lit(attempt > 1)).withColumn("observation", F.lit("{}"))
    done = run.resume(configs, examples, made, path)
    return done.select("config_id", "example_id", "attempts")


@registered("""SELECT config_id, item_id AS example_id FROM benchmark CROSS JOIN (VALUES ('dense'), ('hybrid')) c(config_id) WHERE NOT (config_id = 'dense' AND item_id % 2 = 0)""")
def pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = spark.createDataFrame([("dense", "c1"), ("hybrid", "c2")], "config_id string, config_fingerprint string")
    examples = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("example_id"), F.lit("d").alias("dataset_fingerprint"))
    done = examples.filter("example_id % 2 = 0").select(F.lit("dense").alias("config_id"), "example_id", "dataset_fingerprint", F.lit("c1").alias("config_fingerprint"))
    return evaluate.pending(configs, examples, done)


@registered(f"""WITH {TABLES} SELECT query_id AS example_id, sha256(question) AS question_sha256, {q._DAYS}[query_id % 3 + 1] AS domain, query_id || '|' || (query_id + 1) AS supporting_document_ids, CASE WHEN query_id % 2 = 0 THEN 'true' ELSE 'false' END AS table_parsing_required FROM questions""")
def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records through their JSON lines, checked as they are read, to the reviewers' CSV and back."""
    n = F.col("query_id")
    rows = questions(spark, sf_dir).select(
        n.cast("string").alias("example_id"), F.sha2(F.col("question").cast("binary"), 256).alias("question"), F.lit("a").alias("reference_answer"), domain("query_id").alias("domain"), F.array(n.cast("string"), (n + 1).cast("string")).alias("supporting_document_ids"),
        F.array(n.cast("string")).alias("supporting_chunk_ids"), F.array(F.lit("t")).alias("tags"), (n % 2 == 0).alias("table_parsing_required"), F.lit("evaluation").alias("split"), F.lit("approved").alias("reviewer_status"), F.lit("r").alias("reviewer"), F.lit("f").alias("corpus_fingerprint"),
    )
    path = shared_folder(spark, "records")
    records.write_jsonl(rows, f"{path}/jsonl")
    records.write_review_csv(records.read_jsonl(spark, f"{path}/jsonl"), f"{path}/csv")
    back = spark.read.option("header", True).csv(f"{path}/csv")
    return back.select(F.col("example_id").cast("long").alias("example_id"), F.col("question").alias("question_sha256"), "domain", "supporting_document_ids", "table_parsing_required")


@registered("""SELECT 'top' || item_id % 3 AS config_id, count(*) AS n, CASE WHEN item_id % 3 = 1 THEN 2 ELSE 1 END AS version FROM benchmark GROUP BY 1, 3""")
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by configuration; a run that is written again replaces its own only."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("top"), (F.col("item_id") % 3).cast("string")).alias("config_id"), F.lit(1).alias("version"))
    path = shared_folder(spark, "runs")
    records.write_runs(rows, path)
    records.write_runs(rows.filter("config_id = 'top1'").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("config_id", "version").agg(F.count(F.lit(1)).alias("n"))


@registered("""SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1""")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key, as a tracker's log is read."""
    return corpus.latest(read(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id")


# -- observation


@registered(f"""WITH b(le, low) AS (VALUES {", ".join(f"({float(b)}::DOUBLE, {float(a)}::DOUBLE)" for a, b in zip((0.0, *observe.BUCKETS), observe.BUCKETS))}, (NULL, {observe.BUCKETS[-1]}::DOUBLE)),
c AS (SELECT event_type, le, low, count(*) FILTER (WHERE le IS NULL OR abs(value) <= le) AS c, count(*) AS total FROM events CROSS JOIN b GROUP BY 1, 2, 3),
p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY event_type ORDER BY low), 0) AS below FROM c)
SELECT event_type, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (0.95 * total - below) / (c - below) END, 6) AS p95 FROM p WHERE c >= 0.95 * total AND below < 0.95 * total""")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95 % quantile as a dashboard gets it from buckets."""
    h = observe.histogram(read(spark, sf_dir, "events").withColumn("latency", F.abs("value")), ["event_type"], "latency")
    return observe.bucket_quantile(h, ["event_type"], 0.95).select("event_type", F.round("quantile", 6).alias("p95"))


@registered("""WITH w AS (SELECT (floor(epoch(ts))::BIGINT // 300 * 300) AS window_start, count(*) FILTER (WHERE event_id % 3 = 0) AS hits, count(*) AS n FROM events GROUP BY 1) SELECT window_start, hits, round(hits / greatest(n, 1e-9), 6) AS ratio FROM w""")
def hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits of all lookups in windows of five minutes."""
    out = observe.hit_ratio(read(spark, sf_dir, "events").withColumn("hit", F.col("event_id") % 3 == 0), "hit")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "hits", F.round("ratio", 6).alias("ratio"))


@registered("""SELECT event_type, count(*) AS requests, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 9) AS per_second FROM events GROUP BY 1""")
def load_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run.load_evidence(read(spark, sf_dir, "events"), ["event_type"])
    return out.select("event_type", "requests", F.round("seconds", 6).alias("seconds"), F.round("per_second", 9).alias("per_second"))


@registered("""SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1""")
def bounded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(observe.bounded_label(F.col("event_type"), ("click", "view")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@registered("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id DESC) AS r FROM events), e AS (SELECT * FROM r WHERE r <= 500),
a AS (SELECT count(value) FILTER (WHERE event_id % 2 = 0) AS b, avg(value) FILTER (WHERE event_id % 2 = 0) AS bm, count(value) FILTER (WHERE event_id % 2 = 1) AS c, avg(value) FILTER (WHERE event_id % 2 = 1) AS cm FROM e)
SELECT b AS baseline_count, c AS current_count, round(abs(cm - bm) / greatest(abs(bm), 1e-12), 6) AS relative_mean_shift FROM a""")
def bounded_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift over the latest 500 samples of each side."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("current").alias("side"), "value")
    return observe.drift(e, Drift(max_samples=500), order="event_id").select("baseline_count", "current_count", F.round("relative_mean_shift", 6).alias("relative_mean_shift"))


@registered("""SELECT conv_id, turn, sha256('{"filters":null,"question":"' || sha256(coalesce(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '')) || '"}') AS cache_key FROM conversations""".replace("\\\\", "\\"))
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a question in the query cache: of its normalised form."""
    asked = F.sha2(F.coalesce(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), F.lit("")).cast("binary"), 256)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", observe.cache_key(F.struct(F.lit(None).cast("string").alias("filters"), asked.alias("question"))).alias("cache_key"))


@registered(r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'call api_key=[REDACTED] done' WHEN 1 THEN 'Authorization: [REDACTED]' ELSE 'plain ' || event_id END AS message FROM events""")
def log_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("call api_key=s"), n, F.lit(" done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Authorization: t"), n)).otherwise(F.concat(F.lit("plain "), n))
    return read(spark, sf_dir, "events").select("event_id", observe.without_secrets(said).alias("message"))


@registered("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, t, t AS first, 1 AS k FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - w.first >= 86400000000 THEN e.t ELSE w.first END, CASE WHEN e.t - w.first >= 86400000000 THEN 1 ELSE k + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, count(*) FILTER (WHERE k <= 2) AS n_allowed, count(*) FILTER (WHERE k > 2) AS n_refused FROM w GROUP BY 1""")
def rate_limit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that begin with a key's first request after the last window's end."""
    out = observe.rate_limited_exact(read(spark, sf_dir, "events"), limit=2, seconds=86400, order="event_id")
    return out.groupBy("user_id").agg(F.count_if("allowed").alias("n_allowed"), F.count_if(~F.col("allowed")).alias("n_refused"))
