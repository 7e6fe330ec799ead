import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, packing, token_counts, token_files
from docloom.llm.common import documents, split_words, work_dir
from docloom.llm.encoders import _CHUNKS, Encoder, _chunks_of, prove, tokenizer_file, uncommon
from docloom.llm.range_coder import read_ids, write_ids
from tests.oracle import assert_same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLOCK = 4096
#: Nulls, empty and odd texts, ties and repeated rows.
ROWS = [
    (5, "a  b\tc", "en", "s", 1), (3, "a b c", "en", None, 1), (9, None, None, "s", None), (4, "", "en", "s", 0), (7, " ", "en", "s", 1), (7, " ", "en", "s", 1), (None, "a b c", "de", "t", 5),
    (11, "x\x1cy   z", "en", "s", 4), (12, "I'll <|endoftext|> é   \U0001f600 don't", "fr", "s", 9), (13, "word " * 5000, "en", "s", 25000),
]


@pytest.fixture(scope="module")
def docs(spark):
    # clashing names: what the operators add inside must not collide
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("_hot", "digest", "keep_id", "n", "size", "label", "_drop", "copies", "row", "n_lines", "class_id", "host")})


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark, docs):
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, buckets=4)).collect())
    want = []
    for d, t, *_ in ROWS:
        same = [r[0] for r in ROWS if normal(r[1]) == normal(t)]
        keep = min((x for x in same if x is not None), default=None)
        want.append(((d is not None, d or 0), keep, len(same), d == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    assert got == sorted(want)


def test_index_persists(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    exact_dedup.dedup(docs.filter("doc_id in (3, 5)"), index).collect()
    later = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(docs.filter("doc_id in (4, 7, 9) or doc_id is null"), index).collect()}
    assert later == {None: (3, False), 4: (4, True), 9: (4, False), 7: (7, True)}
    assert index.read().count() == 3
    plan = index.new_entries(docs.select(F.unhex(F.sha2("text", 256)).alias("digest")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_batches_through_one_index(spark, docs):
    """Cut anywhere, the result is that of one batch, and the index is that of one call after another."""
    whole = sorted(map(str, exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, buckets=2)).collect()))
    for upto in ((4,), (3, 5, 9), (100,), (-1,)):
        index = exact_dedup.DigestIndex(spark, buckets=2)
        assert sorted(map(str, exact_dedup.dedup(docs, index, upto).collect())) == whole
        assert index.read().count() == index.read().select("digest").distinct().count()
        assert not any(r.kept for r in exact_dedup.dedup(docs, index).collect())
        index.drop()
        assert not spark.catalog.tableExists(index.table)


def test_exact_dedup_of_nothing(spark, docs):
    assert exact_dedup.dedup(docs.limit(0), exact_dedup.DigestIndex(spark, buckets=2)).collect() == []


def test_exact_dedup_sql(spark, sf_dir):
    assert_same(exact_dedup.query(spark, sf_dir), sf_dir, exact_dedup.SQL)


def test_split_words():
    for t in ("", " a\x0bb\x0cc ", "a\x1cb", "a b c", " x y　", "é\x85è"):
        assert split_words(t) == re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(spark, sf_dir, name):
    e = Encoder(tokenizer_file(name), limit=500)  # so small that it forgets again and again
    texts = [r.text or "" for r in documents(spark, sf_dir).select("text").collect()] + [r[1] or "" for r in ROWS] + ["\n\n  a   b \n", "’s 'S 'll", "ǅ ﬁ İ ß ½ ­"]
    for t, x in zip(texts, e.encode(texts)):
        assert np.frombuffer(x, np.uint32).tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_token_counts(docs):
    tok = Encoder(tokenizer_file("word_bpe_49k.json")).tok
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, tokenizer_file("word_bpe_49k.json")).collect())
    want = [(d or 0, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, *_ in ROWS]
    assert got == sorted(want)


def test_token_counts_query(spark, sf_dir):
    tok = Encoder(tokenizer_file("word_bpe_49k.json")).tok
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.query(spark, sf_dir).collect()}
    assert got == {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_proven_words_are_one_token():
    tok = Encoder(tokenizer_file("word_bpe_49k.json")).tok
    some = sorted(prove(tokenizer_file("word_bpe_49k.json")))
    assert len(some) > 20_000
    assert all(len(tok.encode(w, add_special_tokens=False).ids) == 1 for w in some[::97])


def check_pieces(rows, ids_of, capacity=2048):
    """Each id lies in one piece, sequences are gapless and full or a power of two."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        ids = ids_of[d]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(docs):
    tok = Encoder(tokenizer_file("byte_bpe_50k.json")).tok
    unique = docs.filter("doc_id is null or doc_id <> 7")
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in ROWS if d != 7}
    assert check_pieces(packing.packed(unique, tokenizer_file("byte_bpe_50k.json")).collect(), ids) == 0
    assert packing.packed(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).collect() == []
    assert packing.packed(docs.filter("doc_id = 7"), tokenizer_file("byte_bpe_50k.json")).count() == 2


def test_packing_query(spark, sf_dir):
    tok = Encoder(tokenizer_file("byte_bpe_50k.json")).tok
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in documents(spark, sf_dir).collect()}
    assert check_pieces(packing.query(spark, sf_dir).collect(), ids) == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1500, 400).tolist()
    pieces = packing.pack(lengths)
    assert sum(p[2] for p in pieces) == sum(lengths)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + n * n
    full = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 2048]
    in_order, at = {}, 0
    for n in lengths:  # documents simply one after another
        while n:
            k = min(n, 2048 - at % 2048)
            in_order[at // 2048] = in_order.get(at // 2048, 0) + k * k
            at, n = at + k, n - k
    assert np.std(full) < np.std(list(in_order.values()))


@pytest.mark.parametrize("n", [0, 1, 2, BLOCK, BLOCK + 1, 3 * BLOCK - 1])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.zipf(1.2, n) % 49408, np.repeat(rng.integers(0, 65536, n // 50 + 1), 50)[:n], np.full(n, 65535)):
        data = write_ids(ids.astype(np.uint32), BLOCK)
        assert (read_ids(data) == ids).all()


def test_range_coder_many_lanes_and_blocks():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.zipf(1.3, 400_000) % 49408, rng.integers(0, 65536, 30_000), np.tile(np.arange(1000), 200)]).astype(np.uint32)
    assert (read_ids(write_ids(ids)) == ids).all() and (read_ids(write_ids(ids, 250_000)) == ids).all()


def test_range_coder_beats_order_0_and_zlib(spark):
    """On the ids of real text: fewer bits than their static order-0 entropy, and than zlib on 16-bit ids."""
    e = Encoder(tokenizer_file("word_bpe_49k.json"))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(2000).collect()]
    ids = np.frombuffer(b"".join(x + b"\x02\0\0\0" for x in e.encode(texts)), np.uint32)
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    data = write_ids(ids)
    assert (read_ids(data) == ids).all()
    bits = 8 * len(data) / len(ids)
    assert bits < -(n * np.log2(n)).sum() and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_other_tokenizer_files_go_through_the_library(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    tok.save(str(tmp_path / "other.json"))
    got = Encoder(str(tmp_path / "other.json")).encode_one("it is so")
    assert np.frombuffer(got, np.uint32).tolist() == tok.encode("it is so", add_special_tokens=False).ids

def seconds(work):
    """CPU seconds, in the time that this machine takes to add up 5 million numbers; the least of three."""
    took = []
    for _ in range(3):
        start = time.process_time()
        sum(range(5_000_000))
        spin, start = time.process_time() - start, time.process_time()
        out = work()
        took.append((time.process_time() - start) / spin)
    return out, min(took)


def test_range_coder_cost(spark):
    """Writing and reading cost a bounded time an id, in microseconds where a spin takes 0.1 seconds."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(3000).collect()]
    ids = np.frombuffer(b"".join(Encoder(tokenizer_file("word_bpe_49k.json")).encode(texts)), np.uint32)
    data, writing = seconds(lambda: write_ids(ids))
    back, reading = seconds(lambda: read_ids(data))
    assert (back == ids).all()
    assert (writing + reading) / len(ids) * 1e5 < 0.35


def test_range_coder_learns_and_checks():
    ids = np.tile(np.arange(300, dtype=np.uint32) * 7, 200)
    data = write_ids(ids)
    assert len(data) < 0.5 * len(ids)
    for cut in (data[:-1], data[:10], b"", data[:-3] + bytes([data[-3] ^ 1]) + data[-2:]):
        with pytest.raises(ValueError):
            read_ids(cut)
    with pytest.raises(ValueError):
        write_ids(np.array([65536], np.uint32))


def test_encode_flat_is_the_library():
    """Any mixture of plain and other texts, in any order, with few or many remembered pre-tokens."""
    rng = random.Random(3)
    bits = ["word", "Word", "don't", "I'LL", "a,b", "x.", "y,,", "é", "ÀÇ", "œuvre", "Ⱥ", "Ɓ", "12", "3.14", "%%%", "'sab", "a'", ",", "!", "", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x00", "\xa0", "…", "“q”", "ª", "²", "<|endoftext|>", "<|", "日本", "İ", "e\u0301", "\U0001f600", "\u2028", "\x1c", "Σς", "ß"]
    texts = ["", "\x000", "\n", " a", *("".join(rng.choice(bits) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(400))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for limit in (250_000, 5):
            e = Encoder(tokenizer_file(name), limit)
            for part in (texts, texts[:1], texts[1:2], texts[4:90], [""] * 3, ["x\U0001f600"] * 2):
                ids, n = e.encode_flat(part)
                want = [e.tok.encode(t, add_special_tokens=False).ids for t in part]
                assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_encode_flat_merges_a_pre_token_once():
    e = Encoder(tokenizer_file("word_bpe_49k.json"))
    asked, merge = [], e.merge
    e.merge = lambda x: asked.append(x) or merge(x)
    e.encode_flat(["Qzxv, qzxv. qzxv's", "qzxv! \U0001f600", "QZXV qzxv,"])
    e.encode_flat(["qzxv; and qzxv's"])
    assert asked.count("qzxv") == 1


def test_chunks_of_many_texts_are_those_of_each():
    rng = random.Random(7)
    for _ in range(300):
        texts = ["".join(rng.choice("ab.é\n\t\r   ") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 30))]
        chunks, at = _chunks_of(texts)
        assert [chunks[a:b].to_pylist() for a, b in zip(at, at[1:])] == [_CHUNKS.findall(t) for t in texts]


def test_chunks_seen_again_cost_little(spark):
    """Byte-level ids of a chunk that the texts hold again cost a bounded time, in microseconds where a spin takes one second."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(600).collect()]
    path = tokenizer_file("byte_bpe_50k.json")
    (_, n), once = seconds(lambda: Encoder(path).encode_flat(texts))
    _, often = seconds(lambda: Encoder(path).encode_flat(texts * 9))
    assert (often - once) / (8 * n.sum()) * 1e6 < 1


def test_classes_of_letters_agree():
    plain = [c for c in map(chr, range(0x3000)) if not uncommon(c)]
    assert pc.utf8_is_alpha(pa.array(plain)).to_pylist() == [c.isalpha() for c in plain]
    assert [c for c in plain if c.isspace()] == list("\t\n\r ")


def test_token_files(spark, docs):
    folder = work_dir(spark)
    path = tokenizer_file("word_bpe_49k.json")
    tok = Encoder(path).tok
    manifest = token_files.write(docs, folder, path, file_tokens=100, tasks=3)
    got = [tuple(r) for r in token_files.read(spark, folder, manifest).orderBy("start").collect()]
    want, at = [], 0
    for d, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert manifest.count() > 2
    empty = work_dir(spark)
    assert token_files.read(spark, empty, token_files.write(docs.limit(0), empty, path)).collect() == []


def test_token_files_query(spark, sf_dir):
    tok = Encoder(tokenizer_file("word_bpe_49k.json")).tok
    want, at = [], 0
    for r in documents(spark, sf_dir).orderBy("doc_id").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_files.query(spark, sf_dir).collect()) == want


def test_a_missing_or_short_token_file_is_an_error(spark, docs):
    folder = work_dir(spark)
    manifest = token_files.write(docs, folder, tokenizer_file("word_bpe_49k.json"), file_tokens=100, tasks=3)
    name = manifest.orderBy("file").first().file
    path = os.path.join(folder.removeprefix("file://"), name)
    data = open(path, "rb").read()
    os.remove(path)
    with pytest.raises(ValueError, match=name):
        token_files.read(spark, folder, manifest)
    open(path, "wb").write(token_files.pack_file([3], [1], np.array([2], np.uint32)))
    if manifest.filter(F.col("file") == name).first().n_docs != 1:
        with pytest.raises(ValueError, match=name):
            token_files.read(spark, folder, manifest)
    open(path, "wb").write(data[:-5])
    with pytest.raises(Exception, match="cut short|damaged"):
        token_files.read(spark, folder, manifest).collect()
    with pytest.raises(ValueError):
        token_files.write(docs, "/no/scheme", tokenizer_file("word_bpe_49k.json"))
