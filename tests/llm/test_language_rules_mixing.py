import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import language_id, mixing, quality_rules
from docloom.llm.common import documents, split_words
from tests.llm.test_exact_and_tokens import ROWS, SCHEMA
from tests.oracle import assert_same


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in documents(spark, sf_dir).collect()}
    got = language_id.query(spark, sf_dir).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert sum(r.rejected for r in got) <= 0.05 * len(got)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS + [(20, "12 34 !", "en", "s", 1)], SCHEMA).withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[9].lang_pred == got[4].lang_pred == got[20].lang_pred == "und" and got[20].score == 0 and got[20].rejected
    assert got[5].lang_pred in ("en", "de", "fr") and not got[None].held_out
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs.limit(0)).collect() == []
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({9, 4, 7, 20})


@pytest.mark.parametrize("n", [1, 4, 64, 65, 67, 125, 126, 1000])
def test_every_letter_of_an_unspaced_text_counts(n):
    rng = random.Random(n)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    grams = lambda x: {x[i : i + k] for k in (1, 2, 3, 4) for i in range(len(x) - k + 1)}
    words = language_id.tokens(text)
    assert set().union(*map(grams, words)) == grams(text) and max(map(len, words)) <= 64
    assert {zlib.crc32(g.encode()) % 65536 for g in grams(text)} <= {b for w in words for b in language_id.subwords(w, 65536)}
    assert language_id.tokens("One,two/three_four 5six7 --") == ["one", "two", "three", "four", "six"]


def test_unspaced_text_is_read_to_its_end():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice(c) for _ in range(5)) for _ in range(20)) for c in ("abcd", "wxyz") * 40]
    model = language_id.train(texts, ["a", "w"] * 40)
    text = "".join(rng.choice("abcd") for _ in range(70)) + "".join(rng.choice("wxyz") for _ in range(700))
    assert model.scores([text])[0].argmax() == 1


def test_ngrams_by_brute_force():
    for w in ("a", "ab", "hello", "éàß", "漢字😀x", "ĳ" * 9):
        b = f"<{w}>"
        want = [b[i : i + n] for n in (1, 2, 3, 4) for i in range(len(b) - n + 1) if b[i : i + n] not in ("<", ">")] + [b] * (len(b) > 4)
        assert sorted(language_id.subwords(w, 65536)) == sorted(zlib.crc32(g.encode()) % 65536 for g in want)


def test_digits_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "\u00b2 \u00bd", None), (2, "\u2167 \u2462", None), (3, "un mot", "fr"), (4, "a word", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert got[1] == got[2] == "und" and {got[3], got[4]} <= {"fr", "en"}


def test_the_sample_is_bounded_whatever_repeats(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    same = spark.range(20_000).select(F.lit(one).cast("long").alias("doc_id"), F.lit("one and the same").alias("text"), F.lit("en").alias("lang"))
    none = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("fr").alias("lang"))
    few = spark.createDataFrame([(i, f"wort {i}", "de") for i in range(60)], "doc_id long, text string, lang string")
    params = language_id.Params(max_rows=400)
    got = language_id.sampled(same.unionByName(none).unionByName(few), params).groupBy("lang").count().collect()
    counts = {r.lang: r["count"] for r in got}
    assert counts["en"] == counts["fr"] == 133 and 0 < counts["de"] <= 60
    again = language_id.sampled(few.unionByName(none).unionByName(same).repartition(7), params)
    assert {r.text for r in again.filter("lang = 'fr'").collect()} == {r.text for r in language_id.sampled(none.unionByName(same).unionByName(few), params).filter("lang = 'fr'").collect()}
    assert len(language_id.sampled(few, language_id.Params(max_langs=0)).collect()) == 0


def brute_rules(text):
    w = split_words(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    rows = ROWS[:-1] + [(30, "a b c a b c\n# x\n# x\n\n \n", "en", "s", 1), (31, "a b a b a b", "en", "s", 1), (32, "b c", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit(1), "n": F.lit(2), "rate": F.lit(3), "_host": F.lit(4)})
    got = quality_rules.judged(docs).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    want = sorted(((d, *brute_rules(t)) for d, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
    assert all(r.base_failed and not r.kept for r in got)  # all are short
    assert {r.host for r in got} == {"s", "t", None}
    assert quality_rules.judged(docs.limit(0)).collect() == []


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "en", "spam", 1) for i in range(40)] + [(100 + i, good, "en", "spam", 1) for i in range(5)] + [(200 + i, good, "en", f"h{i % 4}", 1) for i in range(80)] + [(300, "short", "en", "h1", 1), (301, "short", "en", "tiny", 1)]
    kept = {r.doc_id for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA)).filter("kept").collect()}
    assert kept == set(range(200, 280))


def test_rules_sql(spark, sf_dir):
    assert_same(quality_rules.query(spark, sf_dir), sf_dir, quality_rules.SQL)


def test_targets():
    sizes = {"a": 100, "b": 1000, "c": 50, "z": 0}
    t = mixing.targets(sizes, {"a": 5, "b": 2, "c": 1, "z": 5}, 1150)
    assert t["a"] == 300 and t["c"] == 150 and t["b"] == pytest.approx(700) and t["z"] == 0
    assert sum(t.values()) == pytest.approx(1150)


def test_flow_of_overlapping_sources():
    patterns = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    f = mixing.flow(patterns, {"a": 100, "b": 110})
    assert sum(v for (p, s), v in f.items() if s == "a") == 100 and sum(v for (p, s), v in f.items() if s == "b") == 110
    # the shared documents serve b once rather than b's own ones ten times
    assert f[("a", "b"), "b"] == 100 and f[("a",), "a"] == 100 and f[("b",), "b"] == 10
    assert sum(mixing.flow({("a",): 10}, {"a": 1000}).values()) == 30


def test_nearest_sum_passes_over_a_very_long_document():
    rng = random.Random(10)
    sizes = [rng.randint(450, 550) for _ in range(300)]
    for at in (0, 10, 150, 299):
        part = sizes[:at] + [200_000] + sizes[at:]
        for need in (140_000, 100_000, 700, 0):
            got = mixing.nearest_sum(part, need)
            assert len(got) == 301 and abs(sum(n for n, t in zip(part, got) if t) - need) <= (0 if need > 1000 else 300)
    assert mixing.nearest_sum([0, 200], 190) == [False, True] and mixing.nearest_sum([], 5) == []


def test_nearest_sum_of_few_by_brute_force():
    rng = random.Random(11)
    for _ in range(200):
        sizes = [rng.choice((1, 10, 100)) * rng.randint(0, 20) for _ in range(rng.randint(0, 9))]
        need = rng.randint(0, 1 + sum(sizes))
        best = min(abs(sum(n for i, n in enumerate(sizes) if m >> i & 1) - need) for m in range(1 << len(sizes)))
        assert abs(sum(n for n, t in zip(sizes, mixing.nearest_sum(sizes, need)) if t) - need) == best


def test_mix_by_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in documents(spark, sf_dir).collect()}
    got = mixing.query(spark, sf_dir).collect()
    size = {d: len(split_words(r.text or "")) for d, r in rows.items()}
    names = sorted({r.source for r in rows.values()}, key=lambda s: (s is None, (s or "").encode()))
    by = {s: sum(size[d] for d, r in rows.items() if r.source == s) for s in names}
    want = mixing.targets(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(by.values()))
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = rows[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == by[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows)
    for s in names:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], min((size[d] for d, r in rows.items() if r.source == s and size[d]), default=0))
    again = mixing.mix(documents(spark, sf_dir).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("size", "pattern", "h", "rounds", "range", "copies", "row", "id")})
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and {tuple(r.sources) for r in got} == {("s",), (None,), ("t",)}
    assert all(r.taken == 0 for r in got if r.size == 0)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []


def test_mix_large_pattern_uses_ranges(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "big" if i % 10 else "small", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 7 for r in got)


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(6)
    rows = [(rng.choice((None, 1, 2, 3, i)), "w " * rng.randint(0, 9) + str(rng.randint(0, 3)), "en", rng.choice("abc"), 1) for i in range(300)]
    rows += [(5, "x y z", "en", "a", 1)] * 200
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for parts in (1, 3, 8):
        got = mixing.mix(docs.repartition(parts)).collect()
        seen.append(sorted((str(r.doc_id), r.size, r.sources, r.copies) for r in got))
        out = mixing.mixed(docs.repartition(parts))
        assert out.count() == sum(r.copies for r in got)
    assert seen[0] == seen[1] == seen[2]
    with pytest.raises(ValueError):
        mixing.mix(docs, max_patterns=2)
