import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup, near_dedup, substring_dedup
from docloom.llm.common import documents, split_words
from docloom.llm.components import components
from tests.llm.test_exact_and_tokens import ROWS, SCHEMA


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def frame(spark, texts, clash=True):
    df = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("node", "band", "label", "n", "first", "_drop", "row", "hits")}) if clash else df


def test_dart_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    k = 2000
    for size, shared in ((40, 30), (2000, 1500), (2, 1)):
        e = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
        s = near_dedup.dart_signatures(np.concatenate([e[:size], e[size - shared :]]), None, np.array([0, size, 2 * size]), k)
        assert abs((s[0] == s[1]).mean() - shared / (2 * size - shared)) < 0.05
    e = rng.integers(0, 2**63, 5, dtype=np.uint64)
    a, b = np.array([0.5, 2.25, 1, 3, 0.1]), np.array([1.5, 1.25, 1, 2, 0.4])
    s = near_dedup.dart_signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.array([0, 5, 10]), k)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05
    assert (near_dedup.dart_signatures(e, None, np.array([0, 0, 5]), 10)[0] == 0).all()


def brute_classes(texts, n=5, least=0.8):
    """Classes by comparing all pairs."""
    sets = []  # bags: a shingle's k-th occurrence is an element
    for _, t in texts:
        w = split_words(t or "")
        bag = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter({tuple(w)} - {()})
        sets.append({(g, k) for g, times in bag.items() for k in range(times)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (union == 0) or 10 * len(sets[i] & sets[j]) >= 10 * least * union:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(texts):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(texts)}


def edited(rng, w, k):
    w = list(w)
    for i in rng.sample(range(len(w)), k):
        w[i] = "zz" + str(rng.randint(0, 9999))
    return w


def test_near_classes(spark):
    rng = random.Random(1)
    texts = [(100, ""), (101, None), (102, " \n"), (103, "one two"), (104, "one  two"), (105, "one three")]
    d = 200
    for g in range(12):
        base = words(rng, 120)
        for k in (0, 0, 1, 2, 3):  # copies, and edits that lie on both sides of the threshold
            texts.append((d, " ".join(edited(rng, base, k))))
            d += 1
        chain = base
        for _ in range(4):  # each like the one before, not like the first
            chain = edited(rng, chain, 2)
            texts.append((d, " ".join(chain)))
            d += 1
    rng.shuffle(texts)
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.near_classes(frame(spark, texts)).collect()}
    want = brute_classes(texts)
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] == (k == v[0]) for k, v in got.items())
    kept = near_dedup.deduplicated(frame(spark, texts + [(None, "x"), (None, "x")]))
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(set(want.values()))
    assert kept.filter("doc_id is null").count() == 2 and kept.columns[:2] == ["doc_id", "text"]


def test_mixed_buckets_are_searched_to_the_end(spark):
    """With bands of one row, buckets hold many classes: links must still all be found."""
    rng = random.Random(5)
    shared = words(rng, 60)
    texts = []
    for g in range(10):
        own = words(rng, 60)
        texts += [(10 * g, " ".join(shared + own)), (10 * g + 1, " ".join(shared + edited(rng, own, 1)))]
    got = {r.doc_id: r.class_id for f in (1,) for r in near_dedup.near_classes(frame(spark, texts), bands=40, rows=1, firsts=f).collect()}
    assert got == brute_classes(texts)


def test_near_classes_of_nothing_and_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_classes(empty).collect() == []
    got = near_dedup.near_classes(spark.createDataFrame(ROWS, SCHEMA)).collect()
    by = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(ROWS) and by[9] == by[4] == by[7] == 4 and by[5] == by[3] == 3 and by[None] == 3


def test_texts_that_share_a_doc_id_in_any_order(spark):
    rng = random.Random(9)
    base, other = words(rng, 80), words(rng, 80)
    rows = [(2, " ".join(base)), (2, " ".join(other)), (1, " ".join(edited(rng, other, 1))), (3, " ".join(edited(rng, base, 1))), (None, " ".join(base)), (3, " ".join(other)), (7, "la " * 9 + "lu"), (8, "la " * 40 + "lu")]
    rows += [(9, " ".join(base))] * 30
    seen = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = near_dedup.near_classes(frame(spark, order).repartition(3)).collect()
        seen.append(sorted((str(r.doc_id), r.class_id, r.kept) for r in got))
    assert seen[0] == seen[1] == seen[2]
    want = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])
    low = {}
    for i, (d, _) in enumerate(rows):
        low[want[i]] = min((x for x in (low.get(want[i]), d) if x is not None), default=None)
    assert seen[0] == sorted((str(d), low[want[i]], d == low[want[i]]) for i, (d, _) in enumerate(rows))
    assert {r.class_id for r in near_dedup.near_classes(frame(spark, rows)).filter("doc_id in (7, 8)").collect()} == {7, 8}  # the same shingles, other weights


def test_whole_weights_are_layers():
    e = np.array([5, 9, 11], np.uint64)
    x, y = near_dedup.layered(e, np.array([3, 1, 2])), near_dedup.layered(e, np.array([1, 1, 4]))
    assert len(x) == 6 and len(np.intersect1d(x, y)) == 1 + 1 + 2


def test_near_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert {r.doc_id: r.class_id for r in near_dedup.query(spark, sf_dir).collect()} == brute_classes(texts)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200 + i, 201 + i) for i in range(30)]
    root = {x: x for ab in links for x in ab}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in ab and ab[0] != ab[1] for ab in links)}


def brute_passages(rows, window=20):
    seen, out = {}, []
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = split_words(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen and seen[key] != (d, s):
                gone[s : s + window] = [True] * window
            seen.setdefault(key, (d, s))
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    for d, t in rows:
        if d is None:
            w = split_words(t or "")
            out.append((None, len(w), 0, hashlib.sha256(" ".join(w).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [50_000, 3])
def test_passages(spark, group):
    rng = random.Random(3)
    common, texts = words(rng, 35), []
    for d in range(40):
        w = words(rng, rng.randint(0, 80))
        if d % 3 == 0:
            at = rng.randint(0, len(w))
            a, b = sorted((rng.randint(0, 35), rng.randint(0, 35)))
            w = w[:at] + common[a : b + 10] + w[at:]
        if d % 7 == 0:
            w = w + w[-25:]
        if d % 5 == 0:
            w += ["la"] * rng.randint(0, 60)
        texts.append((d, " ".join(w)))
    texts += [(50, texts[6][1]), (51, texts[6][1]), (60, None), (61, ""), (None, texts[6][1]), (70, "x\x1cy  z " * 30)]
    found = substring_dedup.deduplicated(frame(spark, texts), group).collect()
    got = sorted((tuple(r)[:4] for r in found), key=repr)
    assert got == brute_passages(texts)
    by = dict(texts[:-2])
    for r in found:
        assert sum(x.after - x["first"] for x in r.spans) == r.n_removed
        if r.doc_id in by:
            gone = {i for x in r.spans for i in range(x["first"], x.after)}
            assert hashlib.sha256(" ".join(w for i, w in enumerate(split_words(by[r.doc_id] or "")) if i not in gone).encode()).hexdigest() == r.kept_sha256


def test_passages_query_and_nothing(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert sorted((tuple(r) for r in substring_dedup.query(spark, sf_dir).collect()), key=repr) == brute_passages(texts)
    assert substring_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines(spark):
    body = "the quick brown fox jumps over the lazy dog near the river"
    texts = [
        (1, "first own line\nAll rights reserved.\n\nOrder 17 shipped on 2024-01-02 to the usual place by the usual carrier today"),
        (2, f"second own line\n  All rights  reserved. \n\n{body}\nrepeated here\nrepeated here"),
        (3, "Order 99 shipped on 2023-11-30 to the usual place by the usual carrier today\n" + body.replace("lazy", "idle")),
        (4, None), (5, ""), (None, "All rights reserved."), (6, "the quick brown cat sat down there without any thought of rivers at all ok"),
    ]
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(frame(spark, texts)).collect()}
    assert got[1] == texts[0][1]  # the first document of each template keeps it
    assert got[2] == f"second own line\n\n{body}\nrepeated here\nrepeated here"
    assert got[3] == ""  # digits and one word vary within their templates
    assert (got[4], got[5], got[None], got[6]) == (None, "", "All rights reserved.", texts[6][1])
    counts = {r.row.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.report(frame(spark, texts)).collect()}
    assert counts == {1: (3, 0), 2: (5, 1), 3: (2, 2), 4: (0, 0), 5: (0, 0), None: (1, 0), 6: (1, 0)}
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_exactly_repeated_lines_go(spark, sf_dir):
    """Brute force over short lines, whose templates are exact: all but the first document lose them."""
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    mask = lambda line: tuple("<*>" if any(c in "0123456789" for c in t) else t for t in split_words(line))
    first = {}
    for d, t in sorted(texts.items()):
        for line in t.split("\n"):
            first.setdefault(mask(line), d)
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(documents(spark, sf_dir), least_tokens=10**6).collect()}
    assert got == {d: "\n".join(x for x in t.split("\n") if not mask(x) or first[mask(x)] == d) for d, t in texts.items()}


def brute_templates(lines, similarity=0.8, leading=3):
    """line: template and first, trying all heads of a leaf in turn, the commonest first; lines: (doc_id, hash, tokens with digits masked)."""
    docs, about = {}, {}
    for d, line, tokens in lines:
        docs.setdefault(line, []).append(d)
        about[line] = tokens
    of, heads = {}, {}
    for line in sorted(about, key=lambda x: (len(docs[x]), x), reverse=True):
        tokens = about[line]
        known = heads.setdefault((len(tokens), *tokens[:leading]), [])
        fits = [h for h in known if sum(x == y for x, y in zip(about[h], tokens)) >= similarity * len(tokens)]
        of[line] = fits[0] if fits else line
        if not fits:
            known.append(line)
    found = {}
    for line, t in of.items():
        found.setdefault(t, set()).update(docs[line])
    return {line: (t, min(found[t])) for line, t in of.items() if len(found[t]) > 1}


def masked(line):
    return tuple("<*>" if any(c in "0123456789" for c in t) else t for t in split_words(line))


def brute_line_drops(spark, docs, keep_first=True):
    """Positions that each document loses, by brute force over the lines' tokens; the library only gives lines' hashes, which order ties."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.doc_id, r.pos, r.line, masked(texts[r.doc_id].split("\n")[r.pos])) for r in line_dedup.parsed(docs).collect()]
    assert {(d, p) for d, p, _, _ in rows} == {(d, p) for d, t in texts.items() for p, x in enumerate((t or "").split("\n")) if masked(x)}
    assert len({x for *_, x in rows}) == len({h for _, _, h, _ in rows})
    of = brute_templates([(d, h, x) for d, _, h, x in rows])
    out = {}
    for d, p, h, _ in rows:
        if h in of and not (keep_first and of[h][1] == d):
            out.setdefault(d, set()).add(p)
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in out.get(d, ())) if t is not None else None for d, t in texts.items()}


@pytest.mark.parametrize("keep_first", [True, False])
def test_line_query_by_brute_force(spark, sf_dir, keep_first):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs, keep_first=keep_first).collect()}
    assert got == brute_line_drops(spark, docs, keep_first)
    if keep_first:
        shas = {r.doc_id: (r.kept_sha256, r.n_lines, r.n_lines - r.n_dropped) for r in line_dedup.query(spark, sf_dir).collect()}
        texts = {r.doc_id: r.text for r in docs.collect()}
        count = lambda t: sum(bool(masked(x)) for x in t.split("\n"))
        assert shas == {d: (hashlib.sha256(t.encode()).hexdigest(), count(texts[d]), count(t)) for d, t in got.items()}


def test_families_ties_repeats_and_long_lines(spark):
    rng = random.Random(8)
    rows, d = [], 0
    long = words(rng, 6000)
    for family in range(6):
        base = ["log", "of", "the"] + words(rng, 9 if family < 5 else 3)
        for _ in range(4):
            rows.append((d, "\n".join([" ".join(edited(rng, base, 0)[:-1] + words(rng, 1)), f"own {words(rng, 3)}", "a b c d", f"at {d} o'clock", " ".join(["see", "also", "page", *words(rng, 1), "now"])])))
            d += 1
    rows += [(d, " ".join(long)), (d + 1, " ".join(edited(rng, long, 900))), (d + 2, " ".join(edited(rng, long, 1500))), (d + 3, rows[0][1])]
    docs = frame(spark, rows)
    want = brute_line_drops(spark, frame(spark, rows, False))
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()} == want
    assert all(not t.split("\n")[0].startswith("log of the") for i, t in want.items() if i < 24 and i % 4)
    # repeated rows are one document
    again = frame(spark, rows + rows[:3])
    got = [(r.doc_id, r.text) for r in line_dedup.deduplicated(again).collect()]
    assert sorted(got) == sorted([*want.items(), *((i, want[i]) for i in (0, 1, 2))])


def test_all_templates_of_a_leaf_are_tried(spark):
    rng = random.Random(7)
    texts = []
    for size in (8, 11, 25):
        shared = words(rng, 3)
        bases = [shared + words(rng, size - 3) for _ in range(12)]
        bases += [b[: size // 2] + words(rng, size - size // 2) for b in bases[:4]]  # a half alike: same blocks, no match
        for b in bases * 5:
            line = list(b)
            for i in rng.sample(range(3, size), rng.randint(0, max(1, size // 6))):
                line[i] = words(rng, 1)[0]
            texts.append((len(texts), " ".join(line)))
    docs = frame(spark, texts, False)
    lines = line_dedup.parsed(docs)
    want = brute_templates([(r.doc_id, r.line, masked(texts[r.doc_id][1])) for r in lines.collect()])
    got = {r.line: (r.template, r["first"]) for r in line_dedup.templates(lines, docs).collect()}
    assert len({t for t, _ in want.values()}) >= 36 and got == want
