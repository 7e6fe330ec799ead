"""Line deduplication by a log-template tree.

A line is parsed to a fixed depth: its number of tokens, then its leading tokens,
tokens with a digit standing for any such token. A leaf of this tree holds lines that
agree so far. In a leaf the most common line is a template; lines that agree with it
in enough positions belong to it, and the other positions become its variable fields.
Lines that match none so far try the next most common line, until no two lines of the
leaf that are left could agree; each of those is a template by itself. A template found in several documents is recurring
and stays in the first of them only. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, documents, join_by_key, staged

LEADING, SIMILARITY, ROUNDS = 3, 0.8, 2
_HAS_TOKEN = r"[^\x20\x09-\x0D]"


def _tokens(line: Column) -> Column:
    masked = F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>")
    return F.split(F.regexp_replace(masked, rf"^{SPACE}|{SPACE}$", ""), SPACE)


def _leaf(tokens: Column, leading: int) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, leading))


def _line(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), tokens)


def parsed(docs: DataFrame, leading: int = LEADING) -> DataFrame:
    """A row for each line with a token: doc_id, pos (from 0), leaf and line (hash of its tokens, digits masked)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(_HAS_TOKEN))
    tokens = F.col("tokens")
    return lines.select("doc_id", "pos", _tokens(F.col("line")).alias("tokens")).select("doc_id", "pos", _leaf(tokens, leading).alias("leaf"), _line(tokens).alias("line"))


def coded(docs: DataFrame, wanted: DataFrame, leading: int = LEADING, least_tokens: int = 1) -> DataFrame:
    """code (a 32-bit hash of each token) of the lines wanted (leaf, line, doc_id and pos of one of them) with least_tokens tokens or more: of the few lines whose leaf has others, so that no other line is hashed token by token."""
    need = wanted.groupBy("doc_id").agg(F.collect_list("pos").alias("_need"))
    rows = docs.select("doc_id", "text").join(need.hint("merge"), "doc_id").select("_need", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tokens = F.col("tokens")
    rows = rows.filter(F.array_contains("_need", F.col("pos"))).select(_tokens(F.col("line")).alias("tokens")).filter(F.size(tokens) >= least_tokens)
    rows = rows.select(_leaf(tokens, leading).alias("leaf"), _line(tokens).alias("line"), F.transform(tokens, lambda t: F.xxhash64(t).bitwiseAND(0xFFFFFFFF)).cast("array<long>").alias("code"))
    # rows that repeat a doc_id may have other lines at these places
    return rows.join(wanted.select("leaf", "line"), ["leaf", "line"], "left_semi").dropDuplicates(["leaf", "line"])


def _same(a: Column, b: Column) -> Column:
    """Positions that agree; lines of a leaf have equally many tokens."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _buckets(free: DataFrame, similarity: float, leading: int) -> DataFrame:
    """key, line and n: lines of a leaf that agree share a key. With at most m positions apart, one of m + 1 blocks is the same; keys of a single line are left out."""
    size = F.size("code")
    apart = size - F.ceil(F.lit(similarity) * size).cast("int")
    rows = free.select("leaf", "line", "n", "code", (apart + 1).alias("parts"), F.explode(F.sequence(F.lit(0), apart)).alias("part"))
    at = lambda part: F.floor(part * F.greatest(F.size("code") - leading, F.lit(0)) / F.col("parts")).cast("int")
    block = F.slice(F.col("code"), at(F.col("part")) + leading + 1, at(F.col("part") + 1) - at(F.col("part")))
    rows = staged(rows.select(F.xxhash64("leaf", "part", block).alias("key"), "line", "n"))
    return staged(rows.join(rows.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi"))


def _searched(free: DataFrame, similarity: float, leading: int) -> DataFrame:
    """line and template of each of free's lines that belongs to another one: what trying all heads of a leaf in turn, the commonest first, comes to.

    A line is a head if no commoner line it agrees with is one. In each round the
    first lines of every bucket are held against the rest; a line is settled once it is
    among the first in all its buckets and has no open line before it. The rounds hold
    more lines each time, and end when no line is open.
    """
    buckets, codes = _buckets(free, similarity, leading), free.select("line", "code")
    pair = lambda a, b: F.struct(F.col(f"{a}.n"), F.col(f"{a}.line")) > F.struct(F.col(f"{b}.n"), F.col(f"{b}.line"))

    def agreeing(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(codes.withColumnsRenamed({"line": "lo", "code": "a"}), "lo").join(codes.withColumnsRenamed({"line": "hi", "code": "b"}), "hi")
        return both.filter(_same(F.col("a"), F.col("b")) >= similarity * F.size("a")).drop("a", "b")

    heads, open_, first = None, buckets, 8
    while not open_.isEmpty():
        ranked = staged(open_.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.desc("line")))))
        before = ranked.filter(F.col("r") <= first).select("key", F.col("line").alias("hi"), F.col("r").alias("hi_r"))
        pairs = ranked.join(before, "key").filter("hi_r < r").select(F.col("line").alias("lo"), "hi")
        pairs = staged(agreeing(pairs))
        lines = ranked.groupBy("line").agg(F.max("n").alias("n"), F.max("r").alias("r")).filter(F.col("r") <= first).select("line", "n")
        new = staged(lines.join(pairs.select(F.col("lo").alias("line")), "line", "left_anti"))
        heads = new if heads is None else heads.unionByName(new)
        done = new.select("line").unionByName(pairs.join(new.select(F.col("line").alias("hi")), "hi", "left_semi").select(F.col("lo").alias("line")))
        open_ = staged(open_.join(done.distinct(), "line", "left_anti"))
        first *= 8
    if heads is None:
        return free.select("line", F.col("line").alias("template")).limit(0)
    heads = buckets.join(heads.select("line"), "line", "left_semi")
    rest = buckets.join(heads.select("line").distinct(), "line", "left_anti")
    pairs = rest.alias("lo").join(heads.alias("hi"), F.col("lo.key") == F.col("hi.key")).filter(pair("hi", "lo"))
    found = agreeing(pairs.select(F.col("lo.line").alias("lo"), F.col("hi.line").alias("hi"), F.col("hi.n").alias("n")))
    return staged(found.groupBy(F.col("lo").alias("line")).agg(F.max_by("hi", F.struct("n", "hi")).alias("template")))


def templates(lines: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS, leading: int = LEADING, least_tokens: int = 1) -> DataFrame:
    """line, n (its rows), template and first (its smallest doc_id), for those of docs' lines (see parsed()) whose template is in two documents or more.

    In so many rounds each leaf's commonest line is held against all of the leaf; what
    is left after them is searched to the end by _searched().
    """
    of_line = [F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("low"), F.max("doc_id").alias("high")]
    distinct = staged(lines.groupBy("leaf", "line").agg(*of_line).select("leaf", "line", "n", "low.doc_id", "low.pos", "high"))
    # a line that is alone in its leaf is a template by itself
    shared = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    wanted = staged(join_by_key(distinct.select("leaf", "line", "n", "doc_id", "pos"), staged(shared), "leaf", "k").filter("k is not null"))
    codes = coded(docs, wanted, leading, least_tokens)
    open_ = staged(wanted.select("leaf", "line", "n").join(codes, ["leaf", "line"]))
    known = []
    for _ in range(rounds):
        heads = open_.groupBy("leaf").agg(F.max_by(F.struct("line", "code"), F.struct("n", "line")).alias("head"), F.count(F.lit(1)).alias("k"))
        heads = staged(heads.filter("k > 1"))
        tried = join_by_key(open_, heads, "leaf", "k").filter("k is not null").select("leaf", "line", "n", "code", "head")
        fits = (F.col("line") == F.col("head.line")) | (_same(F.col("code"), F.col("head.code")) >= similarity * F.size("code"))
        tried = staged(tried.withColumn("template", F.when(fits, F.col("head.line"))).drop("head"))
        known.append(tried.filter("template is not null").select("line", "template"))
        open_ = tried.filter("template is null").drop("template")
    known.append(_searched(open_, similarity, leading))
    of = reduce(DataFrame.unionByName, known)
    done = distinct.select("line", "n", F.col("doc_id").alias("low"), "high").join(of, "line", "left").withColumn("template", F.coalesce("template", "line"))
    found = done.groupBy("template").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first <> last").drop("last")
    return staged(done.select("line", "n", "template").join(found, "template"))


def report(docs: DataFrame, keep_first: bool = True, **options) -> DataFrame:
    """row (struct of all of docs' columns), text (without recurring lines), n_lines (with a token) and n_dropped for each row of docs (doc_id, text and any others).

    Lines end at \\n; white space at their ends and between tokens doesn't count. A
    template in several documents (by doc_id) loses its lines in all of them, or (keep_first)
    in all but the document of smallest doc_id, so that no text leaves the corpus
    altogether; lines repeated within one document stay. Lines without a token stay. A
    null text stays null with 0 lines; an empty text stays empty. Rows that repeat a doc_id
    count as one document and lose the same positions; rows without doc_id lose nothing
    and make no line recurring. A line of any length is parsed whole. Lines of 4 tokens
    or less can only agree in all (0.8 of them, rounded up); equally common lines try
    as heads in the order of their hash.
    """
    named = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    lines = staged(parsed(named, options.get("leading", LEADING)))
    found = templates(lines, named, **options)
    # a line's hash is in one row each of line and leaf; lines under one template share its first document
    recurring = found.groupBy("line").agg(F.max("n").alias("n"), F.min("first").alias("first"))
    drop = join_by_key(lines.select("doc_id", "pos", "line"), staged(recurring), "line", "n").filter(F.col("first").isNotNull() & (F.lit(not keep_first) | (F.col("first") != F.col("doc_id"))))
    drop = drop.groupBy("doc_id").agg(F.collect_set("pos").alias("_drop"))
    out = docs.select(F.col("doc_id"), F.struct(*docs.columns).alias("row")).join(drop, "doc_id", "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("_drop", i))
    text = F.when(F.col("_drop").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    n = F.regexp_count("row.text", F.lit(_HAS_TOKEN + r"[^\n]*"))
    return out.select("row", text.alias("text"), F.coalesce(n, F.lit(0)).alias("n_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).alias("n_dropped"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs, all rows and columns, with text as report() leaves it."""
    out = report(docs, **options)
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
