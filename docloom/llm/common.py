"""What the operators of this subpackage share: the shared work folder, word splitting, hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these six: space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: What str.split() takes as space too, though it belongs to words here.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: At most this many keys are ever called hot, so that their table may be broadcast.
MAX_HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents; one that is read in fewer tasks than half the cores is dealt out to all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if 2 * docs.rdd.getNumPartitions() <= cores else docs


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir. A local session that names none (tests) gets a temporary folder; on a cluster that is an error, since machines would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    alone = re.match(r"local($|\[)", spark.sparkContext.master)
    if not base:
        if not alone:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if alone and base.startswith("/"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"


def staged(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df as a table written in the shared folder: cuts lineage, outlives any executor."""
    path = work_dir(df.sparkSession)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not when the driver happens to collect garbage."""
    spark.sparkContext._jvm.System.gc()


def join_by_key(rows: DataFrame, keys: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left join keys on key, where keys has one row a key and weight says how many of the rows share it.

    A key with over a MAX_HOT-th of all rows is hot. There are at most MAX_HOT of
    them, whatever the data, so they are broadcast and their rows stay where they
    are; the other keys are joined by sort-merge, in balanced tasks. A null key
    finds nothing.
    """
    total = keys.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.col(weight) * MAX_HOT > F.lit(total)
    names = [c for c in keys.columns if c != key]
    first = rows.join(F.broadcast(keys.filter(hot).select(key, F.struct(*names).alias("_hot"))), key, "left")
    cold = keys.filter(~hot).select(key, F.struct(*names).alias("_cold"))
    # rows that are settled get a null key: a left join need not bring them together
    first = first.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)))
    both = first.join(cold.withColumnRenamed(key, "_key").hint("merge"), "_key", "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*rows.columns, *(found[c].alias(c) for c in names))


def split_words(text: str) -> list[str]:
    """The words of a text, exactly as WORD finds them."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not _ODD_SPACE.search(text):
        return text.split()
    return _WORD.findall(text)


class WordHashes:
    """64-bit hashes of words; remembers up to limit of them."""

    def __init__(self, limit: int = 400_000) -> None:
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive values; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * np.uint64(_BASE) + words[i : i + m]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with few bytes of text (or one document), with their texts; null texts are empty. When all are done, memory goes back to the system."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            before = int(upto[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(start, end - start), [x or "" for x in texts.slice(start, end - start).to_pylist()]
            start = end
    tidy()


def tidy() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, beside those of the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def table(schema: str) -> Callable[[dict], pa.RecordBatch]:
    """Makes record batches of a schema given as 'name type, ...' with types long, int, string, boolean, double, binary."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    fields = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])
    return lambda values: pa.RecordBatch.from_arrays([values[f.name] if isinstance(values[f.name], pa.Array) and values[f.name].type == f.type else pa.array(values[f.name], f.type) for f in fields], schema=fields)


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text with each run of white space replaced by one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256))
