"""Token ids in compressed binary files: written in order of documents, read back by Spark."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import documents, slices, staged, table, work_dir
from docloom.llm.encoders import encoder, tokenizer_file
from docloom.llm.range_coder import read_ids, write_ids

SUFFIX = ".dltok"
MANIFEST = "file string, task int, part int, n_docs long, n_tokens long"
READ = "file string, doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Size of the table of documents (4 bytes), its CRC-32, the table (zlib: ids, whether they are null, lengths), then range_coder.write_ids()."""
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    docs = zlib.compress(docs)
    return np.array([len(docs), zlib.crc32(docs)], "<u4").tobytes() + docs + write_ids(ids)


def unpack_file(data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """doc_ids, lengths and all ids of a file; ValueError if it is damaged."""
    size, crc = np.frombuffer(data, "<u4", 2).tolist() if len(data) >= 8 else (0, 1)
    docs = data[8 : 8 + size]
    if zlib.crc32(docs) != crc:
        raise ValueError("the table of documents is damaged")
    docs = zlib.decompress(docs)
    n = len(docs) // 13
    names, null, lengths = np.frombuffer(docs, "<i8", n).tolist(), np.frombuffer(docs, "u1", n, 8 * n), np.frombuffer(docs, "<u4", n, 9 * n).tolist()
    ids = read_ids(data[8 + size :])
    if sum(lengths) != len(ids):
        raise ValueError("documents and ids don't agree")
    return [None if x else k for k, x in zip(names, null)], lengths, ids


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_tokens: int = 8_000_000, tasks: int | None = None) -> DataFrame:
    """Writes the ids of all rows (doc_id, text) in order of doc_id to files in folder (a URI that pyarrow opens) and returns their MANIFEST.

    A document is the library's ids without special tokens, then end_id; a null text
    is empty; rows of equal doc_id follow one another in the order of their texts; null
    doc_ids come first. A document lies in one file; a file is closed at file_tokens.
    Files appear under their names only when whole, and a task that runs again writes
    the same names with the same bytes. One shuffle, by ranges of doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        enc, out = encoder(tokenizer), table(MANIFEST)
        task, part = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, parts, size, part
            data = pack_file(names, [len(x) for x in parts], np.concatenate(parts))
            name = f"{task:06d}-{part:06d}{SUFFIX}"
            part += 1
            store.create_dir(path, recursive=True)
            draft = f"{path}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(data)
            store.move(draft, f"{path}/{name}")
            row = out({"file": [name], "task": [task], "part": [part - 1], "n_docs": [len(names)], "n_tokens": [size]})
            names, parts, size = [], [], 0
            return row

        for batch, texts in slices(batches, most=8_000_000):
            ids, n = enc.encode_flat(texts)
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, np.uint32(end_id))
            ends += np.arange(1, len(n) + 1)
            for name, begin, end in zip(batch.column(0).to_pylist(), (ends - n - 1).tolist(), ends.tolist()):
                names.append(name)
                parts.append(ids[begin:end])
                size += end - begin
                if size >= file_tokens:
                    yield flush()
        if names:
            yield flush()
        enc.forget()

    if "://" not in folder:
        raise ValueError("folder must be a URI, so that Spark and pyarrow mean the same place")
    tasks = tasks or max(1, docs.rdd.getNumPartitions())
    rows = docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(rows.mapInArrow(run, MANIFEST))


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files.

    Every checksum is checked, and the files against the manifest: a file that is missing,
    that has another number of documents or that the manifest lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = table(READ)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, lengths, ids = unpack_file(data.as_py())
                ends = np.cumsum(np.array(lengths, np.int64))
                starts, raw = ends - np.array(lengths, np.int64), memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield out({"file": [name] * len(names), "doc_id": names, "start": starts, "n_tokens": lengths, "ids_crc32": crcs})

    if manifest.isEmpty():  # there is no folder then
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    found = staged(found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, READ))
    known = manifest.select("file", F.col("n_docs").alias("want")).join(found.groupBy("file").agg(F.count(F.lit(1)).alias("have")), "file", "full")
    wrong = [r.file for r in known.filter("not (want <=> have)").select("file").orderBy("file").limit(5).collect()]
    if wrong:
        raise ValueError(f"token files that differ from their manifest: {', '.join(wrong)}")
    # sums over tasks (a row each), then over the files of a task
    upto = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n")).select("task", upto(Window.orderBy("task"), "n").alias("first"))
    files = manifest.withColumn("inside", upto(Window.partitionBy("task").orderBy("part"), "n_tokens")).join(tasks, "task")
    starts = files.select("file", (F.col("first") + F.col("inside")).alias("before"))
    return found.join(starts, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark)
    manifest = write(documents(spark, sf_dir), folder, tokenizer_file("word_bpe_49k.json"))
    return read(spark, folder, manifest)
