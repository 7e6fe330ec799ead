"""python -m docloom.cli: the library's steps from files to files."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.config import CHUNKINGS, Cleaning, Sparse
from docloom.errors import DocloomError
from docloom.operators import chunk, clean, evaluate, manifest, sparse
from docloom.sources import loaders, records


def scan(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = loaders.scan_corpus(spark, a.source, a.strict)
    manifest.write(docs.drop("content"), a.target)


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = manifest.subset(loaders.scan_corpus(spark, a.source), a.domain, a.split)
    elements = loaders.parse(docs)
    elements.write.mode("overwrite").parquet(f"{a.target}/all")
    elements = spark.read.parquet(f"{a.target}/all")
    loaders.failures(elements, a.max_failures).write.mode("overwrite").json(f"{a.target}/failures")
    loaders.with_element_ids(elements).join(docs.select("document_id", "domain"), "document_id").write.mode("overwrite").parquet(f"{a.target}/elements")


def cut(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = clean.clean(spark.read.parquet(f"{a.source}/elements"), Cleaning()).filter("reason is null")
    rows = rows.withColumns({"text": F.col("clean_text"), "ordinal": F.col("clean_ordinal"), "element_id": F.col("clean_id")})
    chunk.chunks(rows, CHUNKINGS[a.strategy]).write.mode("overwrite").parquet(a.target)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    sparse.build(spark.read.parquet(a.source), Sparse(variant=a.variant)).write(a.target)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    found = sparse.SparseIndex.read(spark, a.source, check=True)
    asked = spark.createDataFrame([(0, a.question)], "query_id long, question string")
    for r in sparse.top_k(sparse.scores(found, asked), a.top_k).orderBy("rank").collect():
        print(f"{r['rank']}\t{r.chunk_id}\t{r.score:.6f}")


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    slices = evaluate.metric_slices(spark.read.parquet(a.source))
    print({"markdown": records.report_markdown, "html": records.report_html, "json": records.report_json}[a.format](slices), end="")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom")
    steps = top.add_subparsers(required=True)

    def step(f, *files: str) -> argparse.ArgumentParser:
        p = steps.add_parser(f.__name__)
        p.set_defaults(run=f)
        for x in files:
            p.add_argument(x)
        return p

    step(scan, "source", "target").add_argument("--strict", action="store_true", help="an unsupported file is an error")
    p = step(parse, "source", "target")
    p.add_argument("--domain")
    p.add_argument("--split")
    p.add_argument("--max-failures", type=int)
    step(cut, "source", "target").add_argument("--strategy", choices=sorted(CHUNKINGS), default="fixed_256")
    step(index, "source", "target").add_argument("--variant", choices=("bm25", "bm25_plus"), default="bm25")
    p = step(search, "source", "question")
    p.add_argument("--top-k", type=int, default=10)
    step(report, "source").add_argument("--format", choices=("markdown", "html", "json"), default="markdown")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        a.run(spark or SparkSession.builder.appName("docloom").getOrCreate(), a)
    except (DocloomError, PySparkException) as e:
        print(f"{type(e).__name__}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
