"""Language identification by averaged hashed subword embeddings and a linear softmax.

A document's vector is the mean of the vectors of all character n-grams of its
words, each n-gram hashed to a row of one table; a linear layer and softmax follow.
Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows. A temperature and a rejection threshold are fitted to sampled rows
that training did not see. After training, table and layer are one table of logits by
n-gram bucket, so a word's contribution is a sum that can be remembered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import column, documents, slices, staged, table

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
_STRIP = regex.compile(r"\P{L}+")
#: The longest run of letters that is one word; longer ones (text without spaces) are cut.
RUN = 64


@dataclass(frozen=True)
class Params:
    #: At most so many labelled rows train and calibrate, alike for each language; the bound of what is gathered.
    max_rows: int = 4000
    #: Labels beyond the so many commonest are not learned.
    max_langs: int = 200
    buckets: int = 1 << 16
    dim: int = 16
    epochs: int = 5
    #: A small sample is gone over more often, to so many steps.
    least_steps: int = 6000
    rate: float = 0.5
    seed: int = 4
    #: The share of rightly predicted calibration rows that may be rejected.
    rejected_right: float = 0.0005
    #: Rejection threshold on the calibrated score is never over this.
    max_threshold: float = 0.5


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of 1 to 4 characters of each word, with its borders but not these alone, and of the whole word if that is longer; a bucket is the CRC-32 of the UTF-8 bytes."""
    bordered = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(bordered).encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.array([len(w) for w in bordered], np.int64)
    word = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    left = ends[word] - np.arange(len(code))
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    # the bytes of each character; those after the first carry six bits each
    parts = []
    for k in range(int(size.max(initial=1))):
        shift = (6 * np.maximum(size - 1 - k, 0)).astype(np.uint32)
        lead = np.where(size == 1, 0, np.choose(size - 1, (0, 0xC0, 0xE0, 0xF0))).astype(np.uint32)
        parts.append((code >> shift) | lead if k == 0 else ((code >> shift) & 0x3F) | 0x80)
    state = np.full(len(code), 0xFFFFFFFF, np.uint32)
    owners, found = [], []
    for k in range(4):
        m = len(code) - k
        if m <= 0:
            break
        state = state[:m]
        for j, b in enumerate(parts):
            next_ = _CRC[(state ^ b[k:]) & 0xFF] ^ (state >> np.uint32(8))
            state = next_ if j == 0 else np.where(size[k:] > j, next_, state)
        ok = left[:m] > k
        if k == 0:
            ok &= (left > 1) & (left < n[word])
        owners.append(word[:m][ok])
        found.append(~state[ok] % np.uint32(buckets))
    long = np.flatnonzero(n > 4)
    owners.append(long)
    found.append(np.array([zlib.crc32(bordered[i].encode("utf-8", "surrogatepass")) % buckets for i in long.tolist()], np.uint32))
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of one word's n-grams."""
    return grams([word], buckets)[1].tolist()


def _runs(chunk: str) -> list[str]:
    """The runs of letters of a string without spaces, in chunks of RUN letters that share 3, so that no n-gram is lost."""
    if len(chunk) <= RUN and chunk.isalpha():
        return [chunk]
    out = []
    for x in _STRIP.split(chunk):
        # a last chunk of 3 letters or less is in the one before
        out.extend([x[i : i + RUN] for i in range(0, len(x) - 3, RUN - 3)] if len(x) > RUN else [x] if x else [])
    return out


def tokens(text: str) -> list[str]:
    """Lower-case words: runs of letters (Unicode category L), long ones in chunks."""
    return [x for chunk in text.lower().split() for x in _runs(chunk)]


def bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, and how often each occurs; not over buckets of them, however long the text."""
    count = np.zeros(buckets)
    words = Counter(tokens(text))
    names, times = list(words), np.array(list(words.values()), float)
    for i in range(0, len(names), 5_000):
        owner, found = grams(names[i : i + 5_000], buckets)
        count += np.bincount(found, times[i + owner], buckets)
    ids = np.flatnonzero(count)
    return ids.astype(np.int32), count[ids]


def packed(ids: np.ndarray, n: np.ndarray) -> bytes:
    """A bag for the way to the driver, a few bytes a bucket."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
    return np.cumsum(both[0]).astype(np.int32), both[1]


class Model:
    """langs, logits (buckets x langs), bias, temperature, threshold."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0) -> None:
        self.langs, self.logits, self.bias, self.temperature, self.threshold = langs, np.ascontiguousarray(logits.T), bias, temperature, threshold
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.sums = np.zeros((1 << 12, len(self.langs) + 1))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "chars": 0, "sums": np.zeros((1 << 12, len(self.langs) + 1))}

    def _learn(self, chunks: set[str], limit: int = 200_000, most_chars: int = 8_000_000) -> None:
        """A row for each string without spaces: the sums of its n-grams' logits, and their number."""
        new = chunks.difference(self.known)
        if len(self.known) + len(new) > limit or self.chars > most_chars:
            self._forget()
            new = chunks
        need = len(self.known) + len(new)
        if need > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(len(self.sums), need - len(self.sums)), self.sums.shape[1]))])
        order = sorted(new)
        for i in range(0, len(order), 5_000):
            part = order[i : i + 5_000]
            runs = [_runs(c) for c in part]
            at = len(self.known)
            self.known.update(zip(part, range(at, at + len(part))))
            self.chars += sum(map(len, part))
            words = [x for r in runs for x in r]
            if words:
                owner, found = grams(words, self.logits.shape[1])
                row = np.repeat(np.arange(len(part)), [len(r) for r in runs])[owner]
                for k, of in enumerate(self.logits):
                    self.sums[at : at + len(part), k] = np.bincount(row, of[found], len(part))
                self.sums[at : at + len(part), -1] = np.bincount(row, minlength=len(part))

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        with np.errstate(invalid="ignore"):
            z = np.exp(z - z.max(1, keepdims=True))
            return z / z.sum(1, keepdims=True)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, a row a text; nan for a text without letters."""
        chunks = [t.lower().split() for t in texts]
        self._learn(set().union(*chunks))
        out = np.full((len(texts), len(self.langs)), np.nan)
        for i, c in enumerate(chunks):
            s = self.sums[np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))].sum(0)
            if s[-1]:
                out[i] = s[:-1] / s[-1]
        return self.probabilities(out)


def train(texts: list[str], langs: list[str], params: Params = Params()) -> Model:
    """A model of at least one labelled text."""
    return train_bags([bag(t, params.buckets) for t in texts], langs, params)


def train_bags(counted: list[tuple[np.ndarray, np.ndarray]], langs: list[str], params: Params = Params()) -> Model:
    """A model of the bags of at least one labelled text; one row in five calibrates."""
    names = sorted(set(langs))
    place = {x: k for k, x in enumerate(names)}
    y = np.array([place[x] for x in langs])
    rng = np.random.default_rng(params.seed)
    bags = [(ids, (n / max(1, n.sum())).astype(np.float32)) for ids, n in counted]
    counted.clear()
    used = np.array([k for k, b in enumerate(bags) if len(b[0])], np.int64)
    order = rng.permutation(used)
    held = order[: len(order) // 5] if len(order) >= 50 else order
    fit = order[len(order) // 5 :] if len(order) >= 50 else order
    table_ = rng.normal(0, 1 / params.dim, (params.buckets, params.dim)).astype(np.float32)
    layer, bias = np.zeros((params.dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    epochs = max(params.epochs, -(-params.least_steps // max(1, len(fit))))
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(fit):
            ids, w = bags[k]
            rate = params.rate * (1 - done / steps)
            h = w @ table_[ids]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = layer @ p
            layer -= rate * np.outer(h, p)
            bias -= rate * 0.1 * p
            # rows of frequent n-grams move most; the mean's small weights are scaled up so that rare ones learn too
            table_[ids] -= rate * np.sqrt(w)[:, None] * back
            done += 1
    model = Model(names, (table_ @ layer).astype(np.float64), bias.astype(np.float64))
    if not len(held):
        return model
    means = np.array([model.logits[:, bags[k][0]] @ bags[k][1] for k in held])
    raw = np.log(np.maximum(model.probabilities(means), 1e-300))
    best = (float("inf"), 1.0)
    for t in np.exp(np.linspace(-3, 3, 61)):
        z = raw / t
        z = z - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)) - z.max(1, keepdims=True)
        best = min(best, (-float(z[np.arange(len(held)), y[held]].mean()), float(t)))
    model.temperature = best[1]
    p = model.probabilities(means)
    right = p.max(1)[p.argmax(1) == y[held]]
    if len(right):
        model.threshold = float(min(params.max_threshold, np.quantile(right, params.rejected_right)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """lang, place, doc_id and text of at most params.max_rows labelled rows that are not held out: of each language as many as of others, those whose hash of doc_id and text is smallest.

    Rows are counted by language and by the bits of their hash first, so that only about
    twice the rows that are wanted move; a language that one row repeated without end
    makes up gives no more of them than any other.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(params.seed), "doc_id", "text"), 4)).withColumn("bits", F.length(F.bin("place")))
    counts = staged(rows.groupBy("lang", "bits").count())
    langs = [r.lang for r in counts.groupBy("lang").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "lang").limit(params.max_langs).collect()]
    if not langs:
        return spark.createDataFrame([], "lang string, place long, doc_id long, text string")
    each = max(1, params.max_rows // len(langs))
    upto = F.sum("count").over(Window.partitionBy("lang").orderBy("bits"))
    # at most 60 rows a language
    cuts = counts.filter(F.col("lang").isin(langs)).withColumn("upto", upto).groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= each, F.col("bits"))), F.max("bits")).alias("cut"))
    cut = F.create_map(*(F.lit(x) for r in cuts.collect() for x in (r.lang, r.cut)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    return rows.filter(F.col("bits") <= cut[F.col("lang")]).withColumn("nth", first).filter(F.col("nth") <= each).select("lang", "place", "doc_id", "text")


def fit(docs: DataFrame, params: Params = Params()) -> Model | None:
    """Trains on the rows that sampled() chooses; None without any. Counts and the sample's bags of n-grams (each bounded by params.buckets, whatever the text's length) reach the driver."""

    schema = "lang string, place long, doc_id long, bag binary"

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = table(schema)
        for batch, texts in slices(batches):
            found = [packed(*bag(t, params.buckets)) for t in texts]
            yield out({**{c: column(batch, c) for c in ("lang", "place", "doc_id")}, "bag": found})

    rows = sorted(sampled(docs, params).mapInArrow(bags, schema).collect(), key=lambda r: (r.lang, r.place, r.doc_id is None, r.doc_id or 0))
    langs = [r.lang for r in rows]
    counted = [unpacked(r.bag) for r in rows]
    del rows
    return train_bags(counted, langs, params) if counted else None


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """SCHEMA for each row of docs (doc_id, text, lang).

    lang_pred is a language of the sample, or und (score 0, rejected) for a text that
    is null or has no letter, or if no row has a label. rejected: und, or a calibrated
    score under the model's threshold. Predictions use the whole text and nothing
    else. A null doc_id is not held out. Repeated rows give repeated results.
    """
    model = fit(docs, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = table(SCHEMA)
        for batch, texts in slices(batches):
            named, score, rejected = [], [], []
            p = model.scores(texts) if model else np.full((len(texts), 1), np.nan)
            for t, row in zip(texts, p):
                if np.isnan(row[0]):
                    named.append("und")
                    score.append(0.0)
                    rejected.append(True)
                else:
                    k = int(row.argmax())
                    named.append(model.langs[k])
                    score.append(float(row[k]))
                    rejected.append(bool(row[k] < model.threshold))
            yield out({"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "lang_pred": named, "score": score, "rejected": rejected})

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def accepted(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs that identify() would not reject, all columns as they are. One scan, no shuffle."""
    model = fit(docs, params)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            p = model.scores(texts) if model else np.full((len(texts), 1), np.nan)
            keep = [bool(x == x and x >= model.threshold) for x in p.max(1).tolist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
