"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram of a word has a learned vector in a hashed table, and so
has the pair of a word with itself (one vector for all words, so it also holds for unseen ones). A
document is the mean of all its vectors; a softmax layer over the mean gives the class. Vectors
and layer are trained together by numpy stochastic gradient descent.

Training rows are labelled rows only, and at most ``train_rows`` of them (smallest salted hash of
the id first, so the choice does not depend on order or partitioning); the bound is a parameter
because the model lives in one process. Scoring covers every whole text. The score is linear in
the mean, so a task memoises one number per distinct word.

Defined cases: a null or empty text (or one of white space only) has no vectors; its score is the
model's prior, the share of good training rows. Labels that are null, neither 0 nor 1, or given
twice for a document with different values teach nothing. Without any labelled row every score is
0.5. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import operator
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Names, chunks, documents, raw_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    """``buckets`` hashed vectors of ``dim`` numbers; n-grams of ``shortest`` to ``longest`` bytes.
    ``train_rows`` bounds the labelled rows that the fit reads, ``steps`` its minibatches."""

    buckets: int = 1 << 16
    dim: int = 16
    shortest: int = 3
    longest: int = 3
    steps: int = 800
    rate: float = 0.25
    batch: int = 32
    train_rows: int = 3000
    threshold: float = 0.7
    seed: int = 7


DEFAULT = Settings()


def word_features(word: bytes, s: Settings) -> np.ndarray:
    """Buckets of the word itself and of the n-grams of the word between boundary marks."""
    marked = b"<" + word + b">"
    grams = [b"w" + word] + [marked[i:i + n] for n in range(s.shortest, s.longest + 1)
                             for i in range(len(marked) - n + 1)]
    h = np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64, len(grams))
    return (h & np.uint64(s.buckets - 1)).astype(np.int64)


def again(words: list[bytes]) -> int:
    """Word pairs of a word with itself; all of them share one vector."""
    return sum(map(operator.eq, words, words[1:]))


def again_bucket(s: Settings) -> int:
    return xxhash.xxh3_64_intdigest(b"2 same") & (s.buckets - 1)


def document_features(text: bytes, memo: Names, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its vectors in each."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    own = [memo[w] for w in words]
    bucket, n = np.unique(np.concatenate([*own, np.full(again(words), again_bucket(s))]), return_counts=True)
    return bucket, (n / n.sum()).astype(np.float32)


class Model:
    """Hashed vectors, softmax layer; ``fit`` is plain minibatch descent with a falling rate."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s = s
        self.vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
        self.layer = np.zeros((s.dim, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.prior = 0.5

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> Model:
        s, rng = self.s, np.random.default_rng(self.s.seed + 1)
        use = np.array([i for i, (b, _) in enumerate(rows) if len(b)], np.int64)
        if len(label):
            self.prior = float((label.sum() + 1) / (len(label) + 2))
            self.bias = np.log(np.array([1 - self.prior, self.prior], np.float32))
        step = 0
        while step < s.steps and len(use):
            order = rng.permutation(use)
            for at in range(0, len(order), s.batch):
                rate = s.rate * max(0.0, 1 - step / s.steps)
                step += 1
                pick = order[at:at + s.batch]
                bucket = np.concatenate([rows[i][0] for i in pick])
                share = np.concatenate([rows[i][1] for i in pick])[:, None]
                ends = np.cumsum([len(rows[i][0]) for i in pick])
                starts = np.concatenate([[0], ends[:-1]])
                mean = np.add.reduceat(self.vectors[bucket] * share, starts)
                logit = mean @ self.layer + self.bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), label[pick]] -= 1
                back = p @ self.layer.T
                np.add.at(self.vectors, bucket,
                          -rate * s.dim * share * np.repeat(back, np.diff(np.concatenate([[0], ends])), axis=0))
                self.layer -= rate / len(pick) * s.dim * (mean.T @ p)
                self.bias -= rate / len(pick) * p.sum(0)
        return self

    def contributions(self) -> np.ndarray:
        """What each bucket adds to the log-odds, before the mean."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, s: Settings = DEFAULT, label_col: str = "quality") -> Model:
    """Fits on a bounded sample of the labelled rows; the ids are chosen first, so only the texts
    of the sample move. Hashed features are built by the tasks, the descent runs in one process."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)")
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
             .where("label = top").select("doc_id", "label").where(~held_out()))
    chosen = [(r.doc_id, r.label) for r in
              marks.orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id").limit(s.train_rows).collect()]
    if not chosen:
        return Model(s)
    spark = docs.sparkSession
    label_of = dict(chosen)
    wanted = spark.sparkContext.broadcast(np.array(sorted(label_of), np.int64))  # at most train_rows ids

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Names(lambda w: word_features(w, s))
        for batch in batches:
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(np.isin(doc, wanted.value))
            for part in chunks([batch.take(pa.array(keep))]):
                rows = [document_features(t, memo, s) for t in raw_texts(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([b.astype(np.int32) for b, _ in rows], pa.list_(pa.int32())),
                     pa.array([w for _, w in rows], pa.list_(pa.float32()))], ["doc_id", "bucket", "share"])

    got = (documents(docs).where("doc_id is not null")
           .mapInArrow(features, "doc_id long, bucket array<int>, share array<float>").toArrow())
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    doc = got.column("doc_id").to_numpy()[order]
    bucket, share = got.column("bucket").combine_chunks(), got.column("share").combine_chunks()
    flat_b, flat_s, off = bucket.values.to_numpy(), share.values.to_numpy(), bucket.offsets.to_numpy()
    rows = [(flat_b[off[i]:off[i + 1]].astype(np.int64), flat_s[off[i]:off[i + 1]]) for i in order]
    return Model(s).fit(rows, np.array([label_of[d] for d in doc], np.int64))


def _scores(model: Model, weights) -> Callable[[pa.RecordBatch], list[float]]:
    """Scorer of one task: the log-odds of a text are the mean over its vectors, plus the bias."""
    s, prior, bias = model.s, model.prior, float(model.bias[1] - model.bias[0])

    def add_up(word: bytes) -> tuple[float, int]:
        at = word_features(word, s)
        return float(weights[at].sum()), len(at)

    memo, repeat = Names(add_up), float(weights[again_bucket(s)])

    def run(batch: pa.RecordBatch) -> list[float]:
        out = []
        for text in raw_texts(batch):
            words = text.split()
            if words:
                sums, counts = zip(*map(memo.__getitem__, words), strict=True)
                n = again(words)
                odds = (sum(sums) + n * repeat) / (sum(counts) + n) + bias
                out.append(1 / (1 + math.exp(-odds)) if odds > -700 else 0.0)
            else:
                out.append(prior)
        return out

    return run


def _light(model: Model) -> Model:
    """The model without its vectors: what a scoring task needs beside the broadcast numbers."""
    light = Model.__new__(Model)
    light.s, light.bias, light.prior = model.s, model.bias, model.prior
    return light


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document: the probability of label 1 from the whole text."""
    light = _light(model)
    weights = docs.sparkSession.sparkContext.broadcast(model.contributions())  # fixed size: buckets x 8 bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(light, weights.value)
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch), pa.float64())],
                                             ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject."""
    light = _light(model)
    weights = docs.sparkSession.sparkContext.broadcast(model.contributions())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(light, weights.value)
        for batch in chunks(batches):
            yield batch.filter(pa.array([p >= light.s.threshold for p in scores(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
