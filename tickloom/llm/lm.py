"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Words are counted over all training documents (counts are added up inside the tasks, then in one
shuffle). The ``HEAD`` most frequent tokens, the end token among them, are classes of their own;
every other word belongs to the class of its last two characters. The model predicts the class of
the next token from the classes of the two tokens before it: context vectors times position
vectors give a predicted vector, its product with a target vector plus a bias is the score of a
class. Within a class a word has its share of the class's count, and unseen words get the share of
words seen once (Good-Turing), so the probabilities of all known words and of an unseen word of
every class sum to one in every context.

Training runs in the tasks over all training tokens, once: shuffled minibatches, shared noise
samples, numpy. The first round takes about an eighth of the documents (by hash), the second all
others from there; after a round the models are averaged, weighted by tokens, in two levels of
groups. Scoring normalises by batched matrix products: one row of log-normalisers per first
context class, computed once for all pairs of classes.

The ``LISTED`` most frequent words, a bounded broadcast, are resolved inside the scoring tasks; all
other words of a document are joined with the full table of counts, so every count is exact.

Defined cases: a null or empty text is the end token alone; without training documents N and V are
0, no word is known, and each token scores as in a model that knows nothing; a row without id is
held in training; repeated rows give repeated results and train repeatedly; extra columns are
ignored.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Names, chunks, documents, raw_texts, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 512
ENDINGS = 200
LISTED = 200_000
DIM = 24
NOISE = 64
BATCH = 1024
RATE = 0.1
SEED = 5
#: Text handled at once inside a task, in bytes.
CHUNK = 2 << 20
#: The end token; no word is empty.
END = b""


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def _count_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()).cast(pa.string()),
                                           pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in chunks(batches, limit=CHUNK):
        for text in raw_texts(batch):
            seen.update(tokens(text))
        if len(seen) > 250_000:
            yield rows(seen)
            seen = Counter()
    if seen:
        yield rows(seen)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` of all tokens of ``docs``; the end token is the empty word."""
    return (docs.mapInArrow(_count_rows, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("c")))


class Lexicon:
    """Classes of all words and counts of the listed ones; its size is bounded by the constants."""

    def __init__(self, listed: list[tuple[str, int]], endings: list[tuple[str, int, int]],
                 rest: tuple[None, int, int], total: int, kinds: int):
        self.total, self.kinds = total, kinds
        self.listed = {w.encode(): i for i, (w, _) in enumerate(listed)}
        self.head = min(HEAD, len(listed))
        self.endings = {e: self.head + i for i, (e, _, _) in enumerate(endings)}
        self.other = self.head + len(endings)
        self.start = self.other + 1  # stands before a text, never a target
        self.classes = self.start + 1
        # Counts of the classes: whole, and of words seen once.
        mass = np.zeros(self.classes)
        once = np.zeros(self.classes)
        mass[:self.head] = [c for _, c in listed[:self.head]]
        for e, c, n in [*endings, rest]:
            k = self.endings.get(e, self.other)
            mass[k] += c
            once[k] += n
        # Every class of endings keeps room for unseen words, also where none was seen once.
        tail = np.arange(self.classes) >= self.head
        self.unseen = np.where(tail, (once + 0.5) / (mass + 1), 0.0)
        self.mass = mass
        share = np.where(mass > 0, mass, 0.0) + 0.5
        share[self.start] = 0
        self.unigram = share / share.sum()
        count = np.array([c for _, c in listed], float)
        cls = np.array([self.class_of(w.encode()) for w, _ in listed], np.int64)
        self.cls = np.concatenate([cls, np.arange(self.classes)])
        none = np.zeros(self.classes)
        self.base = np.concatenate([np.log10((count + 0.1) / self.room) if len(count) else count, none])
        inside = np.zeros(len(count))
        low = cls >= self.head
        inside[low] = np.log10((1 - self.unseen[cls[low]]) * count[low] / mass[cls[low]])
        self.inside = np.concatenate([inside, none])

    @property
    def room(self) -> float:
        return self.total + 0.1 * (self.kinds + 1)

    def class_of(self, word: bytes) -> int:
        at = self.listed.get(word)
        if at is not None and at < self.head:
            return at
        return self.endings.get(word.decode()[-2:], self.other)

    def coder(self) -> Names:
        """word -> place among the listed words, or their number plus the class."""
        n = len(self.listed)

        def code(word: bytes) -> int:
            at = self.listed.get(word)
            return n + self.class_of(word) if at is None else at

        return Names(code, 1 << 18)

    def contexts(self, cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes one and two tokens before each token; ``first`` marks the start of each text."""
        one = np.concatenate([[self.start], cls[:-1]])
        one[first] = self.start
        two = np.concatenate([[self.start], one[:-1]])
        two[first] = self.start
        return one, two


def lexicon(counts: DataFrame) -> Lexicon:
    """The bounded part of the counts. Listed words lie above a count found from a histogram (some
    thousand bins), so no task ever sorts the vocabulary; words at or below it stay in the table."""
    fine = F.floor(F.log2("c") * 64)
    limit, held = None, 0
    for r in sorted(counts.groupBy(fine.alias("bin")).count().collect(), key=lambda r: -r.bin):
        held += r["count"]
        if held > LISTED:
            break
        limit = r.bin
    rows = counts.where(fine >= limit).collect() if limit is not None else []
    listed = sorted(((r.word, r.c) for r in rows), key=lambda x: (-x[1], x[0]))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.sparkSession.createDataFrame([(w,) for w, _ in listed[:HEAD]], "word string")
    ends = (counts.join(F.broadcast(head), "word", "left_anti").groupBy(F.substring("word", -2, 2).alias("ending"))
            .agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")))
    endings = [tuple(r) for r in ends.orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()]
    mass, once = ends.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    rest = None, mass - sum(c for _, c, _ in endings), once - sum(n for *_, n in endings)
    return Lexicon(listed, endings, rest, total, kinds)


class Model:
    """Vectors of the log-bilinear model and its noise-contrastive training."""

    def __init__(self, lex: Lexicon):
        rng = np.random.default_rng(SEED)
        k = lex.classes
        self.noise = lex.unigram
        self.params = {
            "context": rng.normal(0, 0.1, (k, DIM)), "target": rng.normal(0, 0.1, (k, DIM)),
            "place": np.ones((2, DIM)), "bias": np.log(np.maximum(self.noise, 1e-12))[:, None]}
        self.params = {n: p.astype(np.float32) for n, p in self.params.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for name, p in self.params.items():
            self.params[name] = flat[at:at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        return self

    def learner(self):
        """A function that takes one shuffled minibatch (one before, two before, target)."""
        p = self.params
        speed = {n: np.full_like(v, 1e-3) for n, v in p.items()}
        log_kn = (np.log(np.maximum(self.noise, 1e-12)) + np.log(NOISE)).astype(np.float32)
        edges = np.cumsum(self.noise)
        rng = np.random.default_rng(SEED + 1)

        def add_rows(shape, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
            out = np.zeros(shape, np.float32)
            order = np.argsort(at.astype(np.int16), kind="stable")
            at = at[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out[at[first]] = np.add.reduceat(rows[order], first)
            return out

        def step(one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
            drawn = np.minimum(np.searchsorted(edges, rng.random(NOISE), side="right"), len(edges) - 1)
            r1, r2, t = p["context"][one], p["context"][two], p["target"][target]
            q = r1 * p["place"][0] + r2 * p["place"][1]
            true = (q * t).sum(1) + p["bias"][target, 0] - log_kn[target]
            up = -1 / (1 + np.exp(np.clip(true, -30, 30)))
            against = q @ p["target"][drawn].T + p["bias"][drawn, 0] - log_kn[drawn]
            down = 1 / (1 + np.exp(-np.clip(against, -30, 30)))
            dq = up[:, None] * t + down @ p["target"][drawn]
            g = {"target": add_rows(p["target"].shape, target, up[:, None] * q),
                 "bias": np.bincount(target, up, len(edges)).astype(np.float32)[:, None],
                 "context": add_rows(p["context"].shape, one, dq * p["place"][0])
                 + add_rows(p["context"].shape, two, dq * p["place"][1]),
                 "place": np.stack([(dq * r1).sum(0), (dq * r2).sum(0)])}
            np.add.at(g["target"], drawn, down.T @ q)
            np.add.at(g["bias"][:, 0], drawn, down.sum(0))
            for name, grad in g.items():
                grad /= len(target)
                speed[name] += grad * grad
                p[name] -= RATE * grad / np.sqrt(speed[name])

        return step

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class scores by the class one before, by the class two before, and biases."""
        p = self.params
        bias = p["bias"][:, 0].astype(np.float64)
        bias[-1] = -np.inf  # the start is no target
        target = p["target"].astype(np.float64).T
        return (p["context"] * p["place"][0]) @ target, (p["context"] * p["place"][1]) @ target, bias


def _batches(batch: pa.RecordBatch, lex: Lexicon, code: Names):
    """Tokens of a chunk: words, codes, classes, contexts, number of tokens per text."""
    texts = [tokens(t) for t in raw_texts(batch)]
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.fromiter((code[w] for t in texts for w in t), np.int64, int(size.sum()))
    cls = lex.cls[codes]
    first = np.cumsum(size) - size
    one, two = lex.contexts(cls, first)
    return texts, size, first, codes, cls, one, two


def train(docs: DataFrame, lex: Lexicon) -> Model:
    """All rows of ``docs`` once, in two rounds of local training and averaging."""
    model = Model(lex)
    spark = docs.sparkSession
    shared_lex = spark.sparkContext.broadcast(lex)
    early = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(8)) == 0
    for part in (docs.where(early), docs.where(~early)):
        start = spark.sparkContext.broadcast(model.flat())

        def run(batches: Iterable[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            lex = shared_lex.value
            model, code, seen = Model(lex).load(start.value), lex.coder(), 0
            step = model.learner()
            rng = np.random.default_rng(SEED + 2)
            for batch in chunks(batches, limit=CHUNK):
                *_, cls, one, two = _batches(batch, lex, code)
                order = rng.permutation(len(cls))
                for at in range(0, len(order), BATCH):
                    pick = order[at:at + BATCH]
                    step(one[pick], two[pick], cls[pick])
                seen += len(cls)
            if seen:
                flat = model.flat()
                pieces = np.array_split(flat, 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(32), pa.int32()), pa.array([int(rng.integers(64))] * 32, pa.int32()),
                     pa.array([float(seen)] * 32), pa.array(pieces, pa.list_(pa.float32()))],
                    ["piece", "lane", "weight", "v"])

        def mean(table: pa.Table) -> pa.Table:
            weight = table.column("weight").to_numpy()
            v = np.stack(table.column("v").to_pylist()).astype(np.float64)
            return pa.table({"piece": table.column("piece").slice(0, 1), "weight": pa.array([weight.sum()]),
                             "v": pa.array([(weight @ v / weight.sum()).astype(np.float32)], pa.list_(pa.float32()))})

        out = "piece int, weight double, v array<float>"
        own = part.mapInArrow(run, "piece int, lane int, weight double, v array<float>")
        got = (own.groupBy("piece", "lane").applyInArrow(mean, out).groupBy("piece").applyInArrow(mean, out)
               .orderBy("piece").collect())
        if got:
            model.load(np.concatenate([np.array(r.v, np.float32) for r in got]))
    return model


def normalisers(spark, model: Model) -> np.ndarray:
    """Natural log of the sum over all classes, for every pair of context classes."""
    shared = spark.sparkContext.broadcast(model.tables())
    classes = len(model.noise)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, bias = shared.value
        for batch in batches:
            rows = []
            for one in batch.column("id").to_pylist():
                score = far + near[one] + bias
                top = score.max(1)
                rows.append(np.log(np.exp((score - top[:, None]).astype(np.float32)).sum(1, dtype=np.float64)) + top)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["id", "z"])

    got = spark.range(classes).mapInArrow(run, "id long, z array<double>").orderBy("id").collect()
    return np.array([r.z for r in got])


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = docs.sparkSession
    own = documents(docs).withColumn("held_out", held_out())
    learn = own.where("not held_out").select("doc_id", "text")
    counts = save(word_counts(learn), "counts")
    lex = lexicon(counts)
    model = train(learn, lex)
    shared = spark.sparkContext.broadcast((lex, *model.tables(), normalisers(spark, model)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, near, far, bias, z = shared.value
        code, listed = lex.coder(), len(lex.listed)
        for batch in chunks(batches, limit=CHUNK):
            texts, size, first, codes, cls, one, two = _batches(batch, lex, code)
            chance = (near[one, cls] + far[two, cls] + bias[cls] - z[one, two]) / np.log(10) + lex.inside[codes]
            rare = codes >= listed
            at = np.flatnonzero(rare)
            doc = np.searchsorted(first, at, side="right") - 1
            rest: list[Counter] = [Counter() for _ in texts]
            for d, i in zip(doc.tolist(), (at - first[doc]).tolist(), strict=True):
                rest[d][texts[d][i]] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(size),
                 pa.array(np.add.reduceat((~rare).astype(np.int64), first)),
                 pa.array(np.add.reduceat(lex.base[codes], first)), pa.array(np.add.reduceat(chance, first)),
                 pa.array([[{"word": w.decode(), "n": n} for w, n in r.items()] for r in rest],
                          pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "chance", "rest"])

    part = save(own.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, chance double, "
             "rest array<struct<word:string,n:long>>"), "scored")
    # Words outside the list: their counts come from the whole table.
    ending = F.substring("word", -2, 2)
    room = F.create_map(*[x for e, k in lex.endings.items() for x in (F.lit(e), F.lit(k))]) if lex.endings else None
    cls = F.coalesce(room[ending], F.lit(lex.other)) if room is not None else F.lit(lex.other)
    table = F.array(*[F.struct(F.lit(float(m)).alias("mass"), F.lit(float(u)).alias("unseen"))
                      for m, u in zip(lex.mass, lex.unseen, strict=True)])
    of = F.element_at(table, cls + 1)
    rare = (part.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.n")
            .join(counts, "word", "left"))
    count = F.coalesce("c", F.lit(0))
    added = (rare.withColumn("of", of).groupBy("row").agg(
        F.sum(F.when(F.col("c").isNull(), 0).otherwise(F.col("n"))).alias("more"),
        F.sum(F.col("n") * F.log10((count + 0.1) / lex.room)).alias("more_base"),
        F.sum(F.col("n") * F.when(F.col("c").isNull(), F.log10(F.col("of.unseen"))).otherwise(
            F.log10((1 - F.col("of.unseen")) * F.col("c") / F.col("of.mass")))).alias("more_chance")))
    return part.drop("rest").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("chance") + F.coalesce("more_chance", F.lit(0.0))).alias("score"))
