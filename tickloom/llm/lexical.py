"""Ranked lexical search: MaxScore with bounds for pairs of terms.

Documents are indexed in shards of bounded text inside the tasks that read them; no posting is
shuffled. A shard keeps, for every term of the queries, its documents and counts, and the number of
terms of each document. Document counts, lengths and frequencies over all documents are summed from
the stored shards before any score is taken.

A posting's impact is its exact share of a score (an integer), so a term's largest impact in a shard
bounds what it can add. MaxScore orders a query's terms by that bound; terms whose bounds together
stay below the k-th best score cannot bring a document in by themselves, so only the other (essential)
terms' postings are read in full, and the rest only completes documents that can still get there.
Pairs tighten this: for terms that stand side by side in the order of a query, each shard computes,
before the first query is answered, the list of documents that hold both with the sum of both impacts,
and keeps the largest sum. A pair adds at most the largest of that sum and the two terms' own maxima,
which is less than the sum of the two maxima unless one document has both. The bounds of the pairs are
combined: over the non-essential terms, and while documents are completed, where a pair's list gives
both impacts at once. Only a bound strictly below the k-th score skips, so ties are never lost.

Queries are taken in blocks of at most ``BLOCK_BYTES`` of text; each block's terms are broadcast and
the documents are read once per block. Every task keeps its best ``top`` documents per query; one
shard, read first, gives a k-th score to start from.

Defined cases: a null or empty text has no term and is no document for N (it can never score); an item
without a known term finds nothing; items are rows, equal ids are answered each; null ids come last
among equals; very long texts are cut at separators while they are read; repeated rows are documents
each; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import chunks, documents, drop, raw_texts, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 20
#: Query text that is broadcast at once, in bytes.
BLOCK_BYTES = 4 << 20
#: Text of the documents of one shard, in bytes (one longer text is a shard of its own).
SHARD_BYTES = 16 << 20
#: Text that is split into words at once.
PIECE_BYTES = 1 << 20
#: Letters and digits stay (A-Z as a-z), bytes of other scripts stay, the rest separates terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    text = text.translate(TERM_BYTES)
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = text.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield (text[at:] if at else text).split()


# --- index ----------------------------------------------------------------------------------------

INDEX = "docs int, ids binary, lengths binary, terms binary, starts binary, doc binary, tf binary"


class _Gather:
    """Postings of a shard while its texts are read."""

    def __init__(self, vocab: dict[bytes, int]):
        self.vocab, self.ids, self.lengths, self.postings, self.weight = vocab, [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        n, found, get = 0, Counter(), self.vocab.get
        for words in terms_of(text):
            n += len(words)
            found.update(map(get, words))
        self.weight += len(text)
        if not n:
            return
        found.pop(None, None)
        pairs = np.fromiter((x for kv in found.items() for x in kv), np.int64, 2 * len(found)).reshape(-1, 2)
        self.postings.append(np.column_stack([pairs, np.full(len(pairs), len(self.ids))]))
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lengths.append(n)

    def row(self) -> pa.RecordBatch:
        p = np.concatenate(self.postings)
        p = p[np.lexsort((p[:, 2], p[:, 0]))]
        terms, starts = np.unique(p[:, 0], return_index=True)
        cells = {"ids": np.array(self.ids, "<i8"), "lengths": np.array(self.lengths, "<i8"), "terms": terms.astype("<i4"),
                 "starts": np.append(starts, len(p)).astype("<i8"), "doc": p[:, 2].astype("<i4"), "tf": p[:, 1].astype("<i4")}
        return pa.RecordBatch.from_pydict({"docs": pa.array([len(self.ids)], pa.int32())}
                                          | {k: pa.array([v.tobytes()], pa.binary()) for k, v in cells.items()})


def build_index(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """Stored shards with the postings of the terms in ``vocab`` and the lengths of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Gather(shared.value)
        for batch in chunks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                now.add(doc_id, text)
                if now.weight >= SHARD_BYTES:
                    if now.ids:
                        yield now.row()
                    now = _Gather(shared.value)
        if now.ids:
            yield now.row()

    out = save(documents(docs).mapInArrow(run, INDEX), "lexical-index")
    shared.destroy()
    return out


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents, their terms, and documents per term of the vocabulary, over all shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = Counter(), 0, 0
        for batch in batches:
            for n, lengths, codes, starts in zip(*(batch.column(c).to_pylist() for c in
                                                   ("docs", "lengths", "terms", "starts")), strict=True):
                docs, terms = docs + n, terms + int(np.frombuffer(lengths, "<i8").sum())
                df.update(dict(zip(np.frombuffer(codes, "<i4").tolist(), np.diff(np.frombuffer(starts, "<i8")).tolist(),
                                   strict=True)))
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, -2, *df], pa.int32()),
                                          "n": pa.array([docs, terms, *df.values()], pa.int64())})

    rows = (index.select("docs", "lengths", "terms", "starts").mapInArrow(run, "term int, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # at most the vocabulary of a block
    found = {r.term: r.n for r in rows}
    return found.pop(-1, 0), found.pop(-2, 0), found


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


# --- one shard ------------------------------------------------------------------------------------

class Model:
    """What a block of queries needs in every task: weights, lengths' scale, terms and pairs."""

    def __init__(self, items: list[tuple[int, Counter]], docs: int, total: int, df: dict[int, int]):
        self.docs, self.total = docs, total
        weights = {t: weight(docs, n) for t, n in df.items()}
        self.weights = {t: w for t, w in weights.items() if w > 0}
        #: Query number -> its terms with positive weight, by ascending weight times repeats. Neighbours
        #: in this order are pairs: frequent terms, most of them non-essential, stand first.
        self.queries = [(row, sorted(((t, q) for t, q in terms.items() if t in self.weights),
                                     key=lambda x: (x[1] * self.weights[x[0]], x[0]))) for row, terms in items]

    def pairs(self, terms: list[tuple[int, int]]) -> list[tuple[tuple[int, int], ...]]:
        return [tuple(terms[i:i + 2]) for i in range(0, len(terms), 2)]


class Shard:
    def __init__(self, model: Model, docs: int, ids: bytes, lengths: bytes, terms: bytes, starts: bytes, doc: bytes,
                 tf: bytes):
        self.model, self.n, self.ids = model, docs, np.frombuffer(ids, "<i8")
        m = 75 + 25 * np.frombuffer(lengths, "<i8") * model.docs // max(model.total, 1)
        start, doc = np.frombuffer(starts, "<i8"), np.frombuffer(doc, "<i4")
        tf = np.frombuffer(tf, "<i4").astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        self.postings = {}
        for k, t in enumerate(np.frombuffer(terms, "<i4").tolist()):
            if t in model.weights:
                a, b = start[k], start[k + 1]
                self.postings[t] = (doc[a:b], impact[a:b] * model.weights[t])
        self.largest = {t: int(i.max()) for t, (_, i) in self.postings.items()}
        #: (term, repeats) twice -> documents with both and the sums of both impacts; their largest sum.
        self.both: dict[tuple, tuple[np.ndarray, np.ndarray, int]] = {}
        for _, query in model.queries:
            for pair in model.pairs(query):
                if len(pair) == 2 and pair not in self.both and all(t in self.postings for t, _ in pair):
                    self.both[pair] = self._both(pair)

    def _both(self, pair) -> tuple[np.ndarray, np.ndarray, int]:
        (s, p), (t, q) = pair
        (da, ia), (db, ib) = self.postings[s], self.postings[t]
        at = np.searchsorted(db, da)
        hit = (at < len(db)) & (db[np.minimum(at, len(db) - 1)] == da)
        joint = p * ia[hit] + q * ib[at[hit]]
        return da[hit], joint, int(joint.max(initial=0))

    def bound(self, group) -> int:
        """The most that one or two terms add to a document of this shard."""
        alone = [q * self.largest.get(t, 0) for t, q in group]
        joint = self.both[group][2] if group in self.both else 0
        return max(*alone, joint) if len(alone) == 2 else alone[0]

    def search(self, query, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is at least ``known`` (and above 0), with their exact scores."""
        groups = self.model.pairs(query)
        bounds = [self.bound(g) for g in groups]
        order = sorted(range(len(groups)), key=lambda k: bounds[k])
        below = np.cumsum([0, *(bounds[k] for k in order)])
        essential = int(np.searchsorted(below, known, side="left")) - 1  # groups before it stay below known
        if essential >= len(order):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        essential = max(essential, 0)
        score = np.zeros(self.n, np.int64)
        for k in order[essential:]:
            for t, q in groups[k]:
                if t in self.postings:
                    doc, impact = self.postings[t]
                    score[doc] += q * impact
        live = np.flatnonzero((score > 0) & (score + below[essential] >= known))
        for k in range(essential - 1, -1, -1):
            if not len(live):
                break
            self._complete(groups[order[k]], live, score)
            live = live[score[live] + below[k] >= known]
        return live, score[live]

    def _complete(self, group, live: np.ndarray, score: np.ndarray) -> None:
        """Adds the impacts of a group's terms to the documents that are still possible."""
        rest = live
        if group in self.both:
            doc, joint, _ = self.both[group]
            rest = self._add(doc, joint, rest, score)
        for t, q in group:
            if t in self.postings:
                doc, impact = self.postings[t]
                rest = self._add(doc, q * impact if q > 1 else impact, rest, score)

    @staticmethod
    def _add(doc: np.ndarray, impact: np.ndarray, live: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Adds impacts where ``live`` meets ``doc``; returns the documents it did not meet."""
        if not len(doc):
            return live
        at = np.minimum(np.searchsorted(doc, live), len(doc) - 1)
        hit = doc[at] == live
        score[live[hit]] += impact[at[hit]]
        return live[~hit]


# --- search ---------------------------------------------------------------------------------------

class Best:
    """The best documents of each query so far."""

    def __init__(self, model: Model, top: int, known: dict[int, int]):
        self.model, self.top = model, top
        none = np.empty(0, np.int64)
        self.found = {row: (none, none) for row, _ in model.queries}
        self.known = {row: known.get(row, 1) for row, _ in model.queries}

    def see(self, cells: tuple) -> None:
        shard = Shard(self.model, *cells)
        for row, query in self.model.queries:
            if not query:
                continue
            doc, score = shard.search(query, self.known[row])
            ids = np.concatenate([self.found[row][0], shard.ids[doc]])
            score = np.concatenate([self.found[row][1], score])
            order = np.lexsort((ids, -score))[:self.top]
            self.found[row] = ids[order], score[order]
            if len(order) == self.top:
                self.known[row] = max(self.known[row], int(score[order[-1]]))


def _pass(index: DataFrame, model, known, top: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(model.value, top, known)
        for batch in batches:
            for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best.see(cells)
        ids = np.concatenate([i for i, _ in best.found.values()])
        yield pa.RecordBatch.from_pydict({
            "item": np.repeat(np.array([*best.found], np.int64), [len(i) for i, _ in best.found.values()]),
            "doc_id": pa.array(ids, mask=ids == NO_ID), "score": np.concatenate([s for _, s in best.found.values()])})

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """Rows of the queries with their text, in blocks of bounded size."""
    held, size = [], 0
    for r in items.toLocalIterator():
        raw = r.text.encode()
        if held and size + len(raw) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item, raw))
        size += len(raw)
    if held:
        yield held


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above 0, equal
    scores by smaller id."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    items = save(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id",
                                  F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "items")
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for block in _blocks(items.select("item", "text")):
        vocab: dict[bytes, int] = {}
        queries = [(row, Counter(vocab.setdefault(w, len(vocab)) for words in terms_of(text) for w in words))
                   for row, text in block]
        index = build_index(docs, vocab)
        shared = spark.sparkContext.broadcast(Model(queries, *statistics(index)))
        # Any shard's k-th score is a sound start; one stored part of the index (bounded) gives it.
        first = _pass(index.limit(1), shared, {}, top).groupBy("item").agg(
            F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= top).collect()
        found = found.unionByName(save(_pass(index, shared, {r.item: r.kth for r in first}, top), "best-of-block"))
        shared.destroy()
        drop(index)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(),
                                                                   F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", place).where(F.col("rank") <= top)
    return (best.join(items.select("item", F.col("item_id").cast(kind).alias("item_id")), "item")
            .select("item_id", "rank", "doc_id", "score"))
