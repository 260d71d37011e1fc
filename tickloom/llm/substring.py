"""Substring dedup by recompression.

Words get 64-bit names; then rounds shorten the sequence of every document. A run round replaces
short runs of one name, pair rounds replace a name of the left class followed by one of the right
class (a hash bit of the name decides), each by a new name. A name is a hash of what it replaces,
so every task gives the same name to the same run or pair without a shared dictionary, and only
short symbols may merge, so a symbol depends on few words around it: equal stretches of text have
equal symbols except within ``CONTEXT`` words of their ends.

Of the symbols inside every window the one with the smallest mixed name is the window's anchor,
named with the ``CONTEXT`` words on its sides, which every such window holds too; equal windows
have equal anchors. Only anchors are shuffled (about one in fifteen words), with the
range of windows they stand for. An anchor name that two documents share reveals a repeat. If the
whole surroundings of a shared name are equal everywhere, all its windows are repeats of the
smallest document; else the windows themselves are compared (128 bits of hash over the words), so
every removed word lies in a verified window. Names are pre-aggregated before the shuffle and
joined with skew splitting; no list of documents per name is ever built.

Defined cases: a null or empty text has no words; a document with fewer words than a window loses
nothing; rows without an id lose nothing and are no source; rows with equal ids are never sources
for each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Names, chunks, documents, raw_texts, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 50
#: Longest run, in words, that the run round replaces.
RUN = 4
#: Longest symbol, in words, that each pair round may merge.
PAIRS = (2, 2, 2)
#: Words on each side that decide whether a symbol ends at a place.
CONTEXT = RUN + 1 + sum(PAIRS)
#: Words inside a window whose whole symbols are equal in all equal windows.
INSIDE = WINDOW - 2 * CONTEXT
BASE = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def recompress(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of word sequences: name, first word, length. ``doc`` numbers the document of each word."""
    n = len(names)
    start, length = np.arange(n), np.ones(n, np.int64)
    if not n:
        return names, start, length
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [n]]))
    short = (size > 1) & (size <= RUN)
    keep = new | ~np.repeat(short, size)
    named = names.copy()
    at = first[short]
    named[at] = mix(names[at] ^ mix(size[short].astype(np.uint64), 1), 2)
    length[at] = size[short]
    names, start, length, doc = named[keep], start[keep], length[keep], doc[keep]
    for number, limit in enumerate(PAIRS):
        right = mix(names, 10 + number) >> np.uint64(63) == 1
        fit = length <= limit
        left = np.flatnonzero(~right[:-1] & right[1:] & fit[:-1] & fit[1:] & (doc[:-1] == doc[1:]))
        named = names.copy()
        named[left] = mix(mix(names[left], 20 + number) + names[left + 1], 30 + number)
        length = length.copy()
        length[left] += length[left + 1]
        keep = np.ones(len(names), bool)
        keep[left + 1] = False
        names, start, length, doc = named[keep], start[keep], length[keep], doc[keep]
    return names, start, length


def ranged(low: np.ndarray, high: np.ndarray, values: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of values[low:high] for many short, non-empty ranges."""
    size = high - low
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k in range(int(level.max()) + 1 if len(low) else 0):
        at = np.flatnonzero(level == k)
        out[at] = pick(values[low[at]], values[high[at] - (1 << k)])
        values = pick(values[:-(1 << k)], values[1 << k:]) if len(values) > 1 << k else values
    return out


class Prefix:
    """Hashes of any word range from prefix sums, in two independent 64-bit rings."""

    def __init__(self, names: np.ndarray):
        self.sums, self.back = [], []
        for i, base in enumerate(BASE):
            n = len(names)
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
            own = names if not i else mix(names, 40)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(own * up[:n])]))
            self.back.append(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse(int(base)))])))

    def of(self, low: np.ndarray, high: np.ndarray, ring: int = 0) -> np.ndarray:
        return mix((self.sums[ring][high] - self.sums[ring][low]) * self.back[ring][low], 50)


def inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


class Shard:
    """Anchors and window hashes of some documents, computed at once."""

    def __init__(self, words: list[list[bytes]], name_of: Names):
        size = np.array([len(w) for w in words], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(size)])
        self.names = np.fromiter((name_of[w] for ws in words for w in ws), np.uint64, int(self.offset[-1]))
        self.doc = np.repeat(np.arange(len(words)), size)
        self.prefix = Prefix(self.names)
        #: Anchors: name, first and last window start they stand for.
        self.name, self.low, self.high = self._anchors()

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor names and the first and last window start each of them stands for."""
        none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        name, start, length = recompress(self.names, self.doc)
        rank, end = mix(name, 60), start + length
        # Window starts of all documents long enough.
        ends = self.offset[self.doc + 1] if len(self.doc) else self.doc
        window = np.flatnonzero(np.arange(len(self.doc)) + WINDOW <= ends)
        if not len(window):
            return none
        inside = window + CONTEXT
        first = np.searchsorted(start, inside)  # first symbol that starts inside
        last = np.searchsorted(end, inside + INSIDE, side="right")  # past the last that ends inside
        best = np.full(len(self.doc), np.iinfo(np.uint64).max)  # per window start; none elsewhere
        best[window] = ranged(first, last, rank, np.minimum)
        known = np.zeros(len(self.doc) + 1, np.int64)
        known[window + 1] = 1
        known = np.cumsum(known)
        # A symbol is an anchor of the windows around it whose smallest rank is its own.
        low = np.maximum(end - INSIDE - CONTEXT, 0)
        high = np.minimum(start - CONTEXT + 1, len(self.doc))
        low = np.maximum(low, self.offset[self.doc[start]])
        fit = np.flatnonzero(high > low)
        fit = fit[known[high[fit]] > known[low[fit]]]
        # Ranks never exceed those of the windows that hold them, so a maximum equal to the rank decides.
        masked = best.copy()
        masked[best == np.iinfo(np.uint64).max] = 0
        fit = fit[ranged(low[fit], high[fit], masked, np.maximum) == rank[fit]]
        width = int((high[fit] - low[fit]).max()) if len(fit) else 0
        own_low, own_high = np.full(len(fit), -1), np.full(len(fit), -1)
        for k in range(width):
            at = low[fit] + k
            hit = (at < high[fit]) & (masked[np.minimum(at, len(masked) - 1)] == rank[fit])
            own_low = np.where(hit & (own_low < 0), at, own_low)
            own_high = np.where(hit, at, own_high)
        # Every window of an anchor holds it with CONTEXT words on each side: these words name it.
        return self.prefix.of(start[fit] - CONTEXT, end[fit] + CONTEXT), own_low, own_high

    def context(self) -> np.ndarray:
        """Hash of all words of an anchor's windows and of where they lie."""
        return mix(self.prefix.of(self.low, self.high + WINDOW) ^ (self.high - self.low).astype(np.uint64), 70)

    def windows(self, pick: np.ndarray) -> np.ndarray:
        """Starts of the windows of the picked anchors, each once."""
        low, size = self.low[pick], (self.high - self.low)[pick] + 1
        if not len(low):
            return low
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.unique(np.repeat(low, size) + step)


def word_name(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name_of = Names(word_name)
    for batch in chunks(batches, limit=2 << 20):
        shard = Shard([t.split() for t in raw_texts(batch)], name_of)
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[shard.doc[shard.low]]
        rows = np.unique(np.rec.fromarrays([doc, shard.name.view(np.int64), shard.context().view(np.int64)],
                                           names="doc,name,context"))
        yield pa.RecordBatch.from_pydict({c: np.ascontiguousarray(rows[c]) for c in ("name", "context", "doc")})


def _window_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window hashes of the anchors whose surroundings differ, each once per document."""
    name_of = Names(word_name)
    for batch in chunks(batches, limit=2 << 20):
        shard = Shard([t.split() for t in raw_texts(batch)], name_of)
        at = shard.windows(_listed(shard, batch, "open"))
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[shard.doc[at]]
        rows = np.unique(np.rec.fromarrays(
            [doc, shard.prefix.of(at, at + WINDOW).view(np.int64), shard.prefix.of(at, at + WINDOW, 1).view(np.int64)],
            names="doc,h,g"))
        yield pa.RecordBatch.from_pydict({c: np.ascontiguousarray(rows[c]) for c in ("h", "g", "doc")})


def _pairs(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.rec.fromarrays([doc, value], names="doc,value")


def _of_list(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """(row, value) of a list column; null lists are empty."""
    lists = batch.column(column).to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x or ()) for x in lists])
    return _pairs(row, np.array([v for x in lists for v in x or ()], np.int64))


def _listed(shard: Shard, batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Anchors that their document's list names."""
    own = _pairs(shard.doc[shard.low] if len(shard.low) else shard.low, shard.name.view(np.int64))
    return np.flatnonzero(np.isin(own, _of_list(batch, column)))


def _rewritten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name_of = Names(word_name)
    for batch in chunks(batches, limit=2 << 20):
        words = [t.split() for t in raw_texts(batch)]
        shard = Shard(words, name_of)
        change = np.zeros(len(shard.doc) + 1, np.int64)
        gone = _listed(shard, batch, "gone")
        np.add.at(change, shard.low[gone], 1)
        np.add.at(change, shard.high[gone] + WINDOW, -1)
        at = shard.windows(_listed(shard, batch, "open"))
        own = _pairs(shard.doc[at] if len(at) else at, shard.prefix.of(at, at + WINDOW).view(np.int64))
        at = at[np.isin(own, _of_list(batch, "repeated"))]
        np.add.at(change, at, 1)
        np.add.at(change, at + WINDOW, -1)
        out = np.cumsum(change)[:-1] > 0
        kept, removed = [], []
        for i, ws in enumerate(words):
            lost = out[shard.offset[i]:shard.offset[i + 1]]
            removed.append(int(lost.sum()))
            kept.append(b" ".join([w for w, x in zip(ws, lost.tolist(), strict=True) if not x]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(w) for w in words], pa.int64()),
             pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "text_hash", "n_words", "n_removed", "kept"])


def rewritten(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_words, n_removed, kept`` of the documents that share an anchor with
    another one; all other documents lose nothing."""
    own = documents(docs).where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    anchors = save(own.select("doc_id", "text").mapInArrow(_anchor_rows, "name long, context long, doc long"), "anchors")
    shared = (anchors.groupBy("name")
              .agg(F.min("doc").alias("first"), F.max("doc").alias("last"),
                   (F.min("context") == F.max("context")).alias("same")).where("first < last").drop("last"))
    # In equal surroundings the smallest document keeps its words and needs no look.
    hits = (anchors.select("name", "doc").join(shared, "name").where("not (same and first = doc)")
            .groupBy("doc").agg(F.collect_set(F.expr("if(same, name, null)")).alias("gone"),
                                F.collect_set(F.expr("if(same, null, name)")).alias("open")))
    looked = save(own.join(hits.withColumnRenamed("doc", "doc_id"), "doc_id"), "shared")
    windows = save(looked.where("size(open) > 0").select("doc_id", "text", "open")
                   .mapInArrow(_window_rows, "h long, g long, doc long"), "windows")
    early = (windows.groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
             .where("first < last").drop("last"))
    repeated = (windows.join(early, ["h", "g"]).where("first < doc")
                .groupBy("doc").agg(F.collect_set("h").alias("repeated")).withColumnRenamed("doc", "doc_id"))
    return looked.join(repeated, "doc_id", "left").mapInArrow(
        _rewritten, "doc_id long, text_hash long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = [t.split() for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())],
                ["doc_id", "text_hash", "n_words", "whole"])

    everything = (documents(docs).withColumn("text_hash", F.xxhash64("text"))
                  .mapInArrow(whole, "doc_id long, text_hash long, n_words long, whole string"))
    changed = (rewritten(docs).where("n_removed > 0")
               .select("doc_id", "text_hash", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
               .dropDuplicates(["doc_id", "text_hash"]))
    return (everything.join(changed, ["doc_id", "text_hash"], "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                    F.coalesce("kept_sha256", "whole").alias("kept_sha256")))
