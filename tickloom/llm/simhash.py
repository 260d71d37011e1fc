"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded to the 23 bits of the perfect binary
Golay code: every 23-bit word lies within three bits of exactly one codeword. With at most three
differing bits over three segments, two of the segments differ by at most one bit each
(pigeonhole). A segment that differs by at most one bit from another decodes to a codeword in the
other's neighbourhood (the codewords of the segment and of its one-bit neighbours, six or one of
them). So for every pair of segments a fingerprint takes the keys (own index, neighbour indices)
and (neighbour indices, own index): two fingerprints within three bits meet in at least one key,
and every meeting is verified by counting differing bits.

Equal fingerprints are merged before any key is made, so groups of copies are one row. Keys are
shuffled and sorted, buckets are compared inside the task in numpy blocks, and each task sends on
a forest of its links, never all pairs. Distributed union-find joins the forests.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words
than a shingle give one shingle of all words; a row without id takes part in its fingerprint's
class and gets that class's smallest id, null if it has none; repeated rows give repeated results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bucket_links, chunks, components, documents, raw_texts, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes, size: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Majority of each bit over the hashes of all shingles, repeats included; signed."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        n = len(words) - size + 1
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` per document; no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array([fingerprint(t) for t in raw_texts(batch)], pa.int64())], ["doc_id", "text_hash", "fp"])

    return (documents(docs).withColumn("text_hash", F.xxhash64("text"))
            .mapInArrow(run, "doc_id long, text_hash long, fp long"))


class Golay:
    """Decoder of the (23, 12) code by syndrome tables."""

    def __init__(self):
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            return word

        unit = np.array([remainder(1 << i) for i in range(23)], np.int32)
        self.low, self.high = self._sums(unit[:12]), self._sums(unit[12:])
        self.error = np.zeros(1 << 11, np.int32)
        ones = [1 << i for i in range(23)]
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    e = ones[a] | ones[b] | ones[c]
                    self.error[self.syndrome(np.array([e]))[0]] = e

    @staticmethod
    def _sums(unit: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << len(unit), np.int32)
        for i, u in enumerate(unit):
            out[1 << i:2 << i] = out[:1 << i] ^ u
        return out

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.low[v & 0xFFF] ^ self.high[v >> 12]

    def index(self, v: np.ndarray) -> np.ndarray:
        """The twelve information bits of the codeword nearest to each 23-bit word."""
        v = v.astype(np.int32)
        return (v ^ self.error[self.syndrome(v)]) >> 11

    def neighbours(self, v: np.ndarray, bits: int) -> np.ndarray:
        """Indices of a segment and of all its one-bit neighbours, sorted; one row per segment."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
        return np.sort(self.index(v.astype(np.int32)[:, None] ^ flips), axis=1)


def keys(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint: (row, key)."""
    v = fp.view(np.uint64)
    at, own, near = 0, [], []
    for bits in SEGMENTS:
        seg = ((v >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int32)
        own.append(code.index(seg).astype(np.int64))
        near.append(code.neighbours(seg, bits).astype(np.int64))
        at += bits
    rows, out = [], []
    for number, (i, j) in enumerate([(0, 1), (0, 2), (1, 2)]):
        key = np.concatenate([own[i][:, None] << 12 | near[j], near[i] << 12 | own[j][:, None]], axis=1)
        key = np.sort(key | number << 24, axis=1)
        new = np.ones(key.shape, bool)
        new[:, 1:] = key[:, 1:] != key[:, :-1]
        rows.append(np.nonzero(new)[0])
        out.append(key[new])
    return np.concatenate(rows), np.concatenate(out)


def _key_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        node = batch.column("node").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 1 << 15):
            row, key = keys(np.ascontiguousarray(fp[at:at + (1 << 15)]), code)
            yield pa.RecordBatch.from_pydict({"key": key, "fp": fp[at:][row], "node": node[at:][row]})


def link_classes(prints: DataFrame) -> DataFrame:
    """``fp, class, component_id`` of every distinct fingerprint of ``prints(doc_id, fp)``. The nodes
    are the fingerprints themselves, so texts that share nothing but an id stay apart; ``class`` is
    the smallest fingerprint reachable, ``component_id`` the smallest id among them."""
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = (distinct.where("least is not null").select("fp", F.col("fp").alias("node"))
             .mapInArrow(_key_rows, "key long, fp long, node long")
             .repartition("key").sortWithinPartitions("key", "fp")
             .mapInArrow(bucket_links(MAX_BITS), "a long, b long"))
    label = components(found).withColumnRenamed("node", "fp")
    named = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    ids = named.groupBy("class").agg(F.min("least").alias("component_id"))
    return named.join(ids, "class").select("fp", "class", "component_id")


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, class, component_id`` of every row of ``docs``."""
    prints = save(fingerprints(docs), "prints")
    return prints.join(link_classes(prints), "fp").select("doc_id", "text_hash", "fp", "class", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    return classify(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (ties: the
    smallest text hash, one row). Different texts under one id are judged each in its own component. Rows without an id cannot be told apart and stay."""
    keep = (classify(docs).where("doc_id = component_id").groupBy("class", "doc_id")
            .agg(F.min("text_hash").alias("__tl_least"))
            .select(F.col("doc_id").alias("__tl_doc"), "__tl_least"))
    named = docs.where("doc_id is not null").withColumn("__tl_hash", F.xxhash64(F.col("text").cast("string")))
    kept = (named.join(keep, (F.col("doc_id").cast("long") == F.col("__tl_doc")) & (F.col("__tl_hash") == F.col("__tl_least")),
                       "left_semi").dropDuplicates(["doc_id", "__tl_hash"]).drop("__tl_hash"))
    return kept.unionByName(docs.where("doc_id is null"))
