"""Helpers shared by the operators: text batches, shared scratch tables, connected components."""

from __future__ import annotations

import gc
import re
import sys
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir

# Python workers of a cluster may lack this package: its code travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text handled at once inside a task, in bytes; a single longer text is one chunk of its own.
CHUNK_BYTES = 4 << 20
#: Members of a bucket that are compared at once.
BLOCK = 2048


def ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """``df`` with ``name`` as a long column and no columns that could clash."""
    return df.select(F.col(f"`{name}`").cast("long").alias(name))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads, whatever else ``df`` carries."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


class Names(dict):
    """Memo of a pure function of a word, emptied when it grows beyond ``limit`` entries."""

    def __init__(self, make, limit: int = 1 << 19):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


# --- shared scratch tables -------------------------------------------------------------------

def save(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, lost executors
    cost nothing, and a frame that is used twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{re.sub(r'[^a-z0-9]', '-', label)}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of ``save`` that no later frame reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished phases now, not when memory happens to run low.

    The first collection lets go of the plans, the second of the shuffles they held.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


# --- connected components --------------------------------------------------------------------

def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links with the smallest node it reaches; both arrays hold node ids."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[:len(left)], at[len(left):]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, label[low])
        low = low[low]
        if np.array_equal(low, label):
            return nodes, nodes[label]
        label = low


def near_pairs(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs with equal key (sorted) and at most ``bits`` differing bits; of a bucket larger
    than a block, each block's links are found block by block and thinned to a forest."""
    left, right = [], []
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([start, [len(key)]]))
    large = size > 64
    rest = np.repeat(~large, size)
    at = np.flatnonzero(rest)
    lag = 1
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        hit = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= bits]
        left.append(hit)
        right.append(hit + lag)
        lag += 1
    for s, n in zip(start[large], size[large], strict=True):
        for a in range(s, s + n, BLOCK):
            for b in range(a, s + n, BLOCK):
                near = np.bitwise_count(fp[a:min(a + BLOCK, s + n), None] ^ fp[b:min(b + BLOCK, s + n)]) <= bits
                x, y = np.nonzero(near)
                x, y = x + a, y + b
                node, root = forest(x[x < y], y[x < y])
                left.append(node[node != root])
                right.append(root[node != root])
    return np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])


def bucket_links(bits: int):
    """Links ``a, b`` inside the buckets of one task. Rows ``key, fp, node`` come sorted by key and
    stream through: the last bucket of a block of rows waits for the next one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, node = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[list[np.ndarray]] = []

        def links(upto: int) -> pa.RecordBatch:
            a, b = near_pairs(key[:upto], fp[:upto], bits)
            found, root = forest(node[a], node[b])
            keep = found != root
            return pa.RecordBatch.from_pydict({"a": found[keep], "b": root[keep]})

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node")])
            if sum(len(h[0]) for h in held) < 1 << 17:
                continue
            key, fp, node = (np.concatenate([x, *(h[i] for h in held)]) for i, x in
                             enumerate((key, fp.view(np.int64), node)))
            fp, held = fp.view(np.uint64), []
            upto = int(np.searchsorted(key, key[-1]))
            if upto:
                yield links(upto)
                key, fp, node = key[upto:], fp[upto:], node[upto:]
        key, fp, node = (np.concatenate([x, *(h[i] for h in held)]) for i, x in
                         enumerate((key, fp.view(np.int64), node)))
        fp = fp.view(np.uint64)
        if len(key):
            yield links(len(key))

    return run


def _local_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task, folded block by block: what leaves is a forest."""
    left = right = np.empty(0, np.int64)
    for batch in batches:
        left = np.concatenate([left, batch.column("a").to_numpy(zero_copy_only=False)])
        right = np.concatenate([right, batch.column("b").to_numpy(zero_copy_only=False)])
        if len(left) > 1 << 20:
            left, right = forest(left, right)
    if len(left):
        node, root = forest(left, right)
        keep = node != root
        yield pa.RecordBatch.from_pydict({"a": node[keep], "b": root[keep]})


#: Links that one task may fold at once (16 bytes each).
FOLD = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in ``links(a, b)``.

    Distributed union-find: every task first folds its links into a forest, then two star
    operations alternate until nothing changes: each node's larger neighbours, then its smaller
    ones, move to the smallest neighbour. Once no more than ``FOLD`` links are left they are one
    block for a last fold. Links with a null end or a == b add nothing. Neighbour
    minima are pre-aggregated and joined, so no neighbour list is ever gathered; the number of
    rounds grows with the logarithm of the number of nodes. ``drop`` of the result deletes its table.
    """
    edge = "a long, b long"
    start = (links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
             .where("a is not null and b is not null and a <> b")
             .mapInArrow(_local_forest, edge))
    now = save(start, "links")
    while now.count() > FOLD:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        large = save(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(least.select("a", F.col("low").alias("b")))
                 .where("a <> b").distinct())
        small = save(small, "small-star")
        # A star forest: no parent has a parent, no node has two.
        nested = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        twice = small.groupBy("a").count().where("count > 1")
        done = nested.select("a").unionByName(twice.select("a")).isEmpty()
        drop(now)
        drop(large)
        now = small
        if done:
            break
    else:
        small = save(now.coalesce(1).mapInArrow(_local_forest, edge), "forest")
        drop(now)
        now = small
    out = (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
           .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
    out._scratch_path = now._scratch_path
    return out
