"""Embedding near-dedup with spherical k-means cells and blocked cosine products.

Vectors of one label and length are assigned to the nearest of the label's centroids. Centroids are
fitted on a hashed sample of about ``SAMPLE`` distinct vectors per label and number about one per
``CELL`` vectors; every vector is assigned. A pair may straddle two cells: then one of the two is
within half their distance of the plane between the centroids. So a vector also visits each cell
whose plane is that near, and no pair at or above the threshold is lost, whatever the centroids
are; a pair that meets in both cells counts in the lower one only.

Inside a cell vectors are dealt into blocks of about ``BLOCK`` and every two blocks are one group:
a task multiplies two bounded matrices, adds up links per vector, and sends on a forest of links,
never pairs. Equal vectors are merged first and counted by weight. Components come from distributed
union-find.

Defined cases: a vector or label that is null, and vectors that are empty, zero or hold null or
non-finite components, link with nothing; so do rows without an id; vectors of different lengths
never link; repeated rows are vectors of their own (linked with each other); extra columns are
ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import components, forest, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.93
CELL = 2000
#: Expected number of distinct vectors per label that the centroids are fitted on.
SAMPLE = 20_000
#: Most centroids over all labels, the bound of the broadcast; larger cells are cut into blocks.
MAX_CELLS = 32_768
BLOCK = 2048
ROUNDS = 8


def fit_cells(vectors: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Spherical k-means: unit centroids that maximise the cosine to their vectors."""
    rng = np.random.default_rng(seed)
    centre = vectors[np.sort(rng.choice(len(vectors), k, replace=False))].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(vectors[a:a + 4096] @ centre.T).argmax(1) for a in range(0, len(vectors), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, vectors)
        size = np.linalg.norm(total, axis=1)
        moved = size > 1e-12
        centre[moved] = total[moved] / size[moved, None]
    return centre


def assign(vectors: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest cell of each vector, and a table of the other cells that it visits."""
    margin = math.sqrt(2 - 2 * threshold) / 2 + 1e-9
    cos = vectors @ centre.T
    home = cos.argmax(1)
    gap = np.sqrt(np.maximum(2 - 2 * (centre @ centre.T), 0))[home]
    near = cos[np.arange(len(cos)), home][:, None] - cos <= margin * gap
    near[np.arange(len(cos)), home] = False
    return home, near


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that very large and very small components survive."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links of one pair of blocks of one cell: per vector the weight it gains, and forest edges."""
    low = table.column("bi")[0].as_py()
    high = table.column("bj")[0].as_py()
    cell = table.column("cell")[0].as_py()
    block = table.column("block").to_numpy()
    node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
    home, unit = table.column("home").to_numpy(), _matrix(table.column("unit"))
    lists = table.column("visits").to_pylist()
    wide = int(home.max()) + 1  # visits to cells beyond every home cannot matter
    visits = np.array([i * wide + c for i, x in enumerate(lists) for c in x if c < wide], np.int64)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    near = unit[left] @ unit[right].T >= threshold
    if low == high:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    # One of the two must live here; if the other lives in a lower cell that this one visits, the
    # pair has been counted there.
    here_a, here_b = home[a] == cell, home[b] == cell
    keep = here_a | here_b
    inside, other = np.where(here_a, a, b), np.where(here_a, b, a)
    keep &= (here_a == here_b) | (home[other] >= cell) | ~np.isin(inside * wide + home[other], visits)
    a, b = a[keep], b[keep]
    gain = np.zeros(len(node), np.int64)
    np.add.at(gain, a, weight[b])
    np.add.at(gain, b, weight[a])
    linked = np.flatnonzero(gain)
    found, root = forest(a, b)
    to = dict(zip(found.tolist(), root.tolist(), strict=True))
    return pa.table({"node": pa.array(node[linked], pa.int64()), "links": pa.array(gain[linked], pa.int64()),
                     "to": pa.array([int(node[to[i]]) for i in linked.tolist()], pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    usable = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0.0), F.lit(False))
    rows = rows.withColumn("ok", usable)
    # Equal vectors once, under a node id of their own; weight counts their rows.
    distinct = save(
        rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .withColumn("node", F.xxhash64("label", "v", "rep")).withColumn("dim", F.size("v")), "vectors")
    links = _links(distinct, threshold)
    gained = links.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = (distinct.select("label", "v", "rep", "weight", "node").join(gained, "node", "left")
             .join(label, "node", "left").withColumn("class", F.coalesce("component", "node")))
    least = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    full = named.join(least, "class").select(
        F.col("label").alias("l"), F.col("v").alias("w"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = (rows.where("ok").join(full, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")))
           .select("vec_id", "n_links", "component_id")
           .unionByName(rows.where("not ok").select(
               "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(distinct: DataFrame, threshold: float) -> DataFrame:
    """``node, links, to``: weight of the links found in each comparison, and a link of the forest."""
    spark = distinct.sparkSession
    kind = ["label", "dim"]
    # Labels large enough for several cells: the largest ones first, as far as the bound goes.
    large = [(r.label, r.dim, r["count"]) for r in
             distinct.groupBy(*kind).count().where(F.col("count") > CELL)
             .orderBy(F.desc("count"), *kind).limit(MAX_CELLS // 2).collect()]
    total = sum(n for *_, n in large)
    cells = {(lab, d): max(1, min(-(-n // CELL), int(MAX_CELLS * n / total), SAMPLE // 20)) for lab, d, n in large}
    centres: dict[tuple[int, int], np.ndarray] = {}
    if cells:
        share = spark.createDataFrame([(lab, d, min(1.0, SAMPLE / n)) for lab, d, n in large],
                                      "label long, dim int, share double")
        drawn = (distinct.join(share, kind)
                 .where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
                 .select("label", "dim", "node", "v"))

        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by("node")
            key = table.column("label")[0].as_py(), table.column("dim")[0].as_py()
            unit = _unit(_matrix(table.column("v")))
            made = fit_cells(unit, min(cells[key], len(unit)))
            return pa.table({"label": pa.array([key[0]] * len(made), pa.int64()),
                             "dim": pa.array([key[1]] * len(made), pa.int32()),
                             "centre": pa.array(list(made), pa.list_(pa.float64()))})

        got = drawn.groupBy(*kind).applyInArrow(fit, "label long, dim int, centre array<double>").collect()
        for r in got:
            centres.setdefault((r.label, r.dim), []).append(r.centre)
        centres = {k: np.array(v) for k, v in centres.items()}
    shared = spark.sparkContext.broadcast(centres)  # at most MAX_CELLS vectors

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            dim = batch.column("dim").to_numpy(zero_copy_only=False)
            for key in sorted(set(zip(label.tolist(), dim.tolist(), strict=True))):
                part = batch.take(pa.array(np.flatnonzero((label == key[0]) & (dim == key[1]))))
                unit = _unit(_matrix(part.column("v")))
                home, near = (assign(unit, centres[key], threshold) if key in centres
                              else (np.zeros(len(unit), np.int64), np.zeros((len(unit), 1), bool)))
                row, cell = np.nonzero(near)
                row = np.concatenate([np.arange(len(unit)), row])
                cell = np.concatenate([home, cell])
                visits = [np.flatnonzero(n) for n in near]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").take(pa.array(row)), part.column("dim").take(pa.array(row)),
                     pa.array(cell, pa.int64()), pa.array(home[row], pa.int64()), part.column("node").take(pa.array(row)),
                     part.column("weight").take(pa.array(row)),
                     pa.array(list(unit), pa.list_(pa.float64())).take(pa.array(row)),
                     pa.array(visits, pa.list_(pa.int64())).take(pa.array(row))],
                    ["label", "dim", "cell", "home", "node", "weight", "unit", "visits"])

    dealt = save(distinct.select("label", "dim", "node", "weight", "v").mapInArrow(
        deal, "label long, dim int, cell long, home long, node long, weight long, unit array<double>, "
              "visits array<long>"), "cells")
    size = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = (dealt.join(size, ["label", "dim", "cell"])
               .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
               .drop("blocks", "other"))
    return save(blocked.groupBy("label", "dim", "cell", "bi", "bj").applyInArrow(
        lambda t: _compare(t, threshold), "node long, links long, to long"), "links")
