"""Fuzzy line dedup by MinHash.

Lines are compared by the Jaccard similarity of their sets of character shingles (``SHINGLE``
characters; a shorter line is one shingle) and are near duplicates at ``SIMILARITY`` or more. A
line's signature holds 64 minima of shingle hashes: for each of 64 bins the smallest hash among the
shingles that fall into it (empty bins borrow from others by a fixed rule), so one hash per shingle
is enough. A line of at most ``FEW`` shingles would borrow too often; it takes the minima of 64 mixes
of its hashes instead, and lines near that border have both signatures, so that every pair that can
be similar has one in common. ``BANDS`` bands of ``ROWS`` minima give high-recall keys. Every
candidate is verified by exact Jaccard similarity; distributed union-find over the verified links
gives the components; the first line of a component (smallest document id, then text hash and line
number) stays.

Equal lines are merged first (128-bit hash), so a line in many documents is one row. In a bucket of
at most ``SMALL`` lines under one key every pair whose sketches do not rule the threshold out is a
candidate. A larger bucket falls into the groups that such sketches connect, which are buckets of their
own from then on (a piece of text that many unlike lines share makes no group). One that stays large
never sends all its pairs: each line is compared with the bucket's smallest
line (its leader), which links near copies in a star. Lines of a leader that are then still in
different components are compared as one block: bits for the leader's shingles and for hashes of the
others bound what two lines can share, and pairs that may be linked are verified until they are one
component. Leaders with too many lines for a block use the prefix rule: two lines at similarity 0.8 share at least 0.8 of each
one's shingles, so in any order of shingles they share one of the first 0.2 n + 1 of each. The order
takes the shingles that the leader lacks first: what a template has in common is in the leader and
becomes no key, and near copies of the leader that are one component meet nobody. The rule loses no
pair of a bucket, and rows grow with the lines, not with their square; the places of a shared shingle
bound what two lines can share from there on. Buckets stream through their
tasks; the joins are ordinary equi joins whose skewed keys Spark splits.

Defined cases: a null or empty text has no lines; blank lines are never duplicates and stay; rows
without an id keep all lines and are no source; rows with equal id and text share one decision;
all columns pass through, ``n_chars`` follows the new text; a document may become empty but is
never dropped here.
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
from pyspark.sql import types as T

from tickloom.llm.common import Names, chunks, components, documents, drop, free_shuffles, raw_texts, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
BINS = 64
BANDS = 12
ROWS = 5
#: Shingles up to which a line's signature takes true permutations.
FEW = 40
#: Lines of a bucket up to which its pairs are looked at one by one.
SMALL = 64
#: Lines of a bucket up to which it is split by sketches; a larger one streams as one star.
WHOLE = 4096
#: Bits for shingles that a leader lacks, where its lines are compared as a block.
OTHER = 256
#: Characters up to which the lines of a leader are one block.
BLOCK_CHARS = 1 << 23
#: Cells of band keys for each shuffle partition.
CELLS = 16
#: Rows of buckets that are looked at together.
BLOCK_ROWS = 1 << 18
#: Differing bits of two sketches of 64 up to which two lines of a small bucket are verified: at the
#: threshold 6.4 on average (deviation 2.4), 32 for unlike lines.
POSSIBLE = 14
EMPTY = np.uint32(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def line_id(line: bytes) -> tuple[int, int]:
    """128-bit identity of a line as two signed numbers."""
    d = xxhash.xxh3_128_digest(line)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the line of each."""
    padded = [t if len(t) >= SHINGLE else t.ljust(SHINGLE, "\0") for t in lines]
    size = np.array([len(t) for t in padded], np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = code[:len(code) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h *= np.uint64(0x100000001B3)
        h += code[k:k + len(h)]
    whole, ends = np.ones(len(h), bool), np.cumsum(size)[:-1]
    for k in range(1, SHINGLE):
        whole[ends - k] = False
    return mix(h[whole]), np.repeat(np.arange(len(lines)), size - SHINGLE + 1)


def signatures(h: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """Signature of each line: ``BINS`` minima, one hash per shingle."""
    flat = np.full(lines * BINS, EMPTY)
    np.minimum.at(flat, line * BINS + (h & np.uint64(BINS - 1)).astype(np.int64),
                  np.minimum((h >> np.uint64(32)).astype(np.uint32), EMPTY - np.uint32(1)))
    sig = flat.reshape(-1, BINS)
    own, left = sig != EMPTY, sig == EMPTY
    row, col = np.nonzero(left)
    step = 1
    while len(row):
        source = (col * 29 + step * 37 + 11) % BINS  # a fixed walk over all bins
        hit = own[row, source]
        sig[row[hit], col[hit]] = sig[row[hit], source[hit]] ^ np.uint32(step)
        row, col = row[~hit], col[~hit]
        step += 1
    return sig


#: Odd factors of the mixes, from a fixed rule.
FACTORS = mix(np.arange(1, BINS + 1, dtype=np.uint64)) | np.uint64(1)


def permuted(h: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """Signature of each line with a mix of its own for every minimum."""
    x = h[:, None] * FACTORS
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    start = np.searchsorted(line, np.arange(lines))
    return np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), start, axis=0)


def keys_of(sig: np.ndarray, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (a column per band) and one-bit sketches of signatures of one kind."""
    wide = sig.astype(np.uint64)
    keys = np.tile(np.arange(1 + kind * BANDS, 1 + (kind + 1) * BANDS, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, r:BANDS * ROWS:ROWS])
    bits = (mix(wide) >> np.uint64(17)).astype(np.uint8) & 1
    return keys, np.packbits(bits, axis=1).view(np.uint64)[:, 0]


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, line, sketch`` rows of some lines. With ``n`` shingles a line has the keys of true permutations
    up to FEW, and the others from 0.8 FEW on: of two lines at 0.8 one kind fits both."""
    h, line = hashes(lines)
    size = np.bincount(line, minlength=len(lines))
    keys, rows, sketches = [], [], []
    for kind, fits, make in ((0, size >= SIMILARITY * FEW, signatures), (1, size <= FEW, permuted)):
        some = np.flatnonzero(fits)
        if len(some):
            number = np.cumsum(fits) - 1
            own = slice(None) if len(some) == len(lines) else fits[line]
            key, sketch = keys_of(make(h[own], number[line[own]], len(some)), kind)
            keys.append(key.ravel())
            rows.append(np.repeat(some, BANDS))
            sketches.append(np.repeat(sketch, BANDS))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(sketches)


def _lines(text: bytes) -> list[bytes]:
    return text.split(b"\n") if text else []


def _positions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity and place of every line that is not blank."""
    for batch in chunks(batches):
        doc, row, line, ids = batch.column("doc_id"), [], [], []
        for i, text in enumerate(raw_texts(batch)):
            for n, one in enumerate(_lines(text)):
                if one.strip():
                    row.append(i)
                    line.append(n)
                    ids.append(line_id(one))
        pick = pa.array(row, pa.int64())
        h = np.array(ids, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), doc.take(pick), batch.column("text_hash").take(pick),
             pa.array(line, pa.int64())], ["h", "g", "doc", "text_hash", "line"])


def band_rows(cells: int):
    """``cell, rows`` of the different lines of each chunk: ``key, fp, node`` numbers, those of one cell
    of the keys packed into one value."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            seen, found = {}, []
            for text in raw_texts(batch):
                for one in _lines(text):
                    if one.strip():
                        seen[one] = None
            lines = list(seen)
            for at in range(0, len(lines), 128):  # few enough lines for the processor's caches
                part = lines[at:at + 128]
                key, row, sketch = band_keys([t.decode("utf-8", "replace") for t in part])
                node = np.array([line_id(t)[0] for t in part], np.int64)
                found.append(np.stack([key.view(np.int64), sketch.view(np.int64), node[row]], axis=1))
            if found:
                rows = np.concatenate(found)
                cell = (rows[:, 0].view(np.uint64) % np.uint64(cells)).astype(np.int32)
                order = np.argsort(cell, kind="stable")
                rows, cell = rows[order], cell[order]
                start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                ends = (np.append(start, len(cell)) * rows.itemsize * 3).astype(np.int32)
                packs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
                yield pa.RecordBatch.from_arrays([pa.array(cell[start]), packs], ["cell", "rows"])

    return run


def clusters(fp: np.ndarray) -> np.ndarray:
    """For each sketch the first one that it reaches over steps of at most POSSIBLE bits."""
    label, rest = np.empty(len(fp), np.int64), np.arange(len(fp))
    while len(rest):
        first, front, rest = rest[0], rest[:1], rest[1:]
        label[first] = first
        while len(front) and len(rest):
            near = (np.bitwise_count(fp[front[:64], None] ^ fp[rest]) <= POSSIBLE).any(axis=0)
            front = np.concatenate([front[64:], rest[near]])
            label[rest[near]] = first
            rest = rest[~near]
    return label


def bucket_pairs(key: np.ndarray, fp: np.ndarray, node: np.ndarray,
                 large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``a, b, more`` of whole buckets (sorted by key and node); ``large``: the first one goes on
    from rows before and holds its leader first."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    order, group = np.arange(len(key)), np.repeat(start, size)
    for s, n in zip(start[large:], size[large:], strict=True):
        if SMALL < n <= WHOLE:
            label = clusters(fp[s:s + n])
            order[s:s + n] = s + np.argsort(label, kind="stable")
            group[s:s + n] = s + np.sort(label)
    fp, node = fp[order], node[order]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    star = size > SMALL
    star[0] |= large
    row = np.repeat(star, size)
    lead = np.repeat(start, size)
    follow = np.flatnonzero(row & (node != node[lead]))
    left, right = [node[follow]], [node[lead[follow]]]
    at, lag = np.flatnonzero(~row), 1
    while len(at):
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]
        hit = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= POSSIBLE]
        left.append(np.maximum(node[hit], node[hit + lag]))
        right.append(np.minimum(node[hit], node[hit + lag]))
        lag += 1
    a, b = np.concatenate(left), np.concatenate(right)
    return a, b, np.arange(len(a)) < len(follow)


def _bucket_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the buckets of one task, whose rows come sorted by key. The last bucket of a block of
    rows waits for the next block, one beyond WHOLE with its leader only."""
    none = np.empty(0, np.int64)
    held, large, waiting = [none] * 3, False, []

    def block(last: bool) -> pa.RecordBatch | None:
        nonlocal held, large, waiting
        key, fp, node = (np.concatenate([h, *(w[i] for w in waiting)]) for i, h in enumerate(held))
        waiting = []
        if not len(key):
            return None
        # Most keys have one line; only the others are put in order.
        same = key[1:] == key[:-1]
        many = np.append(same, not last)
        many[1:] |= same
        many[0] |= large
        key, fp, node = key[many], fp[many], node[many]
        order = np.lexsort([node[large:], key[large:]]) + large
        order = np.concatenate([np.arange(int(large)), order])
        key, fp, node = key[order], fp[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, fp, node = key[fresh], fp[fresh], node[fresh]
        tail = len(key) if last else int(np.searchsorted(key, key[-1]))
        goes_on = not last and (len(key) - tail > WHOLE or (large and tail == 0))
        upto = len(key) if goes_on else tail
        held = [x[tail:tail + 1] if goes_on else x[upto:] for x in (key, fp, node)]
        was, large = large, goes_on
        if not upto:
            return None
        a, b, more = bucket_pairs(key[:upto], fp[:upto].view(np.uint64), node[:upto], was)
        return pa.RecordBatch.from_pydict({"a": a, "b": b, "more": more})

    for batch in batches:
        waiting.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "node")])
        if sum(len(w[0]) for w in waiting) >= BLOCK_ROWS:
            found = block(False)
            if found is not None:
                yield found
    found = block(True)
    if found is not None:
        yield found


def _cell_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the buckets of each cell; the packed rows come sorted by cell."""
    def pairs(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(packs), np.int64).reshape(-1, 3)
        order = np.argsort(rows[:, 0])
        return _bucket_rows(pa.RecordBatch.from_arrays([pa.array(rows[part, i]) for i in range(3)], ["key", "fp", "node"])
                            for at in range(0, len(order), BLOCK_ROWS) for part in [order[at:at + BLOCK_ROWS]])

    now, held = None, []
    for batch in batches:
        for cell, pack in zip(batch.column("cell").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            if cell != now and held:
                yield from pairs(held)
                held = []
            now = cell
            held.append(pack)
    if held:
        yield from pairs(held)


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """Distinct ``a, b, more`` of the lines of ``texts(text)``: pairs of small buckets, lines and leaders of
    large ones (``more``). A cell holds the buckets of some keys; it is what a task sorts at once."""
    cells = CELLS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(band_rows(cells), "cell int, rows binary")
    return (rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_pairs, "a long, b long, more boolean")
            .groupBy("a", "b").agg(F.bool_or("more").alias("more")))


def shingles(text: str) -> set[str]:
    return {text[i:i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def packed(text: str) -> np.ndarray | None:
    """Sorted distinct shingles, five 12-bit characters to a number; None where one does not fit."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < SHINGLE or code.max() >= 4096:
        return None
    out = np.zeros(len(code) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out << np.uint64(12) | code[k:k + len(out)]
    return np.unique(out)


def packed_all(texts: list[str]) -> list[np.ndarray | None]:
    """``packed`` of each text, the numbers made for all at once."""
    size = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if (size < SHINGLE).any() or code.max(initial=0) >= 4096:
        return [packed(t) for t in texts]
    number = np.zeros(max(len(code) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        number = number << np.uint64(12) | code[k:k + len(number)]
    out = []
    for stop, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True):
        own = np.sort(number[stop - n:stop - SHINGLE + 1])
        fresh = own[1:] != own[:-1]
        out.append(own if fresh.all() else own[np.concatenate([[True], fresh])])
    return out


def similarity(x: str, y: str, memo: Names) -> float:
    """Exact Jaccard similarity of two lines."""
    a, b = memo[x], memo[y]
    if a is None or b is None:
        return jaccard(shingles(x), shingles(y))
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in chunks(batches, "line_a", 1 << 20):
        for batch in chunks([whole], "line_b", 1 << 20):
            left, right = batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist()
            texts, memo = list({*left, *right}), Names(packed)
            memo.update(zip(texts, packed_all(texts), strict=True))
            near = [similarity(x, y, memo) for x, y in zip(left, right, strict=True)]
            kept = [n for n in batch.schema.names if n not in ("line_a", "line_b")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(near, pa.float64())], [*kept, "near"])


def with_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs`` of nodes ``a, b`` of ``lines(node, line)`` with both texts, ``line_a`` and ``line_b``."""
    def side(name: str) -> DataFrame:
        return lines.select(F.col("node").alias(name), F.col("line").alias(f"line_{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select(*pairs.columns, "line_a", "line_b")


def similarities(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs`` of nodes with their exact similarity, ``near``."""
    return with_lines(pairs, lines).mapInArrow(_similar, T.StructType([*pairs.schema, T.StructField("near", T.DoubleType())]))


def first_shingles(own: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """Of a line's distinct shingle hashes (sorted, like the leader's) those of which a line at
    ``SIMILARITY`` shares one: those the leader lacks come first, else by hash, which is one order for
    all lines of a leader."""
    count = len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1
    known = leader[np.minimum(np.searchsorted(leader, own), len(leader) - 1)] == own
    return np.concatenate([own[~known], own[known]])[:count]


def hash_sets(lines: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line."""
    h, line = hashes(lines)
    order = np.lexsort([h, line])
    h, line = h[order], line[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])
    h, line = h[fresh], line[fresh]
    return np.split(h, np.searchsorted(line, np.arange(1, len(lines))))


def sketches(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of sets of hashes: of their bins, and of true permutations up to FEW (else zero)."""
    size = np.array([len(x) for x in own])
    h, line = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    binned, true = keys_of(signatures(h, line, len(own)))[1].view(np.int64), np.zeros(len(own), np.int64)
    few = size <= FEW
    if few.any():
        pick, number = few[line], np.cumsum(few) - 1
        true[few] = keys_of(permuted(h[pick], number[line[pick]], int(few.sum())))[1].view(np.int64)
    return binned, true


def _prefix_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, node, comp, open, n, at, fp, fq``: a row per line of a leader and first shingle, ``at`` its
    place among the ``n`` of the line."""
    for batch in chunks(batches, "line_a", 1 << 18):
        for part in chunks([batch], "line_b", 1 << 18):
            own, lead = hash_sets(part.column("line_a").to_pylist()), hash_sets(part.column("line_b").to_pylist())
            first = [first_shingles(x, y) for x, y in zip(own, lead, strict=True)]
            count = np.array([len(f) for f in first])
            row = np.repeat(np.arange(len(first)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            leader = mix(part.column("b").to_numpy().view(np.uint64))
            pick, size = pa.array(row), np.array([len(x) for x in own], np.int32)
            fp, fq = sketches(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(np.concatenate(first) ^ leader[row]).view(np.int64)), part.column("a").take(pick),
                 part.column("a_is").take(pick), part.column("open").take(pick), pa.array(size[row]),
                 pa.array(at.astype(np.int32)), pa.array(fp[row]), pa.array(fq[row])],
                ["key", "node", "comp", "open", "n", "at", "fp", "fq"])


def shared_bits(own: list[np.ndarray], leader: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each set of hashes (those of the leader, then OTHER for the rest) and how many of the rest
    have no bit of their own: two sets share at most their common bits and the lesser of these counts."""
    size = np.array([len(x) for x in own])
    h, line = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    place = np.minimum(np.searchsorted(leader, h), len(leader) - 1)
    known = leader[place] == h
    place = np.where(known, place, len(leader) + (h % np.uint64(OTHER)).astype(np.int64))
    bits = np.zeros((len(own), -(-(len(leader) + OTHER) // 64) * 64), bool)
    bits[line, place] = True
    return np.packbits(bits, axis=1).view(np.uint64), size - bits.sum(axis=1)


def block_links(node: list[int], comp: list[int], lines: list[str], leader: str) -> Iterator[tuple[int, int]]:
    """Links that join the components of one leader's lines."""
    *own, lead = hash_sets([*lines, leader])
    size = np.array([len(x) for x in own])
    bits, over = shared_bits(own, lead)
    root, memo = {c: c for c in comp}, Names(packed)

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    now = np.array(comp)
    for at in range(1, len(own)):
        apart = np.flatnonzero((now[:at] != now[at]) & (size[:at] >= SIMILARITY * size[at] - 1e-9) & (size[at] >= SIMILARITY * size[:at] - 1e-9))
        most = np.bitwise_count(bits[apart] & bits[at]).sum(axis=1, dtype=np.int64) + np.minimum(over[apart], over[at])
        for to in apart[most >= SIMILARITY / (1 + SIMILARITY) * (size[apart] + size[at]) - 1e-6].tolist():
            x, y = find(comp[at]), find(comp[to])
            if x != y and similarity(lines[at], lines[to], memo) >= SIMILARITY:
                root[max(x, y)] = min(x, y)
                now[now == max(x, y)] = min(x, y)
                yield node[at], node[to]


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` among the lines of each leader, which come sorted by leader."""
    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, _, comp, lines, lead = map(list, zip(*rows, strict=True))
        found = np.array(list(block_links(node, comp, lines, lead[0])), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    held = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_is", "line_a", "line_b")), strict=True):
            if held and held[0][1] != row[1]:
                yield from links(held)
                held = []
            held.append(row)
    if held:
        yield from links(held)


def owed(first: DataFrame, label: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of large buckets, with texts, under leaders that have comparisons left: not all of a leader's
    lines are in its component."""
    of = [label.select(F.col("node").alias(n), F.col("component").alias(f"{n}_is")) for n in ("a", "b")]
    tagged = first.where("more").join(of[0], "a", "left").join(of[1], "b", "left") \
        .select("a", "b", F.coalesce("a_is", "a").alias("a_is"), F.coalesce("b_is", "b").alias("b_is")) \
        .withColumn("open", F.col("a_is") != F.col("b_is"))
    left = tagged.groupBy("b").agg(F.count_if("open").alias("n_open"), F.count(F.lit(1)).alias("n")).where("n_open > 0 and n > 1")
    return with_lines(tagged.join(left.select("b"), "b", "left_semi"), lines)


def hidden_links(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Links ``a, b`` between components of the lines of a leader in ``rows`` of ``owed``."""
    wide = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line_a")).alias("chars"), F.max(F.length("line_b")).alias("lead")) \
        .where((F.col("n") > WHOLE) | (F.col("chars") > BLOCK_CHARS) | (F.col("n") * F.col("lead") > BLOCK_CHARS)).select("b")
    blocks = rows.join(wide, "b", "left_anti").select("a", "b", "a_is", "line_a", "line_b") \
        .repartition("b").sortWithinPartitions("b", "a").mapInArrow(_block_rows, "a long, b long")
    if wide.isEmpty():
        return blocks
    prefixes = save(rows.join(wide, "b", "left_semi").select("b", "a", "a_is", "b_is", "open", "line_a", "line_b").mapInArrow(
        _prefix_rows, "key long, node long, comp long, open boolean, n int, at int, fp long, fq long"), "prefixes")
    near = similarities(hidden_pairs(prefixes), lines).where(F.col("near") >= SIMILARITY)
    return blocks.unionByName(near.select("a", "b"))


def hidden_pairs(rows: DataFrame) -> DataFrame:
    """Distinct ``a, b`` in different components that share a key and whose sizes, places of the key and
    sketches (of true permutations for two lines of few shingles) allow a link."""
    # A key whose lines are all of one component, as among copies of the leader, joins nothing.
    mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    x, y = (rows.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "open", "n", "at", "fp", "fq")])
            for side in ("x", "y"))
    sizes = (F.col("n_x") >= SIMILARITY * F.col("n_y") - 1e-9) & (F.col("n_y") >= SIMILARITY * F.col("n_x") - 1e-9)
    # Two lines share no shingle before the first key that they share.
    shared = SIMILARITY / (1 + SIMILARITY) * (F.col("n_x") + F.col("n_y")) - 1e-6
    places = (F.col("n_x") - F.col("at_x") >= shared) & (F.col("n_y") - F.col("at_y") >= shared)
    differ = F.when(F.greatest("n_x", "n_y") <= FEW, F.col("fq_x").bitwiseXOR(F.col("fq_y"))).otherwise(F.col("fp_x").bitwiseXOR(F.col("fp_y")))
    return (x.where("open_x").join(y, "key")
            .where((F.col("comp_x") != F.col("comp_y")) & (~F.col("open_y") | (F.col("node_x") < F.col("node_y")))
                   & sizes & places & (F.bit_count(differ) <= POSSIBLE))
            .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct())


def verify(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Verified links ``a, b`` between the nodes of ``lines(node, line)``, from ``candidate_pairs`` of them."""
    first = save(similarities(pairs, lines), "similar")
    free_shuffles(first.sparkSession)
    linked = first.where(F.col("near") >= SIMILARITY).select("a", "b")
    stars = components(linked)
    label = save(stars, "label")
    drop(stars)
    rows = save(owed(first, label, lines), "owed")
    free_shuffles(first.sparkSession)
    links = save(linked.unionByName(hidden_links(rows, lines)), "links")
    for done in (first, label, rows):
        drop(done)
    return links


def removals(docs: DataFrame) -> DataFrame:
    """``doc, text_hash, drop``: the line numbers that each document loses."""
    spark = docs.sparkSession
    own = documents(docs).where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    where = save(own.mapInArrow(_positions, "h long, g long, doc long, text_hash long, line long"), "lines")
    found = save(candidate_pairs(own.select("text")), "candidates")
    free_shuffles(spark)
    asked_for = (found.select(F.col("a").alias("h")).unionByName(found.select(F.col("b").alias("h"))).distinct()
                 .withColumn("wanted", F.lit(True)))
    place = F.struct("doc", "text_hash", "line")
    # Different lines that occur once and met no other one lose nothing.
    once = save(where.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .join(asked_for, "h", "left").where("n > 1 or wanted"), "classes")
    # Text of the lines in candidate pairs, read from the first document that holds each.
    asked = (once.where("wanted").select(
        "h", "g", F.col("first.doc").alias("doc_id"), F.col("first.text_hash").alias("text_hash"),
        F.col("first.line").alias("line"))
        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("line", "h", "g")).alias("asked")))

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(q["h"], q["g"], lines[q["line"]].decode("utf-8", "replace"))
                    for lines, qs in zip(map(_lines, raw_texts(batch)), batch.column("asked").to_pylist(), strict=True)
                    for q in qs]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in
                                              zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)],
                                             ["h", "g", "line"])

    # A line is known by the half of its hash that the pairs hold; repeated rows give it once.
    members = save(own.join(asked.hint("shuffle_hash"), ["doc_id", "text_hash"])
                   .mapInArrow(fetch, "h long, g long, line string").dropDuplicates(["h", "g"])
                   .select(F.col("h").alias("node"), "line"), "members")
    free_shuffles(spark)
    links = verify(found, members)
    label = components(links)
    classes = once.withColumn("node", F.col("h")).join(label, "node", "left")
    # Components of one different line that occurs once lose nothing; leave them out early.
    classes = save(classes.where("n > 1 or component is not null")
                   .withColumn("class", F.coalesce("component", "node")).select("h", "g", "first", "class"), "named")
    best = classes.groupBy("class").agg(F.min("first").alias("best"))
    chosen = classes.join(best, "class").select("h", "g", "best")
    gone = save(where.join(chosen, ["h", "g"]).where(place != F.col("best"))
                .groupBy("doc", "text_hash").agg(F.collect_set("line").alias("drop")), "removals")
    for done in (where, found, once, members, links, label, classes):
        drop(done)
    return gone


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns; of each component of near-duplicate lines one line stays."""
    gone = removals(docs).select(F.col("doc").alias("__tl_doc"), F.col("text_hash").alias("__tl_hash"), F.col("drop").alias("__tl_drop"))
    joined = docs.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("__tl_doc"))
                       & (F.xxhash64(F.col("text").cast("string")) == F.col("__tl_hash")), "left").drop("__tl_doc", "__tl_hash")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            at, chars = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            texts, drops = batch.column(at).to_pylist(), batch.column("__tl_drop").to_pylist()
            out, count = [], batch.column(chars).to_pylist() if chars >= 0 else []
            for i, (text, drop) in enumerate(zip(texts, drops, strict=True)):
                if drop:
                    lost = set(drop)
                    text = "\n".join(t for n, t in enumerate(text.split("\n")) if n not in lost)
                    if chars >= 0:
                        count[i] = len(text)
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            if chars >= 0:
                columns[chars] = pa.array(count, batch.schema.field(chars).type)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__tl_drop"]
            yield pa.RecordBatch.from_arrays([columns[i] for i in keep], schema=pa.schema([batch.schema.field(i) for i in keep]))

    return joined.mapInArrow(apply, docs.schema)


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every document after dedup of lines."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = F.when(F.length("text") > 0, breaks + 1).otherwise(0).cast("long")
    after = dedup_lines(documents(docs).withColumn("n_lines", F.coalesce(lines, F.lit(0).cast("long"))))
    kept = F.coalesce(lines, F.lit(0).cast("long"))
    return after.select("doc_id", "n_lines", (F.col("n_lines") - kept).alias("n_removed"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
