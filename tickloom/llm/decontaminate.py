"""Benchmark decontamination with suffix arrays of the training text.

Documents are read in shards (some megabytes of text inside one task). A shard's suffix array
orders the suffixes of its word sequence; every test suffix of the benchmark that is long enough
for a window is binary-searched in it, which gives all places of its first window, and places on
one diagonal join to the longest verbatim matches with their locations (``matches``). For the report
and the removal only covered words and item names are needed, so places are joined as ranges per
window and no place is paired with a use; a word repeated through a document and an item costs no
more than any other. Suffixes that cannot match
(their first words start no test suffix) are left out of the array before it is sorted. Documents
are never shuffled.

The benchmark is the query set: it is taken in blocks of at most ``BLOCK_BYTES`` of text (one
longer item is a block of its own), each block is broadcast, and the documents flow through one
pass per block. Every pass but the last is written to the shared folder, then its broadcast is
destroyed, so one block is held at a time whatever the size of the benchmark. (``matches`` keeps
the broadcasts of all its blocks until it is read.)

Defined cases: a null or empty text has no words and is clean; an item without words matches
nothing; an item shorter than a window is one window; matches never cross documents; items with
equal ids count once; an item with a null id counts and is written as an empty string; extra
columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import chunks, documents, drop, raw_texts, save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Letters and digits stay (A-Z as a-z), bytes of other scripts stay, the rest separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Block:
    """Test suffixes of some items: ids of their words, one row per distinct window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.vocab: dict[bytes, int] = {}
        rows: dict[int, list[tuple]] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                rows.setdefault(size, []).append((tuple(ids[at:at + size]), number[name], at))
        #: size -> (distinct windows, first use of each, items of the uses, places of the uses)
        self.windows = {}
        #: size -> (first name of each window, different items of each window)
        self.items_of = {}
        for size, got in rows.items():
            got.sort()
            seq = np.array([g[0] for g in got], np.int64).reshape(len(got), size)
            new = np.flatnonzero(np.concatenate([[True], (seq[1:] != seq[:-1]).any(1)]))
            self.windows[size] = (seq[new], np.concatenate([new, [len(got)]]),
                                  np.array([g[1] for g in got]), np.array([g[2] for g in got]))
            of = np.repeat(np.arange(len(new)), np.diff(self.windows[size][1]))
            pair = np.unique(of * len(self.names) + self.windows[size][2])
            self.items_of[size] = (np.searchsorted(pair // len(self.names), np.arange(len(new) + 1)),
                                   pair % len(self.names))
        # Pairs (or single words, where some window has one word) that begin a test suffix.
        self.lead = min(2, min(self.windows, default=2))
        width = len(self.vocab) + 1
        self.starts = np.unique(np.concatenate(
            [seq[:, 0] * width + seq[:, 1] if self.lead == 2 else seq[:, 0]
             for seq, *_ in self.windows.values()] or [np.empty(0, np.int64)]))

    def suffixes(self, ids: np.ndarray) -> np.ndarray:
        """Suffix array (sorted start positions) over the ids of a shard, padded by a window."""
        head = ids[:-self.window]
        if self.lead == 2:
            head = np.where(head > 0, head * (len(self.vocab) + 1) + ids[1:len(head) + 1], 0)
        if not len(self.starts):
            return np.empty(0, np.int64)
        slot = np.minimum(np.searchsorted(self.starts, head), len(self.starts) - 1)
        at = np.flatnonzero((self.starts[slot] == head) & (ids[:len(head)] > 0))
        return at[np.lexsort([ids[at + k] for k in range(self.window - 1, -1, -1)])]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per window size: the windows that occur in a shard, one entry per place, and the places."""
        order = self.suffixes(ids)
        for size, (seq, *_) in self.windows.items():
            low, high = bound(ids, order, seq, False), bound(ids, order, seq, True)
            window, at = ranges(low, high)
            yield size, window, order[at]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows: (item, place in the item, place in the shard, size)."""
        out = [np.empty((4, 0), np.int64)]
        for size, window, at in self.hits(ids):
            _, use, item, place = self.windows[size]
            row, used = ranges(use[window], use[window + 1])
            out.append(np.stack([item[used], place[used], at[row], np.full(len(row), size)]))
        return tuple(np.concatenate(out, axis=1))


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from ``low`` up to ``high`` of every row, with their rows."""
    size = high - low
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


def bound(ids: np.ndarray, order: np.ndarray, seq: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every row of ``seq`` among the suffixes, all rows a step at a time."""
    low = np.zeros(len(seq), np.int64)
    high = np.full(len(seq), len(order))
    size = seq.shape[1]
    row = np.arange(len(seq))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        word = ids[order[np.minimum(mid, len(order) - 1)][:, None] + np.arange(size)]
        differ = word != seq
        first = differ.argmax(1)
        equal = ~differ[row, first]
        less = (word[row, first] < seq[row, first]) | (equal & after)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)


def longest(item: np.ndarray, place: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Window hits joined along their diagonals: rows (item, place, position, length)."""
    order = np.lexsort([at, at - place, item])
    item, place, at, size = item[order], place[order], at[order], size[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - place[1:] != at[:-1] - place[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first
    return np.stack([item[first], place[first], at[first], at[last] - at[first] + size[last]])


def shard(texts: list[bytes], block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of the texts, a separator after each, and where each text starts."""
    get = block.vocab.get
    parts, starts, at = [], [0], 0
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        parts.append(np.array([-1]))
        at += len(words) + 1
        starts.append(at)
    parts.append(np.full(block.window, -1))
    return np.concatenate(parts), np.array(starts)


def blocks_of(benchmark: DataFrame, window: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded text; only one block is in the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.col("text").cast("string").alias("text")).where("text is not null")
    held, size = [], 0
    for row in items.toLocalIterator():
        raw = row.text.encode()
        if held and size + len(raw) > BLOCK_BYTES:
            yield Block(held, window)
            held, size = [], 0
        held.append((row.item, raw))
        size += len(raw)
    yield Block(held, window)


def _inspect(texts: list[bytes], block: Block):
    """Per text: number of words, spans (start, end) of words inside windows, names of the items."""
    ids, starts = shard(texts, block)
    edges = np.zeros(len(ids) + 1, np.int64)
    pairs = [np.empty(0, np.int64)]
    width = max(1, len(block.names))
    for size, window, at in block.hits(ids):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + size, -1)
        first, names = block.items_of[size]
        seen = np.unique((np.searchsorted(starts, at, side="right") - 1) * len(first) + window)
        doc, window = seen // len(first), seen % len(first)
        row, used = ranges(first[window], first[window + 1])
        pairs.append(np.unique(doc[row] * width + names[used]))
    # Windows end before the separator that follows a text, so no run goes over into the next one.
    inside = np.diff(np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    doc = np.searchsorted(starts, begin, side="right") - 1
    spans: list[list] = [[] for _ in texts]
    found: list[set] = [set() for _ in texts]
    for d, a, z in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist(), strict=True):
        spans[d].append((a, z))
    for pair in np.concatenate(pairs).tolist():
        found[pair // width].add(block.names[pair % width])
    return np.diff(starts) - 1, spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any span."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    blocks = blocks_of(benchmark, window)
    share = docs.sparkSession.sparkContext.broadcast
    state, block, first = documents(docs), next(blocks), True
    for following in blocks:
        state, block, first = _settle(_pass(state, held := share(block), first, False), held, state), following, False
    return _pass(state, share(block), first, True)


def _settle(done: DataFrame, held, before: DataFrame) -> DataFrame:
    """A pass written to the shared folder; its broadcast and the table it read are let go of."""
    out = save(done, "decontamination")
    held.destroy()
    drop(before)
    return out


def _pass(state: DataFrame, block, first: bool, last: bool) -> DataFrame:
    """One block over all documents; what earlier blocks found travels along."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n, spans, found = _inspect(raw_texts(batch), block.value)
            if not first:
                for i, (s, f) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(),
                                               strict=True)):
                    spans[i] += [(x["start"], x["end"]) for x in s]
                    found[i] |= set(f)
            if not last:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"),
                     pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
                     pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                    ["doc_id", "text", "spans", "items"])
                continue
            hit = [covered(s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found], pa.string()),
                 pa.array([h > 0 for h in hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return state.mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last
        else "doc_id long, text string, spans array<struct<start:long,end:long>>, items array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, doc_word, item_word, n_words``: every longest verbatim match and its place."""
    out = None
    for block in blocks_of(benchmark, window):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in chunks(batches):
                ids, starts = shard(raw_texts(batch), block)
                item, place, at, size = longest(*block.search(ids))
                doc = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array([block.names[i] for i in item], pa.string()),
                     pa.array(at - starts[doc]), pa.array(place), pa.array(size)],
                    ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        part = documents(docs).mapInArrow(
            run, "doc_id long, item_id string, doc_word long, item_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window."""
    blocks = blocks_of(benchmark, window)
    share = docs.sparkSession.sparkContext.broadcast
    block = next(blocks)
    for following in blocks:
        docs, block = _settle(_clean(docs, held := share(block)), held, docs), following
    return _clean(docs, share(block))


def _clean(docs: DataFrame, shared) -> DataFrame:
    """The rows without a window of one block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, spans, _ = _inspect(raw_texts(batch), shared.value)
            yield batch.filter(pa.array([not s for s in spans], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
