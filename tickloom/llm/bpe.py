"""BPE encoding and decoding with a public vocabulary.

A short word is held as one contiguous array of part boundaries with the merge rank of each
adjacent pair beside it. The array is scanned for the smallest rank, that boundary is deleted,
the two neighbouring ranks are refreshed, and so on until no adjacent pair merges. A long word (a
run of letters without a break) is held as linked parts with a heap of ranks, which merges the same
pairs in the same order in n log n steps. Words repeat, so each task keeps a bounded memo of encoded
short words; texts are never shuffled.

Defined cases: a null or empty text has no ids and decodes to the empty text; extra columns are
ignored; a very long text, also one of a single word, is one row like any other (it is encoded in
one task, n log n in its length); repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tickloom.llm.common import Names, chunks, documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A rank above every merge: this pair does not merge.
NO_MERGE = 1 << 30
#: Letters (bytes) up to which a word is an array that is scanned.
SHORT = 128


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others take the code points from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ShortNames(Names):
    """A memo that keeps short words only, so its size is bounded in bytes."""

    def __missing__(self, word):
        return super().__missing__(word) if len(word) <= SHORT else self.make(word)


class WordBpe:
    """Encoder and decoder of one ``tokenizers`` JSON file with byte-level parts and word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.end: str = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        # Without a decoder in the file, decoding joins the parts as they stand in the vocabulary.
        self.parts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.memo = ShortNames(self._word_bytes)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word, by boundaries and adjacent ranks."""
        text = [self.letters[b] for b in word.encode("utf-8")]
        if not text:
            return []
        text[-1] += self.end
        if len(text) > SHORT:
            return [self.vocab[p] for p in self.linked_parts(text) if p in self.vocab]
        ranks, joined = self.ranks, "".join
        start = list(range(len(text) + 1))
        rank = [ranks.get((text[i], text[i + 1]), NO_MERGE) for i in range(len(text) - 1)]
        while rank:
            low = min(rank)
            if low == NO_MERGE:
                break
            at = rank.index(low)
            del start[at + 1], rank[at]
            part = joined(text[start[at]:start[at + 1]])
            if at:
                rank[at - 1] = ranks.get((joined(text[start[at - 1]:start[at]]), part), NO_MERGE)
            if at < len(rank):
                rank[at] = ranks.get((part, joined(text[start[at + 1]:start[at + 2]])), NO_MERGE)
        vocab = self.vocab
        return [vocab[p] for p in (joined(text[a:b]) for a, b in zip(start, start[1:], strict=False)) if p in vocab]

    def linked_parts(self, parts: list[str]) -> list[str]:
        """The merged parts of a long word: smallest rank first, ties from the left. An entry of the
        heap counts while its rank is still that of the part it starts at."""
        get, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [get(pair, NO_MERGE) for pair in zip(parts, parts[1:], strict=False)] + [NO_MERGE]
        heap = [(r, i) for i, r in enumerate(rank) if r != NO_MERGE]
        heapq.heapify(heap)
        while heap:
            low, at = heapq.heappop(heap)
            if rank[at] != low:
                continue
            gone = after[at]
            parts[at] += parts[gone]
            parts[gone], rank[gone] = "", NO_MERGE
            following = after[at] = after[gone]
            if following < n:
                before[following] = at
            for left, right in ((at, following), (before[at], at)):
                if left >= 0:
                    rank[left] = get((parts[left], parts[right]), NO_MERGE) if right < n else NO_MERGE
                    if rank[left] != NO_MERGE:
                        heapq.heappush(heap, (rank[left], left))
        return [p for p in parts if p]

    def _word_bytes(self, word: str) -> bytes:
        return np.array(self.encode_word(word), "<u4").tobytes()

    def words(self, text: str) -> list[str]:
        """Pre-split words. Letters and digits too young for the library count as symbols, as they
        do there; stand-ins keep the pattern from reading them."""
        young = sorted(set(YOUNG_LETTERS.findall(text))) if not text.isascii() else None
        if not young:
            return self.pattern(text)
        free = (chr(c) for c in range(0xF0000, 0x10FFFE) if chr(c) not in text)
        swap = dict(zip(young, free, strict=False))
        back = str.maketrans({v: k for k, v in swap.items()})
        return [w.translate(back) for w in self.pattern(text.translate(str.maketrans(swap)))]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.words(normalise(text))))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; special marks keep their ids."""
        if not text:
            return b""
        if self.specials is None:
            return self._plain(text)
        out = []
        for i, piece in enumerate(self.specials.split(text)):
            out.append(np.uint32(self.special[piece]).astype("<u4").tobytes() if i % 2 else self._plain(piece))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The parts of the ids, separated by spaces as the file asks for no decoder."""
        return " ".join(map(self.parts.__getitem__, ids))


# Combining marks (and one composition) that are younger than the library's
# normalisation tables; to it they are plain characters, so nothing is reordered or joined across.
PLAIN_MARKS = regex.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85"
    "\U00011070\U0001133b\U0001145e\U00011839-\U0001183a\U00011930\U00011938\U0001193d-\U0001193e\U00011943"
    "\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42"
    "\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])")
# Letters and digits that the pattern module knows and the library does not.
YOUNG_LETTERS = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    "\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f]")
# Capitals younger than this Python's Unicode tables, with their small letters.
YOUNG_CAPITALS = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
     0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)})
RARE = frozenset(map(chr, YOUNG_CAPITALS))


def normalise(text: str) -> str:
    """NFC and lower case, code point by code point (no rule for a final sigma)."""
    if text.isascii():
        return text.lower()
    if PLAIN_MARKS.search(text):
        text = "".join(unicodedata.normalize("NFC", part) for part in PLAIN_MARKS.split(text))
    else:
        text = unicodedata.normalize("NFC", text)
    text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
    return text if RARE.isdisjoint(text) else text.translate(YOUNG_CAPITALS)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of every whole text of ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(path)
        for batch in chunks(batches):
            raw = [bpe.encode_bytes(t) for t in batch.column("text").to_pylist()]
            ids = [np.frombuffer(r, "<u4").astype(np.int32) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([bpe.decode(i.tolist()) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of what they decode to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = WordBpe.load(path), hashlib.sha256
        for batch in chunks(batches):
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                raw = bpe.encode_bytes(text)
                n.append(len(raw) // 4)
                ids_sha.append(sha(raw).hexdigest())
                text_sha.append(sha(bpe.decode(np.frombuffer(raw, "<u4").tolist()).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
