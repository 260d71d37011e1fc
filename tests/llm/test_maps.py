"""Operators without a shuffle: BPE, decontamination, quality classifier."""

import hashlib
import random
import re
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import key, prose, texts
from tickloom.llm import bpe, decontaminate, quality

tokenizers = pytest.importorskip("tokenizers")
vocab = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(vocab)
OWN = bpe.WordBpe.load(vocab)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def same_as_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(text):
    same_as_library(text)


@pytest.mark.parametrize("text", [
    "", " ", "Hello, World! don't 'LL've", "ΑΣ ΣΑΣ Σ", "İstanbul ﬁ ẞ é", "x<|endoftext|>Y <|startoftext|>", "\x00\u0085​",
    "日本語 한국어 ½ Ⅷ ٣", "🙂👨‍👩‍👧", "a" * 3000, "aͅb ΐ", "<|ENDOFTEXT|>"])
def test_bpe_cases(text):
    same_as_library(text)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "aé日"])
def test_bpe_long_words(letters):
    """A run of letters without a break: linked parts give the ids of the array, in n log n steps."""
    rng = random.Random(8)
    for size in (bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 700):
        word = "".join(rng.choice(letters) for _ in range(size))
        same_as_library(word)
        same_as_library(f"{word} {word}. x")
    start = time.process_time()
    word = "".join(rng.choice(letters) for _ in range(100_000))
    ids = OWN.encode(word)
    assert time.process_time() - start < 10
    assert ids == LIBRARY.encode(word, add_special_tokens=False).ids


def test_bpe_documents(odd_documents, no_documents):
    got = sorted(map(tuple, bpe.round_trip_digests(odd_documents, vocab).collect()), key=key)
    want = []
    for doc, text in texts(odd_documents):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc, len(ids), sha(raw), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=key)
    assert bpe.round_trip_digests(no_documents, vocab).collect() == []
    row = bpe.encode_documents(odd_documents.where("doc_id = 403"), vocab).first()
    assert row.ids == LIBRARY.encode("word", add_special_tokens=False).ids and row.decoded == "word</w>"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_words_by_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abZ09 .,-_éÉ日\n'`{") for _ in range(40))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert [w.decode() for w in decontaminate.words_of(text.encode())] == WORD.findall(low)


def brute_hits(docs, items, window=10):
    split = lambda t: [w.decode() for w in decontaminate.words_of((t or "").encode())]
    windows = {}
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a:a + n]), set()).add(name)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=key)


@pytest.fixture(scope="module")
def benchmark_items(spark, odd_documents):
    rng = random.Random(9)
    source = [t for _, t in sorted(texts(odd_documents), key=key) if t and len(t) > 400]
    items = [(i, " ".join(t.split()[5:25])) for i, t in enumerate(source[:8])]
    items += [(20, "word"), (21, ""), (22, None), (23, "ünïcode"), (24, prose(rng, 30)), (0, prose(rng, 12)),
              (25, " ".join(source[0].split()[8:17])), (None, " ".join(source[2].split()[0:14]))]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_decontamination(spark, odd_documents, no_documents, benchmark_items, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [("" if r.item_id is None else str(r.item_id), r.text) for r in benchmark_items.collect()]
    got = sorted(map(tuple, decontaminate.report(odd_documents, benchmark_items).collect()), key=key)
    want = brute_hits(texts(odd_documents), items)
    assert got == want
    assert any(w[5] for w in want) and not all(w[5] for w in want)
    left = decontaminate.remove_contaminated(odd_documents, benchmark_items)
    assert left.columns == odd_documents.columns
    assert left.count() == sum(not w[5] for w in want)
    assert decontaminate.report(no_documents, benchmark_items).collect() == []
    clean = decontaminate.report(odd_documents, benchmark_items.limit(0)).collect()
    assert len(clean) == len(want) and not any(r.contaminated for r in clean)


@pytest.mark.parametrize("words", ["a", "a b", "a b c a"])
def test_repeated_words_stay_small(words):
    """A word that fills a document and an item: places are never paired with uses."""
    text, item = (words.split() * 20_000)[:20_000], (words.split() * 2_000)[:2_000]
    block = decontaminate.Block([(str(i), " ".join(item[i:]).encode()) for i in range(3)])
    tracemalloc.start()
    n, spans, found = decontaminate._inspect([" ".join(text).encode(), b"x a x", " ".join(text[:50]).encode()], block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [20_000, 3, 50] and spans == [[(0, 20_000)], [], [(0, 50)]] and peak < 60 << 20
    assert found == [{"0", "1", "2"}, set(), {"0", "1", "2"}]


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(40)) + " y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 30)))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, items).collect()] == [(1, "7", 11, 0, 20)]


@pytest.fixture(scope="module")
def quality_tables(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join([rng.choice("buy now cheap".split())] * 30), int(i % 3 > 0))
            for i in range(240)]
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t, _ in rows], "doc_id long, text string, score double, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (10_000, 1, 0), (7, 2, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels, dict((i, q) for i, _, q in rows)


def test_quality(spark, quality_tables, odd_documents, no_documents):
    docs, labels, truth = quality_tables
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).withColumn("held", quality.held_out()).collect()
    held = [r for r in scored if r.held]
    assert len(held) > 30 and sum((r.score >= 0.7) == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.7 for r in scored)
    odd = {r.doc_id: r.score for r in quality.score(odd_documents, model).collect()}
    assert odd[400] == odd[401] == odd[402] == pytest.approx(model.prior)
    assert all(0 <= s <= 1 for s in odd.values())
    assert quality.score(no_documents, model).collect() == []


def test_quality_without_labels(quality_tables, no_documents):
    docs, labels, _ = quality_tables
    for model in (quality.train(docs, labels.limit(0)), quality.train(no_documents, labels)):
        assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_quality_same_twice(quality_tables):
    docs, labels, _ = quality_tables
    one, two = (quality.train(d, labels).contributions() for d in (docs, docs.repartition(7)))
    assert (one == two).all()
