"""Operators that compare documents, lines, passages and vectors, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import key, prose, texts
from tickloom.llm import embed_dedup, line_dedup, simhash, substring
from tickloom.llm.common import components


def roots(n, links):
    """Smallest member of each node's component."""
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed,fold", [(0, 1 << 20), (1, 0), (2, 20)])
def test_components(spark, seed, fold, monkeypatch):
    from tickloom.llm import common
    monkeypatch.setattr(common, "FOLD", fold)
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)]
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(df).collect()}
    want = roots(161, pairs)
    assert got == {n: want[n] for a, b in pairs if a != b for n in (a, b)}
    assert components(df.limit(0)).collect() == []


# --- SimHash -----------------------------------------------------------------------------------

def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_documents(odd_documents, no_documents):
    rows = texts(odd_documents)
    prints = [brute_print(t) for _, t in rows]
    label = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                              if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for (doc, _), c in zip(rows, label, strict=True):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    want = sorted(((d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, label, strict=True)), key=key)
    got = sorted(map(tuple, simhash.near_duplicates(odd_documents).collect()), key=key)
    assert got == want
    assert simhash.near_duplicates(no_documents).collect() == []
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(least.values())  # one row a component
    assert ids.count(None) == sum(d is None for d, _ in rows)
    assert simhash.keep_one(no_documents).collect() == []


def test_simhash_one_id_with_two_texts(spark):
    """Texts that share nothing but an id neither merge their components nor displace each other."""
    rng = random.Random(4)
    a, b, c = (prose(rng, 80) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, c), (4, a)], "doc_id long, text string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fa, fb, fc = (f"{brute_print(t):016x}" for t in (a, b, c))
    assert got == {(1, fa): 1, (1, fb): 1, (2, fa): 1, (3, fb): 1, (4, fc): 4, (4, fa): 1}
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == sorted([(1, a), (1, b), (4, c)])


def test_golay_keys_lose_no_pair():
    rng = np.random.default_rng(1)
    code = simhash.Golay()
    one = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, 2000, dtype=np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for b in rng.choice(64, i % 4, replace=False):
            two[i] ^= np.uint64(1 << int(b))
    keys = [{(r, k) for r, k in zip(*(x.tolist() for x in simhash.keys(v.view(np.int64), code)), strict=True)}
            for v in (one, two)]
    shared = {r for r, _ in keys[0] & keys[1]}
    assert shared == set(range(len(one)))


def test_large_bucket_by_blocks(monkeypatch):
    from tickloom.llm import common
    monkeypatch.setattr(common, "BLOCK", 16)
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 1 << 10, 100, dtype=np.uint64)
    a, b = common.near_pairs(np.zeros(100, np.int64), fp, 1)
    near = [(i, j) for i in range(100) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 1]
    assert roots(100, list(zip(a.tolist(), b.tolist(), strict=True))) == roots(100, near)


# --- substring dedup ---------------------------------------------------------------------------

def brute_repeats(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for a in range(len(w) - 49):
                k = tuple(w[a:a + 50])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        lost = set()
        for a in range(len(w) - 49 if d is not None else 0):
            if first[tuple(w[a:a + 50])] < d:
                lost.update(range(a, a + 50))
        kept = b" ".join(x for i, x in enumerate(w) if i not in lost)
        out.append((d, len(w), len(lost), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def test_repeats(odd_documents, no_documents):
    got = sorted(map(tuple, substring.remove_repeats(odd_documents).collect()), key=key)
    want = brute_repeats(texts(odd_documents))
    assert got == want
    assert sum(w[2] > 0 for w in want) >= 8
    assert substring.remove_repeats(no_documents).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_repeats_random(spark, seed):
    """Few different words, shifted and nested repeats, long runs of one word."""
    rng = random.Random(seed)
    vocab = "a b c d".split() if seed else ["a", "b"]
    pool = [[rng.choice(vocab) for _ in range(rng.choice([45, 60, 90]))] for _ in range(5)] + [["a"] * 130]
    rows = []
    for i in range(25):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(0, 8)
            parts += p[a:rng.randint(a + 40, len(p) + 40)] + [rng.choice(vocab + ["z"]) for _ in range(rng.randint(0, 9))]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, substring.remove_repeats(df).collect())) == brute_repeats(rows)


# --- fuzzy lines -------------------------------------------------------------------------------

def brute_lines(rows):
    """Texts after dedup, by all pairs of lines."""
    rows = sorted({(d, t) for d, t in rows if d is not None and t},
                  key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1], 42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1], 42) >> 63)))
    place = [(i, n, line) for i, (_, t) in enumerate(rows) for n, line in enumerate(t.split("\n")) if line.strip()]
    grams = [{x[i:i + 5] for i in range(max(1, len(x) - 4))} for *_, x in place]
    label = roots(len(place), [(i, j) for i in range(len(place)) for j in range(i)
                               if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])])
    lost = {place[i][:2] for i, r in enumerate(label) if r != i}
    return {(d, t): "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in lost) for i, (d, t) in enumerate(rows)}


def test_lines(odd_documents, no_documents):
    rows = texts(odd_documents)
    want = brute_lines(rows)
    out = line_dedup.dedup_lines(odd_documents)
    assert out.columns == odd_documents.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
    assert got == sorted(((d, want.get((d, t), t)) for d, t in rows), key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert line_dedup.dedup_lines(no_documents).collect() == []
    report = line_dedup.line_report(odd_documents).where("doc_id = 601").first()
    assert (report.n_lines, report.n_removed) == (5, 2)


def test_leaders_hide_no_link(spark):
    """From star pairs alone (every line with one leader) the links between followers are found."""
    rng = random.Random(8)
    base = prose(rng, 40)
    lines = [base] + [base[:k] + "#" * 7 + base[k + 7:] for k in range(10, 200, 9)]
    lines += [base[:k] + "%" * 26 + base[k + 26:] for k in (20, 22, 120, 122)] + ["unlike all of the others"]
    grams = [{x[i:i + 5] for i in range(len(x) - 4)} for x in lines]
    near = lambda i, j: len(grams[i] & grams[j]) / len(grams[i] | grams[j])
    want = roots(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if near(i, j) >= 0.8])
    frame = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    for leader in (0, 5):
        pairs = spark.createDataFrame([(i, leader, True) for i in range(len(lines)) if i != leader], "a long, b long, more boolean")
        links = [tuple(r) for r in line_dedup.verify(pairs, frame).collect()]
        assert all(near(a, b) >= 0.8 for a, b in links)
        assert roots(len(lines), links) == want


@pytest.mark.parametrize("rows", [7, 100, 1 << 18])
def test_buckets_stream_in_any_blocks(rows, monkeypatch):
    """Small buckets give their near pairs, large ones a star, wherever the batches are cut."""
    import pyarrow as pa
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(2)
    sizes = [1, 2, 5, 64, 65, 500, 3, 1, 200]
    key = np.repeat(np.arange(len(sizes)) - 4, sizes)
    node = np.arange(len(key)) * 3
    fp = (rng.integers(0, 1 << 62, len(key)) & rng.integers(0, 1 << 62, len(key)) & rng.integers(0, 1 << 62, len(key)))
    want = set()
    for k, n in zip(range(-4, 5), sizes, strict=True):
        at = np.flatnonzero(key == k)
        for i, x in enumerate(at):
            want |= {(node[x], node[at[0]], True)} if n > 64 and i else \
                set() if n > 64 else {(node[x], node[y], False) for y in at[:i] if int(fp[x] ^ fp[y]).bit_count() <= 14}
    order = np.repeat(np.arange(len(key)), rng.integers(1, 3, len(key)))  # some rows twice
    batches = [pa.RecordBatch.from_pydict({"key": key[order[i:i + rows]], "fp": fp[order[i:i + rows]], "node": node[order[i:i + rows]]})
               for i in range(0, len(order), rows)]
    got = [tuple(r.values()) for b in line_dedup._bucket_rows(iter(batches)) for r in b.to_pylist()]
    assert set(got) == want  # a row that comes twice may give its pair twice
    assert list(line_dedup._bucket_rows(iter([]))) == []


def test_unlike_lines_under_one_key_are_no_star():
    """A large bucket falls into the groups that sketches connect; unlike lines make no pair."""
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    fp[200:] = fp[0] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    a, b, more = line_dedup.bucket_pairs(np.zeros(300, np.int64), fp, np.arange(300), False)
    assert {(int(x), int(y)) for x, y, m in zip(a, b, more, strict=True) if m} == {(i, 0) for i in range(200, 300)} and len(a) < 110


@pytest.mark.parametrize("chars", [1 << 23, 0])
def test_hidden_links_of_short_copies(spark, chars, monkeypatch):
    """Many short copies of one line that the leader misses: blocks give a forest of links, and wide
    leaders the same components by the prefix rule."""
    monkeypatch.setattr(line_dedup, "BLOCK_CHARS", chars)
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefghij") for _ in range(40))]
    for _ in range(150):
        x = list(lines[0])
        for _ in range(rng.randint(1, 3)):
            x[rng.choice([0, 1, 2, 3, 4, 35, 36, 37, 38, 39])] = rng.choice("klm")
        lines.append("".join(x))
    lines = list(dict.fromkeys(lines))
    grams = [line_dedup.shingles(x) for x in lines]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.jaccard(grams[i], grams[j]) >= 0.8]
    pairs = spark.createDataFrame([(i, 0, True) for i in range(1, len(lines))], "a long, b long, more boolean")
    links = [tuple(r) for r in line_dedup.verify(pairs, spark.createDataFrame(list(enumerate(lines)), "node long, line string")).collect()]
    assert {tuple(sorted(x, reverse=True)) for x in links} <= set(near) and roots(len(lines), links) == roots(len(lines), near)
    if chars:
        assert len(links) < len(lines) < len(near)


def test_packed_similarity_is_exact():
    rng = random.Random(3)
    memo = line_dedup.Names(line_dedup.packed, 10)
    for _ in range(200):
        x, y = ("".join(rng.choice("abßЖ日") if rng.random() < 0.1 else rng.choice("ab ") for _ in range(rng.randint(0, 40)))
                for _ in range(2))
        assert line_dedup.similarity(x, y, memo) == line_dedup.jaccard(line_dedup.shingles(x), line_dedup.shingles(y))


def test_packed_all():
    for texts in (["ab", "abcdeabcde"], ["日本日本日本", "abcdef"], ["aaaaaaaa", "bcdefg", "abcdeabcdea"]):
        for got, one in zip(line_dedup.packed_all(texts), texts, strict=True):
            want = line_dedup.packed(one)
            assert (got is None) == (want is None) and (want is None or got.tolist() == want.tolist())


def test_signature_estimates_similarity():
    rng = random.Random(6)
    a = prose(rng, 80)
    b = a[:300] + prose(rng, 80)[300:]
    true = len(line_dedup.shingles(a) & line_dedup.shingles(b)) / len(line_dedup.shingles(a) | line_dedup.shingles(b))
    for make in (line_dedup.signatures, line_dedup.permuted):
        one, two = make(*line_dedup.hashes([a, b]), 2)
        assert abs((one == two).mean() - true) < 0.2
        short = make(*line_dedup.hashes(["ab", "ab", ""]), 3)
        assert (short[0] == short[1]).all() and (short != line_dedup.EMPTY).all()


@pytest.mark.parametrize("size", [8, 10, 12, 14, 16, 20, 30, 40, 46, 60, 120])
def test_bands_find_similar_lines_of_any_length(size):
    """Recall of the band keys on random pairs with 0.8 <= similarity < 0.9."""
    rng, letters, pairs = random.Random(size), "abcdefghijklmnopqrstuvwxyz ", []
    while len(pairs) < 1500:
        x = "".join(rng.choice(letters) for _ in range(size))
        cut = rng.randrange(size + 1)
        edit = rng.choice(letters) * rng.choice([0, 1, 1, 2, 3])
        y = rng.choice([x[:cut] + edit + x[cut + len(edit):], x[:cut] + edit + x[cut:], x + edit, edit + x, x[:cut] + x[cut + 1:]])
        if 0.8 <= line_dedup.jaccard(line_dedup.shingles(x), line_dedup.shingles(y)) < 0.9:
            pairs.append((x, y))
    key, row, _ = line_dedup.band_keys([t for p in pairs for t in p])
    keys = [set() for _ in range(2 * len(pairs))]
    for k, r in zip(key.tolist(), row.tolist(), strict=True):
        keys[r].add(k)
    assert sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs))) >= 0.985 * len(pairs)


def test_first_shingles_lose_no_pair():
    rng = random.Random(3)
    lead = "".join(rng.choice("abcd") for _ in range(40))
    lines = []
    for _ in range(300):
        x = list(lead)
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(40)] = rng.choice("abcdefgh")
        lines.append("".join(x[:rng.randint(3, 40)]))
    *sets, of_lead = line_dedup.hash_sets([*lines, lead])
    first = [set(line_dedup.first_shingles(x, of_lead).tolist()) for x in sets]
    grams = [line_dedup.shingles(x) for x in lines]
    linked = [(i, j) for i in range(300) for j in range(i) if line_dedup.jaccard(grams[i], grams[j]) >= 0.8]
    assert len(linked) > 20 and all(first[i] & first[j] for i, j in linked)


# --- embeddings --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    seeds = rng.normal(size=(12, 8))
    rows = []
    for i in range(300):
        v = seeds[i % 12] + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.3])
        rows.append((i, v.tolist(), int(i % 3), "x"))
    rows += [(1000 + i, rows[i][1], rows[i][2], "x") for i in range(5)] + [rows[7]]
    rows += [(2000, None, 1, "x"), (2001, [0.0] * 8, 1, "x"), (2002, [float("nan")] * 8, 1, "x"),
             (2003, [1.0] + [float("inf")] * 7, 1, "x"), (2004, [None] + [1.0] * 7, 1, "x"), (2005, rows[0][1], None, "x"),
             (None, rows[0][1], 0, "x"), (2006, [], 1, "x"), (2007, [1.0, 2.0], 1, "x"), (2008, [2.0, 4.0], 1, "x"),
             (2009, [1e-200, 2e-200], 1, "x"), (2010, [1e300, 2e300], 1, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string").repartition(3)


@pytest.mark.parametrize("cell,block", [(2000, 2048), (20, 2048), (20, 7)])
def test_embeddings(spark, vectors, cell, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vectors.collect()

    def fit(r):
        v = r.embedding
        return (r.vec_id is not None and r.label is not None and v
                and all(x is not None and math.isfinite(x) for x in v) and any(v))

    def unit(v):
        v = np.array(v) / max(map(abs, v))
        return v / np.linalg.norm(v)

    good = [i for i, r in enumerate(rows) if fit(r)]
    units = {i: unit(rows[i].embedding) for i in good}
    links = [(i, j) for i in good for j in good if j < i and rows[i].label == rows[j].label
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93]
    label = roots(len(rows), links)
    least = {}
    for i in good:
        least[label[i]] = min(rows[i].vec_id, least.get(label[i], rows[i].vec_id))
    count = [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    want = sorted(((r.vec_id, count[i], least[label[i]] if fit(r) else r.vec_id) for i, r in enumerate(rows)), key=key)
    out = embed_dedup.near_duplicates(vectors)
    assert sorted((tuple(r)[:3] for r in out.collect()), key=key) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out.collect())
    assert embed_dedup.near_duplicates(vectors.limit(0)).collect() == []


def template_lines(n):
    """``n`` lines of 120 characters that differ in 4 slots (similarity 0.7), each with a near copy."""
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x400, 0x450)]
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(120)]
    out = []
    for _ in range(n):
        line = list(base)
        for at in (8, 32, 56, 80):
            line[at] = rng.choice(letters)
        out.append("".join(line))
        for at in rng.sample(range(120), 2):
            line[at] = rng.choice("0123456789")
        out.append("".join(line))
    return out


def test_lines_of_a_template(spark):
    """Leaders cut no link: lines that left a bucket for a leader they miss are compared later."""
    lines = template_lines(1500)
    ids, grams = {}, [line_dedup.shingles(t) for t in lines]
    often = Counter(g for own in grams for g in own)
    own, size = np.zeros((len(lines), len(often)), np.float32), np.array([len(g) for g in grams])
    for i, at in enumerate(grams):
        own[i, [ids.setdefault(g, len(ids)) for g in at if often[g] > 1]] = 1
    own = own[:, :len(ids)]
    both = own @ own.T
    links = np.argwhere(both >= 0.8 * (size[:, None] + size - both) - 1e-4).tolist()
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in line_dedup.dedup_lines(docs).where("text <> ''").select("doc_id").collect()}
    assert kept == {i for i, r in enumerate(roots(len(lines), links)) if i == r}
