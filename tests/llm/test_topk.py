"""Exact top-k searches against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import lexical
from tickloom.llm import topk_vectors as tv
from tickloom.llm.queries import QUERIES, table


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_vectors(rows, every=50, top=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is None or q % every:
            continue
        best = sorted((-sum(s * t for s, t in zip(x, y)), c is None, c or 0) for b, (c, y) in enumerate(ok) if b != a)
        out += [(q, k + 1, None if null else c, -s) for k, (s, null, c) in enumerate(best[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,shard", [(1 << 20, 1 << 20), (600, 20000)])
def test_vectors(spark, monkeypatch, block, shard):
    """Clusters, many equal vectors, ties, odd rows; also with several blocks and shards."""
    monkeypatch.setattr(tv, "BLOCK_BYTES", block)
    monkeypatch.setattr(tv, "SHARD_BYTES", shard)
    rng = np.random.default_rng(4)
    heart = rng.normal(size=(5, 12))
    rows = [(i, (heart[i % 5] + 0.3 * rng.normal(size=12)).tolist()) for i in range(1200)]
    rows += [(2000 + i, heart[0].tolist()) for i in range(500)]  # copies
    rows += [(3000 + i, [1.0] * 12) for i in range(60)] + [(50, heart[1].tolist()), (50, heart[1].tolist())]
    rows += [(None, heart[2].tolist()), (4000, None), (4050, [None] * 12), (4100, [float("nan")] + [0.0] * 11),
             (4150, [float("inf")] * 12), (4200, []), (4250, [0.0] * 12), (-50, [-1.0] * 12),
             (4300, [0.5] * 3), (4301, [0.25] * 20), (4302, (-heart[3]).tolist())]
    df = spark.createDataFrame([(i, v, 1, i, "x") for i, v in rows],
                               "vec_id long, embedding array<double>, rank int, score long, query_id string").repartition(4)
    assert shown(tv.search(df)) == brute_vectors(rows)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert tv.search(spark.createDataFrame([], schema)).collect() == []
    assert tv.search(spark.createDataFrame([(50, [1.0])], schema)).collect() == []
    rows = [(0, [1.0, -2.0]), (50, [0.5, 0.5]), (7, [-1.0, 0.25])]
    assert shown(tv.search(spark.createDataFrame(rows, schema))) == brute_vectors(rows)


def test_large_components(spark):
    """Sums beyond 2^53 are exact; a score beyond 64 bits is an error."""
    rows = [(i, [float(2 ** 20 + i), float(2 ** 19 - 3 * i), 1.0]) for i in range(60)]
    schema = "vec_id long, embedding array<double>"
    assert shown(tv.search(spark.createDataFrame(rows, schema))) == brute_vectors(rows)
    huge = [(0, [2.0 ** 40]), (1, [2.0 ** 40])]
    with pytest.raises(Exception, match="64 bits"):
        tv.search(spark.createDataFrame(huge, schema)).collect()


def test_reading_stops_early(spark):
    """With a known k-th score most vectors are ruled out before all postings are read."""
    rng = np.random.default_rng(1)
    comps = np.floor(256 * rng.normal(size=(4000, 32)) / 32 ** 0.5).astype(np.int64)
    shard = tv.Shard(np.arange(4000), np.arange(4000), comps, np.argsort(comps, axis=0, kind="stable"))
    query = comps[17]
    score = comps @ query
    known = int(np.sort(score)[-5])
    left = shard.possible(query, known)
    assert set(np.flatnonzero(score >= known)) <= set(left.tolist()) and len(left) < 400
    assert len(shard.possible(query, int(score.max()) * 10)) == 0


def test_whole_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    assert shown(QUERIES["op12_topk_vectors"](spark, sf)) == brute_vectors(rows)


# --- lexical search ------------------------------------------------------------------------------

def brute_lexical(docs, items, top=20):
    def terms(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    total = sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for doc, bag, n in bags:
            m = 75 + 25 * n * len(bags) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -score)
                for k, (score, null, doc) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,block", [(1 << 24, 1 << 22), (3000, 300)])
def test_lexical(spark, odd_documents, monkeypatch, shard, block):
    """Odd documents, ties, repeated terms; in one shard and in many, in one block and in many."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "PIECE_BYTES", 64)
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    rng = random.Random(8)
    words = sorted({w for _, t in docs for w in (t or "").split()})
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhereword"), (103, "the THE the of Of"), (None, "river stone"),
              (103, "the THE the of Of"), (104, "日本 Ünïcode σας ΣΑΣ")]
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, score int, doc_id string")
    assert shown(lexical.search(odd_documents, queries)) == brute_lexical(docs, items)


def test_lexical_empty(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    assert lexical.search(odd_documents, none).collect() == []
    assert lexical.search(no_documents, some).collect() == []


def test_pair_bounds_skip_more(spark):
    """Two terms that never meet add no more than the larger of the two; the list of those that meet
    gives both impacts."""
    docs = [(i, "left " * (1 + i % 3) + "pad " * 20) for i in range(200)]
    docs += [(200 + i, "right " * (1 + i % 3) + "pad " * 20) for i in range(200)]
    docs += [(400 + i, "rare left " + "pad " * 5) for i in range(30)] + [(500 + i, "pad") for i in range(600)]
    gather = lexical._Gather({b"left": 0, b"right": 1, b"rare": 2})
    for i, t in docs:
        gather.add(i, t.encode())
    cells = tuple(c.to_pylist()[0] for c in gather.row().columns)
    start = np.frombuffer(cells[4], "<i8")
    df = dict(enumerate(np.diff(start).tolist()))
    model = lexical.Model([(0, Counter([0, 1, 2]))], len(docs), int(np.frombuffer(cells[2], "<i8").sum()), df)
    shard = lexical.Shard(model, *cells)
    (_, query), = model.queries
    pair = model.pairs(query)[0]
    assert {t for t, _ in pair} == {0, 1}
    assert shard.bound(pair) == max(shard.largest[0], shard.largest[1]) < shard.largest[0] + shard.largest[1]
    doc, score = shard.search(query, shard.largest[2])
    assert set(shard.ids[doc].tolist()) == set(range(400, 430))


def test_whole_lexical(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert shown(QUERIES["op13_lexical"](spark, sf)) == brute_lexical(docs, items)
