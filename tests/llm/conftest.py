import random

import pytest

WORDS = "the of and to in is on that by it with as for was this from river stone light house green early north".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(3)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, copies, repeated rows and columns with clashing names."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(30)]
    passage = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]  # exact copies
    rows += [(200 + i, base[i] + " extra words here") for i in range(5)]  # near copies
    rows += [(300 + i, prose(rng, 40) + " " + passage + " " + prose(rng, 30)) for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "word"), (404, "Ünïcode ΣΑΣ ß 日本"),
             (405, prose(rng, 5000)), (None, base[7]), (None, None), (406, "a a a a " * 40), (407, "a a a a " * 60)]
    rows += [(1, base[1]), (500, base[20]), (500, base[21])]  # repeated row; one id with two texts
    rows += [(600, "line one of the text\nshared line that stands in two documents, with words\nend"),
             (601, "shared line that stands in two documents, with word\n\nother line here\n\nother line here")]
    data = [(d, t, "en", "src", None if t is None else len(t), d, "x", 1.5) for d, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, component_id long, "
              "label string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((v is not None, v) for v in row)
