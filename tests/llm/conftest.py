"""Small tables with every awkward case, shared by the operators' tests."""

import random

import pytest

EXTRA = "kept string, slot string, key string, own string, part string, size string, rows string, taken string, fingerprint string, _text string, word string, uid string"


def awkward_rows():
    rng = random.Random(4)
    voc = ["the", "of", "thing", "Der", "und", "la", "señor", "être", "tion", "ing", "ness", "###", "one|two"]
    long = " ".join(rng.choice(voc) for _ in range(30_000))
    text = " ".join(rng.choice(voc) for _ in range(90))
    return [
        (1, text, "en", "b"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n ", "en", "a"), (5, long, "fr", "c"),
        (6, text, "en", "b"), (6, text, "en", "b"), (None, text + " end", "de", "a"), (7, "one", "es", ""), (8, "12 34 !!", "en", "a"),
        (9, "a\n\na b\na b\n", None, "c"), (10, text.upper() + " \U0001f600 tail", "de", "b"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    extra = [name.split()[0] for name in EXTRA.split(", ")]
    rows = [r + (len(r[1] or ""),) + ("x",) * len(extra) for r in awkward_rows()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
