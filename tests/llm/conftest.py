"""Small documents with every odd case, and plain-Python doubles of the contracts."""

import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row int, w string, key string, score double, target double, pos int, hash long"


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]


def make_rows(seed=7, n=60):
    rng = random.Random(seed)
    texts, passage = [], words(rng, 60)
    for i in range(n):
        w = words(rng, rng.randint(1, 200))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[: rng.randint(20, 60)]
        texts.append(" ".join(w))
    for i in range(0, n, 4):  # near copies
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[1], texts[1], texts[2].upper(), "", " \t\n", "one", "one two", "!!! ###", "é ü ñ", " ".join(words(rng, 9000)), "x\u00a0y z\x1cq"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(texts)]
    rows.append((len(rows), None, "en", "a", None))
    rows.append((None, "null id with some words of its own that nobody else has", None, None, 0))
    rows.append(rows[3])  # a repeated row
    return [(*r, 1, 2, 3, "w", "k", 0.5, 1.5, 4, 5) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
