"""Column helpers against plain Python."""

import hashlib
import math
import re
import uuid

import pytest
from pyspark.sql import functions as F

from quillstrata.functions import ids
from quillstrata.functions import text as T

TEXTS = ["", "a", "abcd", "abcde", "  x \r\n y\r z  ", "é ü\n\n ñ", " nb ", "a\n\nb\n \nc", "  indented\nflat\n  more\nflat2\n\n", "\n\nlead\nnext", "---\na: 1\n---\nbody", "x" * 1000]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_hash(texts):
    want = [hashlib.sha256(b"v1\0k\0h\0" + t.encode()).hexdigest() for t in TEXTS]
    assert values(texts, T.versioned_hash("v1", F.col("t"), "k", "h")) == want


def test_tokens_and_normal_forms(texts):
    assert values(texts, T.token_estimate(F.col("t"))) == [math.ceil(len(t) / 4) for t in TEXTS]
    assert values(texts, T.request_tokens(F.col("t"))) == [8 + 4 * len(t) for t in TEXTS]
    assert values(texts, T.normalize_lines(F.col("t"))) == [t.replace("\r\n", "\n").replace("\r", "\n").strip() for t in TEXTS]
    assert values(texts, T.collapse(F.col("t"))) == [" ".join(t.split()) for t in TEXTS]
    assert values(texts, T.sql_checksum(F.lit("SELECT 1;  \r\n\r\n")))[0] == "sha256:" + hashlib.sha256(b"SELECT 1;\n").hexdigest()  # one line end closes the script


def test_places(texts):
    assert values(texts, T.byte_offset(F.col("t"), F.lit(3))) == [len(t[:3].encode()) for t in TEXTS]
    assert values(texts, T.line_of(F.col("t"), F.lit(4))) == [t[:4].count("\n") + 1 for t in TEXTS]


def plain_paragraphs(t):
    out, last = [], 0
    for m in re.finditer(r"\n\s*\n", t):
        if t[last : m.start()].strip():
            out.append(t[last : m.end()])
        last = m.end()
    return out + ([t[last:]] if t[last:].strip() else [])


def test_paragraphs(texts):
    solid = F.filter(T.paragraph_pieces(F.col("t")), lambda x: x.rlike(r"(?U)\S"))
    assert values(texts, solid) == [plain_paragraphs(t) for t in TEXTS]


def test_indentation(texts):
    got = dict(zip(TEXTS, values(texts, T.indentation_pieces(F.col("t"))), strict=True))
    assert got["  indented\nflat\n  more\nflat2\n\n"] == ["  indented\n", "flat\n  more\n", "flat2\n\n"]
    assert got["\n\nlead\nnext"] == ["\n\nlead\n", "next"]
    assert all("".join(v) == t for t, v in got.items())


def test_paths_and_selectors(spark):
    df = spark.createDataFrame([("a/b/c.test.PY",), ("noext",), ("src/.hidden",)], "p string")
    assert [r[0] for r in df.select(T.extension(F.col("p"))).collect()] == ["py", "", ""]
    assert df.select(T.module_name(F.col("p"))).first()[0] == "a.b.c.test"
    one = spark.range(1)
    pick = lambda *c: tuple(one.select(*c).first())
    assert pick(T.shebang(F.lit("#!/usr/bin/env python3 -u\nx")), T.shebang(F.lit("#! /bin/sh\n")), T.shebang(F.lit("x"))) == ("python3", "sh", "")
    assert pick(*T.export_names(F.lit(" a as b ")), *T.export_names(F.lit("c"))) == ("a", "b", "c", "c")
    assert pick(T.extends_clause(F.lit("class A extends B<C> {"))) == ("B<C>",)
    assert pick(T.delegated_chunk_id(F.lit("css"), F.lit("html"), F.lit("a:b"), F.lit(1), F.lit(2), F.lit(0))) == ("css:delegate:html:a-b:1:2:0",)
    assert pick(*ids.split_selector(F.lit("s@b@c"), "@"), *ids.split_selector(F.lit("s"), "@")) == ("s", "b@c", "s", None)
    assert pick(T.canonical_json(b=F.lit(1), a=F.lit("x"), c=F.lit(None).cast("int")), T.canonical_json(z=F.lit(None).cast("int"))) == ('{"a":"x","b":1}', None)
    assert pick(T.lenient_int(F.lit(" 12 ")), T.lenient_int(F.lit("x"))) == (12, None)
    assert pick(T.front_matter(F.lit(TEXTS[10])), T.front_matter(F.lit("no"))) == ("---\na: 1\n---\n", "")
    assert pick(ids.slug(F.lit("Éa--B c!"))) == ("ea-b-c",)


def test_uuid7(spark):
    made = ids.uuid7(1704067200000)
    assert uuid.UUID(made).version == 7 and ids.uuid7(1) < ids.uuid7(2)
    row = spark.range(1).select(F.unix_millis(ids.uuid7_time(F.lit(made))), ids.short_id(F.lit(made))).first()
    digits = "".join(ids.CROCKFORD[(uuid.UUID(made).int >> (128 - 5 * (i + 1))) & 31] for i in range(12))
    assert row[0] == 1704067200000 and row[1] == digits


def test_times(spark):
    row = spark.range(1).select(
        ids.parse_time(F.lit("2024-01-02T03:04:05Z")).cast("string"), ids.parse_time(F.lit("2024-01-02T03:04:05")).cast("string"), ids.parse_time(F.lit("no")), ids.age_days(F.lit("2024-01-01 23:00:00").cast("timestamp"), F.lit("2024-01-03 22:59:59").cast("timestamp"))
    ).first()
    assert tuple(row) == ("2024-01-02 03:04:05", "2024-01-02 03:04:05", None, 1)
