"""Migration scripts, layers of settings and token encoders."""

import uuid

import pytest

from quillstrata.functions import ids, tokens
from quillstrata.operators import embedding
from quillstrata.operators.parsers.base import Limits, split_lines
from quillstrata.plans import migrations
from quillstrata.sources import documents

VOCABULARIES = "/opt/tokenizers"


def script(folder, own, way, body, name=None, header=None):
    (folder / f"{name or ids.short_id_of(own)}.{way}.sql").write_text((header or f"-- uuid7: {own}") + "\n" + body)


def test_short_ids_agree(spark):
    own = ids.uuid7(1_700_000_000_123)
    assert spark.createDataFrame([(own,)], "u string").select(ids.short_id(__import__("pyspark").sql.functions.col("u"))).first()[0] == ids.short_id_of(own)


def test_scripts_up_and_down(spark, tmp_path):
    one, two = (uuid.UUID(ids.uuid7(t)) for t in (1_700_000_000_000, 1_700_000_100_000))
    script(tmp_path, one, "up", "CREATE OR REPLACE TEMPORARY VIEW notes AS SELECT 1 AS id, 'a;b' AS body;\n")
    script(tmp_path, two, "up", "-- a comment; with a mark\r\nCREATE OR REPLACE TEMPORARY VIEW notes AS SELECT *, length(body) AS n FROM notes;  \r\n\r\n")
    script(tmp_path, two, "down", "CREATE OR REPLACE TEMPORARY VIEW notes AS SELECT id, body FROM notes;\n")
    found = migrations.read_scripts(spark, str(tmp_path))
    assert [m.id for m in found] == [ids.short_id_of(one), ids.short_id_of(two)] and all(m.checksum.startswith("sha256:") for m in found)
    assert found[0].down is None and found[1].down is not None
    tables, done = migrations.upgrade(found, [], {})
    assert [tuple(r) for r in tables["notes"].collect()] == [(1, "a;b", 3)] and done == [m.id for m in found]
    tables, done = migrations.downgrade(found, done, tables)
    assert tables["notes"].columns == ["id", "body"] and done == [found[0].id]
    assert not [t for t in spark.catalog.listTables() if t.name == "notes"]


@pytest.mark.parametrize("fault", ["none", "header", "name", "pair", "lone", "other"])
def test_faulty_scripts(spark, tmp_path, fault):
    one, two = (uuid.UUID(ids.uuid7(t)) for t in (1_700_000_000_000, 1_700_000_100_000))
    if fault != "none":
        script(tmp_path, one, "up", "SELECT 1;")
    else:
        (tmp_path / "x.txt").write_text("")
    if fault == "header":
        script(tmp_path, two, "up", "SELECT 1;", header="-- nothing")
    if fault == "name":
        script(tmp_path, two, "up", "SELECT 1;", name="WRONG")
    if fault == "pair":
        near = uuid.UUID(int=one.int ^ 1)  # another uuid of the same short form
        script(tmp_path, near, "down", "SELECT 1;")
    if fault == "lone":
        script(tmp_path, two, "down", "SELECT 1;")
    if fault == "other":
        (tmp_path / "readme.sql").write_text("x")
    with pytest.raises(migrations.MigrationError):
        migrations.read_scripts(spark, str(tmp_path))


def test_layers(tmp_path):
    user = tmp_path / "s.toml"
    user.write_text("[parser]\nmax_tokens = 100\nfail_fast = true\n[vdb]\nmetric = 'l2'\n")
    env = documents.from_environment("QS", {"QS_PARSER__MAX_TOKENS": "200", "QS_VDB__NAME": "v w", "OTHER": "1"})
    assert env == {"parser": {"max_tokens": 200}, "vdb": {"name": "v w"}}
    got = documents.layered({"parser": {"max_tokens": 2000, "gitignore": "combined"}, "level": 1}, user, env, {"level": 3, "quiet": None})
    assert got == {"parser": {"max_tokens": 200, "gitignore": "combined", "fail_fast": True}, "vdb": {"metric": "l2", "name": "v w"}, "level": 3}
    assert documents.layered({"a": 1}, tmp_path / "none.toml") == {"a": 1}
    with pytest.raises(documents.DocumentError):
        documents.from_environment("QS", {"QS_A": "1", "QS_A__B": "2"})


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_encoders(spark, name):
    e = tokens.Encoder(f"{VOCABULARIES}/{name}")
    assert 0 < e("The quick brown fox jumps.") < 12 and e("") == 0
    df = spark.createDataFrame([(1, "a b c", 9), (2, None, 9), (3, "", 9)], "id long, text string, tokens int")
    assert {r["id"]: r["tokens"] for r in tokens.counted(df, "text", e).collect()} == {1: e("a b c"), 2: None, 3: 0}
    text = "alpha beta gamma\n" * 30
    assert all(e(text[a:b]) <= 40 for a, b in split_lines(text, Limits(40, e), joined=True))
    assert sum(map(len, embedding.batches([text] * 3, embedding.Limits(2, 10_000), e))) == 3


def test_the_same_vocabulary_counts_alike():
    a, b = (tokens.Encoder(f"{VOCABULARIES}/byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    for text in ("Hello, world! It's 2024.", "  two  spaces\n\ttab", "naïve café", "字 and 😀"):
        assert a(text) == b(text)


def test_encoders_that_are_not_there():
    with pytest.raises(tokens.EncoderError):
        tokens.Encoder("/nowhere.tiktoken")("x")
    with pytest.raises(tokens.EncoderError):
        tokens.Encoder("/nowhere.txt")("x")
    assert tokens.Encoder("/nowhere/else.tiktoken", strict=False)("12345") == 2 and tokens.Encoder()("12345") == 2
