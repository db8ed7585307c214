"""The command line, the HTTP provider and references between tables."""

import json

import pytest
from pyspark.sql import functions as F

from quillstrata import cli
from quillstrata.operators import embedding, health
from quillstrata.operators.relations import Reference, RestrictedError, delete


def test_commands(spark, tmp_path, capsys):
    code = tmp_path / "code"
    code.mkdir()
    (code / "a.py").write_text("def alpha():\n    return 1\n")
    (tmp_path / "q.sql").write_text("SELECT count(*) AS n FROM chunk_slices")

    def run(*argv):
        rc = cli.main(["--workspace", str(tmp_path / "w"), *argv], spark)
        out = capsys.readouterr()
        return rc, [json.loads(x) for x in out.out.splitlines()], out.err

    assert run("source", "add", "s", str(code))[0] == 0
    assert run("source", "list")[1] == [{"name": "s", "path": str(code), "enabled": True}]
    rc, got, _ = run("parser", "parse", "s", "--max-tokens", "auto")
    assert rc == 0 and got[0]["status"] == "ok" and got[0]["files"] == 1
    assert len(run("parser", "batches")[1]) == 1
    assert run("vdb", "create", "v", "s@latest", "m")[0] == 0
    assert run("vdb", "sync", "v", "--dry-run")[1][0]["embed"] == 1
    assert run("vdb", "sync", "v")[0] == 0
    assert len(run("vdb", "search", "v", "return 1", "-k", "1")[1]) == 1
    assert run("vdb", "info")[1][0]["vector_count"] == 1
    assert {r["table"] for r in run("db", "info", "--seconds", "30")[1]} >= {"chunk_slices", "vectors"}
    assert run("db", "run", str(tmp_path / "q.sql"))[1] == [{"n": 1}]
    assert {r["module"] for r in run("checkhealth")[1]} == {"parser", "vdb"}
    rc, got, err = run("source", "add", "s", "x")
    assert rc == 1 and got == [] and "s is" in err
    assert run("parser", "remove", "nosuch")[0] == 1
    assert run("vdb", "sync", "v", "--provider", "http", "--recompute")[0] == 1  # no key
    with pytest.raises(SystemExit):
        cli.main(["nonsense"], spark)


class Wire:
    """Answers in turn; keeps what was sent."""

    def __init__(self, *answers):
        self.answers, self.sent = list(answers), []

    def __call__(self, url, headers, body, seconds):
        self.sent.append((url, headers, json.loads(body), seconds))
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(answer, Exception):
            raise answer
        status, payload = answer
        return status, {"X-Request-Id": "r1"}, payload if isinstance(payload, bytes) else json.dumps(payload).encode()


def vectors(n, dim=3):
    return 200, {"data": [{"index": i, "embedding": [float(i)] * dim} for i in reversed(range(n))]}


def test_http_provider(monkeypatch):
    monkeypatch.setenv("EMBEDDINGS_API_KEY", "secret")
    wire = Wire(vectors(2))
    p = embedding.HttpProvider("http://x/v1/embeddings", transport=wire, timeout=5)
    assert p.embed("m", ["a", ""]) == [[0.0] * 3, [1.0] * 3]  # by index, not as they came
    url, headers, body, seconds = wire.sent[0]
    assert (url, headers["Authorization"], body, seconds) == ("http://x/v1/embeddings", "Bearer secret", {"model": "m", "input": ["a", " "]}, 5)
    probe = embedding.HttpProvider("u", transport=Wire(vectors(1, 7)))
    assert probe.dim("new-model") == 7 and probe.dim("new-model") == 7 and len(probe.transport.sent) == 1
    assert probe.dim("text-embedding-3-large") == 3072 and len(probe.transport.sent) == 1


@pytest.mark.parametrize(
    "answer,kind",
    [((429, b""), embedding.RetryableError), ((503, b"<html>"), embedding.RetryableError), (TimeoutError(), embedding.RetryableError), (ConnectionError(), embedding.RetryableError),
     ((400, {"error": {"message": "too long"}}), embedding.ProviderError), ((401, b"?"), embedding.ProviderError), ((200, b"?"), embedding.ProviderError), ((200, {"data": [{}]}), embedding.ProviderError)],
)
def test_http_errors(monkeypatch, answer, kind):
    monkeypatch.setenv("EMBEDDINGS_API_KEY", "secret")
    with pytest.raises(embedding.ProviderError) as e:
        embedding.HttpProvider("u", transport=Wire(answer)).embed("m", ["a"])
    assert e.type is kind and "secret" not in str(e.value)


def test_http_retries_and_checks(monkeypatch):
    monkeypatch.setenv("EMBEDDINGS_API_KEY", "secret")
    waits = []
    monkeypatch.setattr(embedding.time, "sleep", waits.append)
    wire = Wire((429, b""), TimeoutError(), vectors(1))
    p = embedding.HttpProvider("u", transport=wire, probed={"m": 3})
    assert embedding.with_retries(lambda: p.embed("m", ["a"]), sleep=waits.append) == [[0.0] * 3]
    assert len(wire.sent) == 3 and len(waits) == 1 and 0.4 <= waits[0] <= 0.6
    with pytest.raises(embedding.ProviderError):
        embedding.embed_texts(embedding.HttpProvider("u", transport=Wire(vectors(1)), probed={"m": 4}), "m", ["a"])
    with pytest.raises(embedding.ProviderError):
        embedding.embed_texts(embedding.HttpProvider("u", transport=Wire(vectors(2)), probed={"m": 3}), "m", ["a"])
    monkeypatch.delenv("EMBEDDINGS_API_KEY")
    with pytest.raises(embedding.ProviderError):
        p.embed("m", ["a"])
    with pytest.raises(ValueError):
        embedding.HttpProvider("u", timeout=0)


def answer_one(url, headers, body, seconds):
    n = len(json.loads(body)["input"])
    return vectors(n)[0], {}, json.dumps(vectors(n)[1]).encode()


def test_http_provider_in_a_frame(spark, monkeypatch):
    monkeypatch.setenv("EMBEDDINGS_API_KEY", "secret")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string").coalesce(1)
    p = embedding.HttpProvider("u", key_name="PATH", limits=embedding.Limits(2), transport=answer_one, probed={"m": 3})
    assert sorted(r["embedding"][0] for r in embedding.embed(df, p, "m", "id", "text").collect()) == [0.0, 0.0, 0.0, 1.0, 1.0]


def test_references(spark):
    a, b, c = spark.range(4).toDF("a"), spark.createDataFrame([(i, i % 4) for i in range(8)], "b long, to_a long"), spark.createDataFrame([(i, i % 8 if i else None) for i in range(16)], "c long, to_b long")
    tables = {"a": a, "b": b, "c": c}
    ab, bc = Reference("b", "to_a", "a", "a"), lambda action: Reference("c", "to_b", "b", "b", action)
    gone = a.where("a = 1")
    left = delete(tables, [ab, bc("cascade")], "a", "a", gone)
    assert [left[t].count() for t in "abc"] == [3, 6, 12]
    left = delete(tables, [ab, bc("set_null")], "a", "a", gone)
    assert [left[t].count() for t in "abc"] == [3, 6, 16] and left["c"].where("to_b is null").count() == 5
    with pytest.raises(RestrictedError):
        delete(tables, [ab, bc("restrict")], "a", "a", gone)
    assert delete(tables, [ab, bc("restrict")], "a", "a", gone.limit(0))["a"].count() == 4
    with pytest.raises(ValueError):
        delete(tables, [ab, Reference("a", "a", "b", "b")], "a", "a", gone)
    with pytest.raises(ValueError):
        Reference("b", "to_a", "a", "a", "explode")


def test_vector_set_rules_need_their_columns(spark):
    sets = spark.range(1).select("id", F.lit("n").alias("name"), F.lit("b").alias("batch_id"), F.lit(3).alias("dim"), F.lit("m").alias("model"), F.lit(3).alias("meta_dim"), F.lit("m").alias("meta_model"), F.lit(0).alias("meta_vectors"), F.lit("2024-01-01").cast("timestamp").alias("meta_built_at"))
    none = spark.createDataFrame([], "chunk_id long, vdb_id long")
    now = F.lit("2024-01-02").cast("timestamp")
    assert [r["code"] for r in health.vector_sets(sets, none, none, None, now).collect()] == ["not-synced"]
    more = sets.withColumns({"meta_text": F.lit("{"), "meta_vdb": F.lit(7), "provider": F.lit("p"), "meta_provider": F.lit("q")})
    assert {r["code"] for r in health.vector_sets(more, none, none, None, now).collect()} == {"not-synced", "sidecar-invalid", "sidecar-mismatch", "provider-mismatch"}
