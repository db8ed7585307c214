"""Staging, recomposition, batches, vectors, embedding, health, sources and plans."""

import json
import threading
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstrata.operators import batches, chunking, embedding, health, recompose, staging, vectors
from quillstrata.operators.embedding import Limits
from quillstrata.plans import ingest, migrations, queries, sql
from quillstrata.sources import documents, scan
from quillstrata.sources.storage import Store, reasons
from quillstrata.streaming.ingest import event_counts, stage_available

def AT(day):
    return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")


FAST = ["text_chunks", "text_chunk_hashes", "flagship", "exact_duplicates", "html_raw_blocks", "delegate_tree", "handler_resolution", "stage_second_batch", "recomposed_conversations", "slice_integrity", "batch_removal_counts", "chunk_payloads", "sync_plan", "vector_normalized", "knn_cosine", "knn_l2", "vdb_health", "ledger", "pending_migrations", "keyword_search", "bounded_counts",
        "markdown_chunks", "markdown_headings", "python_symbols", "javascript_symbols", "css_symbols", "html_elements", "packed_lines", "cascade_delete", "sidecar_health", "source_health", "database_health", "parser_health",
        "ordered_roles", "char_offsets", "sync_totals", "skip_reasons", "enabled_targets", "paragraph_chunks"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in sql.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(sql.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(repr(list(r)) for r in d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """A folder of tables whose documents have empty texts, texts without an id, and an id twice."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(0, "a\nb", "de", "s"), (1, "", "de", "s"), (2, "", "en", "s"), (3, None, "de", "s"), (4, "x", "en", "s"), (5, "y", None, "s"), (6, "z", "de", "s"), (6, "", "en", "s"), (None, "n", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(folder / "documents.parquet"))
    (folder / "labels.parquet").symlink_to(f"{sf}/labels.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), c.sql(sql.ORACLE[name]).df()
    plain = lambda d: sorted(repr(list(r)) for r in d[sorted(want.columns)].astype(object).where(d[sorted(want.columns)].notna(), None).itertuples(index=False))
    assert plain(got) == plain(want)


def test_symbols_of_empty_documents_match_sql(spark, odd):
    against_sql(spark, odd, "stage_symbols")


def test_payloads_of_empty_documents_match_sql(spark, sf, tmp_path):
    rows = [(0, "a\nb", "de", "s"), (1, "", "de", "s"), (2, "", "en", "s"), (4, "x", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "labels.parquet").symlink_to(f"{sf}/labels.parquet")
    for name in ("stage_symbols", "chunk_payloads", "chunk_upsert_counts", "batch_summary"):
        against_sql(spark, str(tmp_path), name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(sql.ORACLE) <= set(entry.queries())


def slices(spark, rows):
    """(file, chunk, part, total, text)"""
    df = spark.createDataFrame([(f, c, p, n, t) for f, c, p, n, t in rows], "file_id string, chunk_id string, part_index int, part_total int, content_text string")
    nulls = {k: F.lit(None).cast(t) for k, t in (("symbol_id", "string"), ("start_line", "int"), ("end_line", "int"), ("start_byte", "long"), ("end_byte", "long"), ("metadata_json", "string"), ("content_norm_hash", "string"))}
    return df.withColumns(nulls | {"handler_name": F.lit("text"), "handler_version": F.lit("1"), "token_count": F.length("content_text"), "content_hash": F.md5("content_text")})


def test_reuse_over_three_batches(spark):
    old = ingest.empty(spark.range(1), ingest.SLICES)
    a = slices(spark, [("f", "c1", 0, 2, "x"), ("f", "c1", 1, 2, "y"), ("f", "c2", 0, 1, "z")])
    one = staging.persist_slices(old, a, "b1", AT(1))
    assert {r["op"] for r in one.collect()} == {"insert"}
    b = slices(spark, [("f", "c1", 0, 2, "x"), ("f", "c1", 1, 2, "CHANGED"), ("f", "c2", 0, 1, "z")])
    two = staging.persist_slices(one.drop("op"), b, "b2", AT(2))
    by = sorted((r["chunk_id"], r["part_index"], r["batch_id"], r["first_seen_batch"], r["last_seen_batch"], r["op"]) for r in two.collect())
    assert by == [("c1", 0, "b1", "b1", "b1", "keep"), ("c1", 0, "b2", "b1", "b2", "insert"), ("c1", 1, "b1", "b1", "b1", "keep"), ("c1", 1, "b2", "b1", "b2", "insert"), ("c2", 0, "b1", "b1", "b2", "touch")]
    assert tuple(staging.outcomes(two).first()) == (2, 1, 2)
    assert staging.active(two, "b3").count() == 0 and staging.by_chunk(two, "b2", "c1").count() == 2 and staging.by_file(two, "b2", "f").count() == 3
    again = staging.persist_slices(two.drop("op"), slices(spark, [("f", "c2", 0, 1, "new")]), "b2", AT(3))
    assert sorted((r["chunk_id"], r["batch_id"], r["op"]) for r in again.where("chunk_id = 'c2'").collect()) == [("c2", "b1", "keep"), ("c2", "b2", "insert")]
    redo = staging.persist_slices(again.drop("op"), slices(spark, [("f", "c2", 0, 1, "newer")]), "b2", AT(4)).where("chunk_id = 'c2' and batch_id = 'b2'").collect()
    assert [(r["op"], r["content_text"], str(r["created_at"])[:10]) for r in redo] == [("update", "newer", "2024-01-03")]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_staging_moves_either_side_once(spark):
    a = slices(spark, [("f", "c1", 0, 1, "x"), ("f", "c2", 0, 1, "y")])
    one = staging.persist_slices(None, a, "b1", AT(1))
    assert shuffles(one) == 0 and {(r["op"], r["batch_id"], r["last_seen_batch"]) for r in one.collect()} == {("insert", "b1", "b1")}
    generic = staging.persist_slices(ingest.empty(a, ingest.SLICES), a, "b1", AT(1))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, generic.select(one.columns).collect()))
    two = staging.persist_slices(one.drop("op"), slices(spark, [("f", "c1", 0, 1, "x"), ("f", "c2", 0, 1, "z"), ("f", "c2", 0, 1, "z")]), "b2", AT(2))
    assert shuffles(two) == 1
    # a slice that a batch has twice is written twice, not as often as its pairs
    assert sorted((r["chunk_id"], r["op"]) for r in two.collect()) == [("c1", "touch"), ("c2", "insert"), ("c2", "insert"), ("c2", "keep")]


#: Shuffles of each query, and what it may write in between.
STAGED = {
    "stage_second_batch": (1, []), "active_slices": (1, []), "strict_slices": (1, []), "slice_history": (1, []), "stage_outcomes": (1, []), "run_summary_text": (1, []),
    "batch_summary": (7, []), "batch_removal_counts": (9, ["file_id batch_id first_seen_batch last_seen_batch"]), "batch_removal_state": (1, ["file_id batch_id first_seen_batch last_seen_batch"]),
    "chunk_payloads": (6, []), "chunk_upsert_counts": (15, []), "sync_limit": (15, []), "sync_plan": (1, ["symbol_id"]),
}


@pytest.mark.parametrize("name", STAGED)
def test_staged_queries_move_and_write_little(spark, sf, monkeypatch, name):
    written, plain = [], queries.settle

    def settle(df, label):
        written.append(" ".join(df.columns))
        return plain(df, label)

    monkeypatch.setattr(queries, "settle", settle)
    moved = shuffles(queries.QUERIES[name](spark, sf))
    assert moved <= STAGED[name][0] and written == STAGED[name][1]


def test_small_staging_operators(spark):
    b = spark.createDataFrame([("b1", "x")], "id string, notes string")
    assert sorted(tuple(r) for r in staging.upsert_batches(b, spark.createDataFrame([("b1", "y"), ("b2", "z")], "id string, notes string")).collect()) == [("b1", "y"), ("b2", "z")]
    f = spark.createDataFrame([(1, "a", "old"), (4, "b", "old")], "id long, repo_path string, file_sha string")
    got = staging.upsert_files(f, spark.createDataFrame([(None, "b", "new"), (None, "c", "n"), (None, "d", "n")], "id long, repo_path string, file_sha string"))
    by = {r["repo_path"]: (r["id"], r["file_sha"]) for r in got.collect()}
    assert by["a"] == (1, "old") and by["b"] == (4, "new") and {by["c"][0], by["d"][0]} == {5, 6}
    s = slices(spark, [("f", "c", 3, 9, "x"), ("f", "c", 7, 9, "y")])
    assert sorted((r["part_index"], r["part_total"]) for r in staging.renumber_parts(s).collect()) == [(0, 2), (1, 2)]
    one = staging.persist_slices(ingest.empty(s, ingest.SLICES), s, "b1", AT(1)).drop("op")
    touched = staging.touch_chunks(one, one, "b2", AT(2))
    assert {r["last_seen_batch"] for r in touched.collect()} == {"b2"} and staging.delete_batch(one, "b1").count() == 0
    assert staging.history(one).select("position").count() == 2


def test_recompose_and_tree(spark):
    s = slices(spark, [("f", "p", 1, 2, "b"), ("f", "p", 0, 2, "a"), ("f", "k", 0, 1, "kid")]).withColumn("delegate_parent", F.when(F.col("chunk_id") == "k", "p"))
    c = recompose.recompose(s, ["file_id", "chunk_id"])
    assert {r["chunk_id"]: (r["text"], r["token_count"]) for r in c.collect()} == {"p": ("ab", 2), "k": ("kid", 3)}
    tree = recompose.delegate_tree(c).collect()
    assert [(r["chunk_id"], r["delegate_children"]) for r in tree] == [("p", ["k"])]
    assert recompose.orphans(c).count() == 0 and recompose.orphans(c.where("chunk_id = 'k'")).count() == 1
    assert recompose.tree_order(c).count() == 2
    bad = slices(spark, [("f", "a", 0, 2, "x"), ("f", "b", 0, 1, "x"), ("f", "c", 0, 1, "x"), ("f", "c", 1, 2, "x")])
    assert {r["chunk_id"]: r["issue"] for r in recompose.integrity(bad, ["file_id", "chunk_id"]).collect()} == {"a": "missing-parts", "c": "inconsistent-total"}
    y = recompose.symbol_candidates(s.withColumn("symbol_path", F.lit("s")), "1").first()
    assert y["tokens"] == 5 and len(y["symbol_sha"]) == 64


def test_batch_removal_rules(spark):
    b = spark.createDataFrame([("b1", 1), ("b2", 2)], "id string, generated_at int")
    f = spark.createDataFrame([("f1", "b1"), ("f2", "b1")], "id string, batch_id string")
    y = spark.createDataFrame([("s1", "b1", "b2"), ("s2", "b1", "b1"), ("s3", "b0", "b1")], "id string, first_seen_batch string, last_seen_batch string")
    s = spark.createDataFrame([("f1", "s1", "b1", "b1", "b2"), ("f2", "s2", "b1", "b1", "b1")], "file_id string, symbol_id string, batch_id string, first_seen_batch string, last_seen_batch string")
    with pytest.raises(batches.BatchError):
        batches.remove(b, f, y, s, None, "b2")
    with pytest.raises(batches.BatchError):
        batches.remove(b, f, y, s, None, "b9")
    with pytest.raises(batches.BatchError):
        batches.remove(b, f, y, s, spark.createDataFrame([("b1",)], "batch_id string"), "b1")
    r = batches.remove(b, f, y, s, None, "b1")
    assert r.counts.first().asDict() == {"chunks_reassigned": 1, "chunks_deleted": 1, "chunk_first_reassigned": 0, "chunk_last_seen_reset": 0, "symbols_reassigned": 1, "symbol_last_seen_reset": 1, "symbols_deleted": 1, "files_reassigned": 1, "files_deleted": 1}
    assert sorted(tuple(x) for x in r.symbols.collect()) == [("s1", "b2", "b2"), ("s3", "b0", "b0")]
    assert [tuple(x) for x in r.slices.collect()] == [("f1", "s1", "b2", "b2", "b2")] and r.batches.count() == 1
    assert batches.remove(b, f, y, s, None, "b2", force=True).batches.count() == 1
    assert batches.select(b, "latest").first()["id"] == "b2" and batches.select(b, "b1").count() == 1


def test_vectors(spark):
    v = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (30, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in vectors.search(v, q, 2).orderBy("rank").collect()] == [(10, 1.0), (20, 0.0)]
    assert [r["vec_id"] for r in vectors.search(v, q, 9, "l2").orderBy("rank").collect()] == [10, 20, 30]
    assert vectors.search(v, q.limit(0), 3).collect() == []
    for bad in (dict(k=0), dict(k=1, metric="no")):
        with pytest.raises(vectors.VectorError):
            vectors.search(v, q, **bad)
    ids = spark.createDataFrame([(20,)], "vec_id long")
    assert vectors.remove(v, ids).count() == 2 and vectors.reconstruct(v, ids).count() == 1
    with pytest.raises(vectors.VectorError):
        vectors.remove(v, spark.createDataFrame([(99,)], "vec_id long"))
    with pytest.raises(Exception, match="dimensions"):
        vectors.check_dim(v, 4).collect()
    assert vectors.add(v, v.limit(1), 3).count() == 3
    assert vectors.checksum(v).first() == vectors.checksum(v.repartition(3)).first() != vectors.checksum(v.limit(2)).first()
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "e array<float>").select(vectors.normalize(F.col("e")).alias("n")).collect()
    assert [list(r["n"]) for r in zero] == [[0.0, 0.0], [0.6, 0.8]]


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (200, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    q = v.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    for metric, s in (("ip", -(x[:5] @ x.T)), ("l2", ((x[:5, None] - x[None]) ** 2).sum(2))):
        want = {(i, int(j)): n + 1 for i in range(5) for n, j in enumerate(np.lexsort((np.arange(200), s[i]))[:10])}
        assert {(r["query_id"], r["vec_id"]): r["rank"] for r in vectors.search(v, q, 10, metric).collect()} == want


class Task:
    """Stands for a DataFrame and its session: what mapInArrow would run in a worker is kept."""

    sparkSession = sparkContext = property(lambda self: self)

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("kind", ["ip", "l2"])
@pytest.mark.parametrize("data", ["random", "ties", "equal"])
def test_search_holds_little_at_once(spark, kind, data):
    rng = np.random.default_rng(2)
    x = {"random": rng.normal(size=(6000, 4)), "ties": rng.integers(0, 3, (6000, 4)).astype(float), "equal": np.ones((6000, 4))}[data].astype(np.float32)
    ids = rng.permutation(6000) * 3
    q = np.concatenate([x[:1500]] * 2).astype(np.float64)
    task = vectors._partial(Task(), np.arange(3000), q, 5, kind, "vec_id", "query_id", "embedding")
    batch = [pa.RecordBatch.from_arrays([pa.array(i), pa.array(list(v))], names=["vec_id", "embedding"]) for i, v in zip(np.split(ids, 2), np.split(x, 2), strict=True)]
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(task.run(iter(batch))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 256 << 20
    got = {}
    for a, b in zip(out["query_id"].to_pylist(), out["vec_id"].to_pylist(), strict=True):
        got.setdefault(a, []).append(b)
    for n in range(0, 3000, 97):
        terms = q[n] * x.astype(float) if kind == "ip" else (q[n] - x.astype(float)) ** 2
        s = ((terms[:, 0] + terms[:, 1]) + terms[:, 2]) + terms[:, 3]
        assert sorted(got[n]) == sorted(ids[np.lexsort((ids, -s if kind == "ip" else s))[:5]].tolist())


def test_materialize_and_plan(spark):
    kind = "symbol_id string, header_md string, body_text string, token_count long"
    old = spark.createDataFrame([("s1", "h", "old", 1), ("s9", "h", "stays", 1)], kind)
    new = spark.createDataFrame([("f", "c1", "s1", "h", "first", 2), ("f", "c2", "s1", "h", "last", 3), ("f", "c3", "s2", "h", "x", 4)], "file_id string, chunk_id string, " + kind)
    m = vectors.materialize(old, new)
    assert {r["symbol_id"]: (r["body_text"], r["op"]) for r in m.collect()} == {"s1": ("last", "update"), "s2": ("x", "insert"), "s9": ("stays", "keep")}
    have = spark.createDataFrame([("s9",)], "symbol_id string")
    assert tuple(vectors.plan(m, have, "symbol_id", "symbol_id", limit=1).first()) == (3, 1, 2)
    assert tuple(vectors.plan(m, have, "symbol_id", "symbol_id", recompute=True).first()) == (3, 3, 0)
    assert [r["symbol_id"] for r in vectors.limited(m, have, "symbol_id", "symbol_id", 1).collect()] == ["s1"]
    sets, chunks = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1,), (1,), (2,)], "vdb_id int")
    left, c, v, n = vectors.reset(sets, chunks, chunks, 1, drop=True)
    assert tuple(n.first()) == (2, 2, 1) and left.count() == c.count() == v.count() == 1


def test_embedding():
    p = embedding.HashProvider(8, Limits(2, 100))
    assert [len(b) for b in embedding.batches(["a"] * 5, p.limits)] == [2, 2, 1]
    assert [len(b) for b in embedding.batches(["a" * 20] * 3, Limits(9, 100))] == [1, 1, 1]
    with pytest.raises(embedding.TooLargeError):
        list(embedding.batches(["a" * 99], p.limits))
    assert embedding.embed_texts(p, "m", ["b a", "a b", "c"])[0] == embedding.embed_texts(p, "m", ["a b"])[0]
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise embedding.RetryableError
        return [[1.0]]

    assert embedding.with_retries(flaky, sleep=waits.append, jitter=lambda: 0.5) == [[1.0]] and waits == [0.5, 1.0]

    def down():
        raise embedding.RetryableError

    with pytest.raises(embedding.ProviderError):
        embedding.with_retries(down, sleep=lambda s: None)
    assert Limits(64, 8191, 8).resolve("auto", 8192, "auto", 4) == Limits(64, 8191, 4) and Limits().resolve(5, 10, 2) == Limits(5, 10, 2)


def test_native_packing_equals_batches(spark):
    rng = np.random.default_rng(1)
    data = [(g, i, int(t)) for g in range(6) for i, t in enumerate(rng.integers(1, 60, rng.integers(1, 30)))]
    df = spark.createDataFrame(data, "g int, i int, t long")
    got = {(r["g"], r["i"]): r["request"] for r in embedding.packed_batches(df, ["g"], "i", F.col("t"), Limits(4, 100)).collect()}
    for g in range(6):
        own = [t for x, _, t in data if x == g]
        for n, run in enumerate(embedding.batches([str(t) for t in own], Limits(4, 100), count=int)):
            assert all(got[g, i] == n for i in run)


def test_requests_count_every_token(spark, sf):
    got = queries.QUERIES["embed_request_batches"](spark, sf).collect()
    by = {}
    for r in chunking.text_chunks(queries.read(spark, sf, "documents")).select("doc_id", "part_index", "content_text").collect():
        by.setdefault(r["doc_id"], []).append((r["part_index"], embedding.request_tokens(r["content_text"])))
    want = []
    for doc, parts in by.items():
        runs, used = [], 0
        for _, n in sorted(parts):
            if not runs or len(runs[-1]) == 16 or used + n > 8191:
                runs.append([])
                used = 0
            runs[-1].append(n)
            used += n
        want += [(doc, i, len(r), sum(r), max(r) > 8191) for i, r in enumerate(runs)]
    assert sorted((r["doc_id"], r["request"], r["texts"], r["tokens"], r["too_large"]) for r in got) == sorted(want)
    large = [r for r in got if r["too_large"]]
    assert large and all(r["texts"] == 1 for r in large) and all(r["tokens"] <= 8191 for r in got if not r["too_large"])


def test_health(spark):
    s = spark.createDataFrame([("a", True, True, "t", True, None), ("b", False, False, None, None, "2024-01-01")], "name string, enabled boolean, exists boolean, target string, readable boolean, refreshed_at string")
    found = health.sources(s, AT(1))
    assert {(r["name"], r["code"]) for r in found.collect()} == {("a", "never-refreshed"), ("b", "disabled"), ("b", "missing-directory"), ("b", "no-target")}
    assert {r["name"]: r["status"] for r in health.worst(found, s, "source").collect()} == {"a": "unknown", "b": "error"}
    r = spark.createDataFrame([("a", "b1", "ok", 40, 0), ("b", None, None, 6, 0), ("c", "b1", "error", 0, 0)], "name string, batch_id string, status string, lock_seconds int, lock_events int")
    assert {(x["name"], x["code"], x["level"]) for x in health.parser_batches(r).collect()} == {("a", "lock-contention", "error"), ("b", "never-run", "unknown"), ("b", "lock-contention", "degraded"), ("c", "run-failed", "error")}
    d = spark.createDataFrame([("a", 2, 1, "x", "x", "2024-01-01"), ("b", 2, None, "x", "y", None)], "name string, expected int, applied int, ledger string, recorded string, vacuumed_at string").withColumn("vacuumed_at", F.col("vacuumed_at").cast("timestamp"))
    assert {(x["name"], x["code"]) for x in health.databases(d, F.lit("2024-02-01").cast("timestamp")).collect()} == {("a", "pending"), ("a", "vacuum-stale"), ("b", "missing"), ("b", "ledger-drift")}


@pytest.mark.parametrize("pattern,path,hit", [("*.log", "a/b.log", True), ("/x", "a/x", False), ("/x", "x/y", True), ("build/", "build/a", True), ("build/", "build", False), ("a/**/b", "a/x/y/b", True), ("doc/*.txt", "doc/a.txt", True), ("doc/*.txt", "doc/s/a.txt", False), ("f?o[!a]", "foob", True), ("#x", "#x", None), ("**/tmp", "q/tmp/z", True)])
def test_ignore_patterns(spark, pattern, path, hit):
    r = scan.ignore_regex(pattern)
    assert r is None if hit is None else spark.range(1).select(F.lit(path).rlike(r)).first()[0] == hit


def test_scan(spark, tmp_path):
    for name, body in {"a.py": "x = 1", "skip.log": "x", "sub/.gitignore": "*.tmp\n", "sub/b.tmp": "x", "sub/c.md": "# T\n", ".gitignore": "*.log\n!keep.log\n", "keep.log": "x", "manifest.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = scan.files(spark, str(tmp_path))
    lines = scan.read_ignore_files(spark, str(tmp_path))
    seen = {r["path"] for r in scan.visible(found, lines).select("path").collect()}
    assert seen == {"a.py", "keep.log", "sub/c.md"}
    assert "manifest.json" in {r["path"] for r in scan.visible(found, lines, mode="repo").collect()}
    assert {r["path"] for r in scan.scoped(found, ["sub"]).collect()} == {"sub/b.tmp", "sub/c.md"}
    planned = scan.plan(scan.visible(found, lines))
    assert {r["path"]: r["handler"] for r in planned.collect()}["sub/c.md"] == "markdown"
    known = planned.where("path = 'a.py'").select(F.col("path").alias("repo_path"), "file_sha")
    assert [r["path"] for r in scan.unchanged(planned, known).collect()] == ["a.py"]


def test_parse_stage_and_store(spark, tmp_path):
    df = spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.py", "def (")], "path string, content string")
    from quillstrata.operators.parsers import base

    parsed = base.parse(df, "python", "path", "path", "content")
    staged = staging.persist_slices(ingest.empty(df, ingest.SLICES), ingest.parsed_slices(parsed), "b1", AT(1))
    assert staged.count() == 1
    symbols = ingest.parsed_symbols(parsed)
    merged = staging.merge_symbols(ingest.empty(df, ingest.SYMBOLS), symbols, "b1")
    again = staging.merge_symbols(merged.drop("op"), symbols.where("symbol_path like '%.f'"), "b2")
    assert {r["symbol_path"].split("::")[1]: (r["op"], r["last_seen_batch"]) for r in again.collect()} == {"a": ("keep", "b1"), "a.f": ("touch", "b2")}
    planned = df.withColumns({"handler": F.lit("python"), "reason": F.lit("extension")})
    row = ingest.run_counters(planned, parsed, staged).first()
    assert (row["discovered"], row["parsed"], row["failed"], row["written"], row["handlers"]) == (2, 1, 1, 1, {"python": 2})
    text = spark.range(1).select(ingest.summary_text(F.lit("ok"), F.lit(1), F.lit(1), F.lit(2), F.lit(3))).first()[0]
    assert text == "ok: 1 file parsed, 1 failed, 2 chunks written, 3 reused"
    store = Store(spark, str(tmp_path / "s"))
    store.publish(chunk_slices=staged.drop("op"), symbols=merged)
    first = store.versions()["symbols"]
    store.publish(symbols=again)
    assert store.tables() == ["chunk_slices", "symbols"] and store.versions()["symbols"] != first and store.read("symbols").count() == 2
    store.vacuum("symbols", 1)
    assert len(store.read("symbols").inputFiles()) == 1 and store.bounded_count("symbols", 1) is None and store.bounded_count("symbols") == 2
    free = store.lock()
    from quillstrata.sources.storage import LockedError

    with pytest.raises(LockedError):
        store.lock(0.2)
    free()


def test_a_publish_that_dies_between_its_steps_changes_nothing(spark, tmp_path, monkeypatch):
    one, two = spark.range(1), spark.range(2)
    store = Store(spark, str(tmp_path / "s"))
    store.publish(a=one, b=one)

    class Died(BaseException):
        pass

    steps = ["_write", "_renew", "_fs"]
    for step in steps:
        for after in range(1, 12):
            calls, plain = [], getattr(Store, step)

            def run(self, *args, plain=plain, calls=calls, after=after, **named):
                calls.append(args)
                if len(calls) >= after and (step != "_write" or str(args[0]).startswith("_next")):
                    raise Died
                return plain(self, *args, **named)

            monkeypatch.setattr(Store, step, run)
            broken = Store(spark, str(tmp_path / "s"))
            try:
                broken.publish(a=two)
                done = True
            except Died:
                done = False
            monkeypatch.setattr(Store, step, plain)
            (tmp_path / "s" / "_LOCK").unlink(missing_ok=True)
            (tmp_path / "s" / "._LOCK.crc").unlink(missing_ok=True)
            whole = Store(spark, str(tmp_path / "s"))
            assert whole.tables() == ["a", "b"] and whole.read("b").count() == 1 and whole.read("a").count() in (1, 2)
            whole.publish(a=one)
            assert whole.read("a").count() == 1
            if done:
                break


def test_the_lock_of_a_dead_writer_is_taken_over(spark, tmp_path, monkeypatch):
    from quillstrata.sources import storage

    dead, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    free = dead.lock()
    with pytest.raises(storage.LockedError):
        other.publish(a=spark.range(1)) if False else other.lock(0.2)
    monkeypatch.setattr(storage, "LOCK_SECONDS", -1.0)
    mine = other.lock(0.2)
    monkeypatch.undo()
    free()  # the dead writer's own is no longer there to be freed
    with pytest.raises(storage.LockedError):
        dead.lock(0.2)
    mine()
    dead.lock(0.2)()


def test_a_lock_freed_while_it_is_asked_for_is_taken(spark, tmp_path, monkeypatch):
    holder, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    free, plain = holder.lock(), other._write

    def late(*args, **named):
        try:
            plain(*args, **named)
        except Exception:
            free()  # between the refusal and the look at the file
            raise

    monkeypatch.setattr(other, "_write", late)
    other.lock(5)()


def test_two_writers_lose_no_update(spark, tmp_path):
    root = str(tmp_path / "s")
    Store(spark, root).publish(n=spark.range(0))

    def add(k):
        store = Store(spark, root)
        with store.writing(60):
            store.publish(n=store.read("n").union(spark.range(k, k + 1)))

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r[0] for r in Store(spark, root).read("n").collect()) == [0, 1, 2, 3]


def test_counts_stop_at_limits_and_times(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish(small=spark.range(5), large=spark.range(50))
    assert store.counted("small", 10, 30) == (5, "counted") and store.counted("large", 10, 30) == (None, "row-limit") and store.counted("large", 0, 0) == (50, "counted")
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    store.read = lambda t: spark.range(1).select(slow("id").alias("id")).where("id >= 0")
    assert store.counted("small", 10, 0.5) == (None, "timeout")
    del store.read
    assert {r["reason"]: r["tables"] for r in reasons(store.info(10, 30)).collect()} == {"row-limit": 1}


def test_documents(tmp_path):
    p = tmp_path / "m.json"
    assert documents.save_json(p, {"name": "x", "extra": 1}) and not documents.save_json(p, {"extra": 1, "name": "x"})
    assert documents.migrate_manifest(documents.load_json(p)) == {"extra": 1, "modules": {"source": {"name": "x"}, "db": {}}, "modules_version": 1}
    with documents.transaction(p) as d:
        d["y"] = 2
    rolled = []
    with pytest.raises(KeyError), documents.transaction(p, on_rollback=[lambda: rolled.append(1)]) as d:
        d["z"] = d["missing"]
    assert documents.load_json(p)["y"] == 2 and rolled == [1]
    for i in range(4):
        documents.backup(p, keep=2, stamp=str(i))
    assert len(list(tmp_path.glob("m.json.bak.*"))) == 2
    p.write_text("[")
    with pytest.raises(documents.DocumentError):
        documents.load_json(p)
    assert documents.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}, {"d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}


def test_migrations(spark):
    up = lambda t: t | {"n": len(t)}
    cat = [migrations.Migration("1", "x", up), migrations.Migration("2", "y", up, lambda t: t)]
    tables, done = migrations.upgrade(cat, [], {})
    assert done == ["1", "2"] and migrations.downgrade(cat, done, tables, 5)[1] == ["1"]
    with pytest.raises(migrations.MigrationError):
        migrations.validate(cat[::-1])
    with pytest.raises(migrations.MigrationError):
        migrations.validate([cat[0], migrations.Migration("3", "z", up)])
    c = spark.createDataFrame([(1, "1", "x"), (2, "2", "y")], migrations.LEDGER)
    assert migrations.pending(c, c.limit(1)).count() == 1 and migrations.changed(c, c.withColumn("checksum", F.lit("q"))).count() == 2


def test_stream(spark, sf, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (tmp_path / "in").mkdir()
    docs.limit(20).write.mode("append").parquet(str(tmp_path / "in"))
    schema = docs._jdf.schema().toDDL()
    stage_available(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "cp"))
    n = store.read("chunk_slices").count()
    stage_available(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "cp"))
    assert n > 20 and store.read("chunk_slices").count() == n
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert event_counts(events).agg(F.sum("n")).first()[0] == events.count()
    assert json.dumps({}) == "{}"
