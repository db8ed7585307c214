"""A workspace: sources, parsing runs, batches, vector sets and health over one store."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions import ids
from quillstrata.operators import batches, embedding, health, index, recompose, staging, vectors
from quillstrata.operators.parsers import base as parsers
from quillstrata.plans import ingest
from quillstrata.sources import documents, scan
from quillstrata.sources.storage import Store, settle

TABLES = {
    "batches": "id string, source string, generated_at timestamp, notes string",
    "files": "id string, batch_id string, repo_path string, lang string, file_sha string, size_bytes long",
    "symbols": ingest.SYMBOLS,
    "chunk_slices": ingest.SLICES,
    "vdbs": "id string, name string, batch_id string, provider string, model string, dim int, metric string",
    "chunks": "vdb_id string, symbol_id string, header_md string, body_text string, token_count long",
    "vectors": "vdb_id string, chunk_id string, dim int, embedding array<float>",
    "index_meta": index.META,
    "run_log": "source string, batch_id string, status string, summary string, files long, failed long, written long, reused long",
}


class WorkspaceError(ValueError):
    """An unknown or conflicting source, batch or vector set."""


def exclusive(method: Callable) -> Callable:
    """Runs a method that reads and publishes tables as one under the writers' lock."""

    @functools.wraps(method)
    def run(self: Workspace, *args: object, **named: object) -> object:
        with self.store.writing():
            return method(self, *args, **named)

    return run


class Workspace:
    """Settings live in one JSON document beside the store; all else is in tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.settings = Path(root) / "workspace.json"
        self.store = Store(spark, f"{root}/tables")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name) if name in self.store.tables() else self.spark.createDataFrame([], TABLES[name])

    # sources

    def sources(self) -> dict[str, dict]:
        return documents.load_json(self.settings).get("sources", {}) if self.settings.exists() else {}

    def add_source(self, name: str, path: str) -> None:
        self._edit(name, False, lambda s: s.update({name: {"path": path, "enabled": True}}))

    def enable(self, name: str, on: bool = True) -> None:
        self._edit(name, True, lambda s: s[name].update(enabled=on))

    def retarget(self, name: str, path: str) -> None:
        self._edit(name, True, lambda s: s[name].update(path=path))

    def rename(self, name: str, new: str) -> None:
        if new in self.sources():
            raise WorkspaceError(f"source {new} is there already")
        self._edit(name, True, lambda s: s.update({new: s.pop(name)}))

    def remove_source(self, name: str) -> None:
        self._edit(name, True, lambda s: s.pop(name))

    def _edit(self, name: str, known: bool, change) -> None:
        if (name in self.sources()) != known:
            raise WorkspaceError(f"source {name} is {'unknown' if known else 'there already'}")
        with documents.transaction(self.settings) as d:
            change(d.setdefault("sources", {}))

    # parsing

    @exclusive
    def parse(self, source: str, scope: list[str] = [], limits: parsers.Limits = parsers.Limits(), fail_fast: bool = False) -> str:  # noqa: B006, B008
        """Scans, parses and stages a source as a new batch; gives the batch's id."""
        known = self.sources().get(source)
        if known is None or not known["enabled"]:
            raise WorkspaceError(f"source {source} is unknown or disabled")
        batch, now = ids.uuid7(), F.lit(datetime.datetime.now(datetime.timezone.utc))
        found = scan.scoped(scan.visible(scan.files(self.spark, known["path"]), scan.read_ignore_files(self.spark, known["path"])), scope)
        planned = settle(scan.plan(found).withColumn("path", F.concat_ws("/", F.lit(source), "path")), "plan")
        plain = F.col("handler") == "text"
        text = planned.where(plain).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
        parsed = settle(parsers.parse(planned.where(~plain), F.col("handler"), "path", "path", "content", limits), "parsed")
        failed = parsed.where(F.size("errors") > 0).count()
        if fail_fast and failed:
            raise WorkspaceError(f"{failed} files failed")
        new = settle(ingest.text_slices(text, "path", "text").unionByName(ingest.parsed_slices(parsed)), "slices")
        slices = settle(staging.persist_slices(self.table("chunk_slices"), new, batch, now), "staged")
        files = planned.select(F.col("path").alias("id"), F.lit(batch).alias("batch_id"), F.col("path").alias("repo_path"), F.col("handler").alias("lang"), "file_sha", "size_bytes")
        made = self.spark.createDataFrame([(batch, source)], "id string, source string").select("id", "source", now.alias("generated_at"), F.lit(None).cast("string").alias("notes"))
        counts = staging.outcomes(slices).first()
        n = planned.count()
        status = "error" if failed else "ok"
        words = self.spark.range(1).select(ingest.summary_text(F.lit(status), F.lit(n - failed), F.lit(failed), F.lit(counts["written"]), F.lit(counts["reused"]))).first()[0]
        log = self.spark.createDataFrame([(source, batch, status, words, n, failed, counts["written"], counts["reused"])], TABLES["run_log"])
        self.store.publish(
            chunk_slices=slices.drop("op"), symbols=staging.merge_symbols(self.table("symbols"), ingest.parsed_symbols(parsed), batch).drop("op"), files=staging.upsert(self.table("files"), files, ["id"]),
            batches=staging.upsert_batches(self.table("batches"), made), run_log=self.table("run_log").unionByName(log),
        )
        return batch

    def recompose(self, batch: str) -> DataFrame:
        return recompose.recompose(staging.active(self.table("chunk_slices"), batch), ["file_id", "chunk_id"])

    def batch_summary(self, limit: int = 10) -> DataFrame:
        rows = batches.recent(self.table("batches"), limit)
        return batches.summary(rows, self.table("files"), self.table("symbols"), self.table("chunk_slices"))

    @exclusive
    def remove_batch(self, batch: str, force: bool = False) -> dict[str, int]:
        y = self.table("symbols").withColumn("id", F.col("symbol_path"))
        r = batches.remove(self.table("batches"), self.table("files"), y, self.table("chunk_slices"), self.table("vdbs"), batch, force)
        counts = r.counts.first().asDict()
        self.store.publish(batches=r.batches, files=r.files, symbols=r.symbols.drop("id"), chunk_slices=r.slices)
        return counts

    # vector sets

    @exclusive
    def create_vdb(self, name: str, selector: str, provider_name: str, model: str, dim: int, metric: str = "cosine") -> None:
        """selector: source@batch or source@latest.  Again with the same values: no change."""
        source, _, chosen = selector.partition("@")
        own = batches.select(self.table("batches").where(F.col("source") == source), chosen or "latest").first()
        if own is None:
            raise WorkspaceError(f"no batch for {selector}")
        row = (name, name, own["id"], provider_name, model, dim, metric)
        old = self.table("vdbs").where(F.col("name") == name).first()
        if old is not None:
            if tuple(old) != row:
                raise WorkspaceError(f"vector set {name} is there already, with other values")
            return
        self.store.publish(vdbs=self.table("vdbs").unionByName(self.spark.createDataFrame([row], TABLES["vdbs"])))

    def _vdb(self, name: str):
        row = self.table("vdbs").where(F.col("name") == name).first()
        if row is None:
            raise WorkspaceError(f"no vector set {name}")
        return row

    @exclusive
    def sync(self, name: str, provider: embedding.Provider, recompute: bool = False, limit: int | None = None, dry_run: bool = False, include_unsymbolized: bool = False) -> dict[str, int]:
        """Materialises a set's chunks, embeds those without a vector, describes the set."""
        v = self._vdb(name)
        chunks = self.recompose(v["batch_id"])
        if include_unsymbolized:
            chunks = chunks.withColumn("symbol_id", F.coalesce("symbol_id", F.concat_ws("#", "file_id", "chunk_id")))
        symbols = self.table("symbols").select(F.col("symbol_path").alias("id"), "symbol_path", "kind")
        new = vectors.payloads(chunks, symbols, self.table("files"), include_unsymbolized).where(F.col("symbol_id").isNotNull())
        own, have = self.table("chunks").where(F.col("vdb_id") == v["id"]), self.table("vectors").where(F.col("vdb_id") == v["id"])
        done = settle(vectors.materialize(own.drop("vdb_id"), new), "chunks")
        held = have.select(F.col("chunk_id").alias("symbol_id"))
        plan = vectors.plan(done, held, "symbol_id", "symbol_id", recompute, limit).first().asDict()
        ops = {r["op"]: r["count"] for r in done.groupBy("op").count().collect()}
        stats = plan | {"inserted": ops.get("insert", 0), "updated": ops.get("update", 0)}
        if dry_run:
            return stats
        due = vectors.targets(done, held, "symbol_id", recompute)
        due = due.orderBy("symbol_id").limit(limit) if limit is not None else due
        made = embedding.embed(due, provider, v["model"], "symbol_id", "body_text")
        unit = vectors.normalize(F.col("embedding")).cast("array<float>") if v["metric"] == "cosine" else F.col("embedding")
        fresh = vectors.check_dim(made.select(F.lit(v["id"]).alias("vdb_id"), F.col("symbol_id").alias("chunk_id"), "dim", unit.alias("embedding")), v["dim"])
        kept = have.limit(0) if recompute else have
        vecs = settle(kept.join(fresh.select("chunk_id"), "chunk_id", "left_anti").select(fresh.columns).unionByName(fresh), "vectors")
        now = F.lit(datetime.datetime.now(datetime.timezone.utc))
        meta = index.describe(vecs, v["id"], v["provider"], v["model"], v["dim"], v["metric"], now)
        other = lambda t: self.table(t).where(F.col("vdb_id") != v["id"])
        cols = ["vdb_id", "symbol_id", "header_md", "body_text", "token_count"]
        self.store.publish(
            chunks=other("chunks").select(cols).unionByName(done.withColumn("vdb_id", F.lit(v["id"])).select(cols)), vectors=other("vectors").select(vecs.columns).unionByName(vecs), index_meta=other("index_meta").unionByName(meta)
        )
        return stats

    def search(self, name: str, provider: embedding.Provider, texts: list[str], k: int = 5) -> DataFrame:
        """query_id, symbol, score, rank, header and text of the best chunks for each text."""
        v = self._vdb(name)
        q = self.spark.createDataFrame([(i, x) for i, x in enumerate(embedding.embed_texts(provider, v["model"], texts))], "query_id long, embedding array<double>")
        own = self.table("vectors").where(F.col("vdb_id") == v["id"]).withColumn("n", F.xxhash64("chunk_id"))
        hits = vectors.search(own, q, k, v["metric"], key="n")
        named = hits.join(own.select("n", "chunk_id"), "n")
        c = self.table("chunks").where(F.col("vdb_id") == v["id"])
        return named.join(c, named["chunk_id"] == c["symbol_id"]).select("query_id", "symbol_id", "score", "rank", "header_md", "body_text")

    @exclusive
    def reset_vdb(self, name: str, drop: bool = False) -> dict[str, int]:
        v = self._vdb(name)
        sets, chunks, vecs, counts = vectors.reset(self.table("vdbs"), self.table("chunks"), self.table("vectors"), v["id"], drop)
        got = counts.first().asDict()
        self.store.publish(vdbs=sets, chunks=chunks, vectors=vecs, index_meta=self.table("index_meta").where(F.col("vdb_id") != v["id"]))
        return got

    # health and administration

    def checkhealth(self) -> DataFrame:
        """module, name, status, codes of every source and vector set."""
        now = F.lit(datetime.datetime.now(datetime.timezone.utc))
        runs = self.table("run_log").groupBy("source").agg(F.max_by("batch_id", "batch_id").alias("batch_id"), F.max_by("status", "batch_id").alias("status"))
        names = self.spark.createDataFrame([(n,) for n in self.sources()], "name string")
        state = names.join(runs, F.col("name") == F.col("source"), "left").select("name", "batch_id", "status", F.lit(0).alias("lock_seconds"), F.lit(0).alias("lock_events"))
        report = health.worst(health.parser_batches(state), names, "parser")
        meta = self.table("index_meta").select(F.col("vdb_id").alias("m"), F.col("dim").alias("meta_dim"), F.col("model_name").alias("meta_model"), F.col("vector_count").alias("meta_vectors"), F.col("built_at").alias("meta_built_at"))
        sets = self.table("vdbs").join(meta, F.col("id") == F.col("m"), "left")
        chunks = self.table("chunks").select(F.col("symbol_id").alias("chunk_id"), "vdb_id")
        last = batches.latest(self.table("batches")).first()
        found = health.vector_sets(sets, chunks, self.table("vectors").select("chunk_id", "vdb_id"), last["id"] if last else None, now)
        return report.unionByName(health.worst(found, sets, "vdb"))

    def run_sql(self, script: str) -> list[DataFrame]:
        """Runs statements over the tables, which are views for their time."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        return [self.spark.sql(s) for s in script.split(";") if s.strip()]
