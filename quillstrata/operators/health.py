"""Health rules: each gives rows (module, name, code, level, message); rules are joined
by union, folded to the worst level, and merged into the last report by module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels from good to bad.
LEVELS = ["ok", "unknown", "degraded", "error"]
STALE_DAYS = 30
VACUUM_DAYS = 7
LOCK_SECONDS, LOCK_EVENTS = (5, 30), (3, 10)


def severity(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1


def finding(df: DataFrame, when: Column, module: str, code: str, level: str, message: Column) -> DataFrame:
    return df.where(when).select(F.lit(module).alias("module"), "name", F.lit(code).alias("code"), F.lit(level).alias("level"), message.alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def worst(findings: DataFrame, names: DataFrame, module: str) -> DataFrame:
    """One row for each name: its worst level and its codes in order."""
    g = findings.groupBy("name").agg(F.max_by("level", severity(F.col("level"))).alias("status"), F.array_sort(F.collect_set("code")).alias("codes"))
    return names.select("name").join(g, "name", "left").select(F.lit(module).alias("module"), "name", F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def vector_sets(sets: DataFrame, chunks: DataFrame, vectors: DataFrame, latest_batch: str | None, now: Column) -> DataFrame:
    """Findings of vector sets (id, name, batch_id, dim, metric, and the sidecar's fields
    meta_*, null where there is none).  Rules on meta_text (the sidecar as it was read),
    meta_vdb, meta_model_id and model_id, meta_provider and provider, and index_exists hold
    where sets have these columns; a sidecar that cannot be parsed has no other fields."""
    pair = ["chunk_id", "vdb_id"]
    c = chunks.groupBy("vdb_id").agg(F.count("*").alias("chunks"))
    v = vectors.groupBy("vdb_id").agg(F.count("*").alias("vectors"))
    lost = chunks.join(vectors.select(pair), pair, "left_anti").groupBy("vdb_id").agg(F.count("*").alias("missing"))
    extra = vectors.join(chunks.select(pair), pair, "left_anti").groupBy("vdb_id").agg(F.count("*").alias("orphans"))
    s = sets
    for t in (c, v, lost, extra):
        s = s.join(t.withColumnRenamed("vdb_id", "__v"), F.col("id") == F.col("__v"), "left").drop("__v")
    s = s.fillna(0, ["chunks", "vectors", "missing", "orphans"])
    text = lambda *p: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    meta, rule = F.col("meta_dim").isNotNull(), lambda when, code, level, *m: finding(s, when, "vdb", code, level, text(*m))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("meta_built_at")) / 86400)
    parts = [
        rule((F.col("chunks") == 0) & (F.col("vectors") == 0), "not-synced", "unknown", "nothing is synchronised yet"),
        rule(F.col("missing") > 0, "missing-vectors", "error", F.col("missing"), " chunks have no vector"),
        rule(F.col("orphans") > 0, "orphan-vectors", "degraded", F.col("orphans"), " vectors have no chunk"),
        rule(F.col("chunks") != F.col("vectors"), "count-drift", "degraded", F.col("chunks"), " chunks, ", F.col("vectors"), " vectors"),
        rule(~meta & (F.col("vectors") > 0), "missing-sidecar", "error", "vectors without a description"),
        rule(meta & (F.col("meta_vectors") != F.col("vectors")), "index-drift", "error", F.col("meta_vectors"), " described, ", F.col("vectors"), " stored"),
        rule(meta & (F.col("meta_dim") != F.col("dim")), "dim-mismatch", "error", F.col("meta_dim"), " described, ", F.col("dim"), " configured"),
        rule(meta & (F.col("meta_model") != F.col("model")), "model-name-mismatch", "error", F.col("meta_model"), " described, ", F.col("model"), " configured"),
        rule(meta & F.col("meta_built_at").isNull(), "missing-built-at", "degraded", "no build time"),
        rule(meta & (age > STALE_DAYS), "stale-built-at", "degraded", "built ", age, " days ago"),
    ]
    there = lambda *names: all(n in sets.columns for n in names)
    differ = lambda a, b: F.col(a).isNotNull() & (F.lower(F.trim(F.col(a).cast("string"))) != F.lower(F.trim(F.col(b).cast("string"))))
    if there("meta_text"):
        parsed = F.from_json("meta_text", "dim string, built_at string")
        sound = F.coalesce(F.is_valid_utf8("meta_text"), F.lit(True)) & F.try_parse_json("meta_text").isNotNull()
        parts.append(rule(F.col("meta_text").isNotNull() & ~sound, "sidecar-invalid", "error", "the description cannot be read"))
        parts.append(rule(sound & parsed["dim"].isNotNull() & parsed["dim"].try_cast("int").isNull(), "sidecar-field", "error", "dim is invalid: ", parsed["dim"]))
    if there("meta_vdb"):
        parts.append(rule(differ("meta_vdb", "id"), "sidecar-mismatch", "error", "described for set ", F.col("meta_vdb")))
    if there("meta_model_id", "model_id"):
        parts.append(rule(differ("meta_model_id", "model_id"), "model-mismatch", "error", F.col("meta_model_id"), " described, ", F.col("model_id"), " configured"))
    if there("meta_provider", "provider"):
        parts.append(rule(differ("meta_provider", "provider"), "provider-mismatch", "error", F.col("meta_provider"), " described, ", F.col("provider"), " configured"))
    if there("index_exists"):
        parts.append(rule(~F.col("index_exists") & (F.col("vectors") > 0), "missing-index", "degraded", "vectors without an index"))
    if latest_batch is not None:
        parts.append(rule(F.col("batch_id") != latest_batch, "stale-batch", "degraded", "on ", F.col("batch_id"), ", latest is ", F.lit(latest_batch)))
    return union(parts)


def parser_batches(runs: DataFrame) -> DataFrame:
    """Findings of run records (name, batch_id, status, lock_seconds, lock_events)."""
    waits = F.greatest(F.coalesce("lock_seconds", F.lit(0)), F.lit(0))
    events = F.coalesce("lock_events", F.lit(0))
    bad = (waits >= LOCK_SECONDS[1]) | (events >= LOCK_EVENTS[1])
    slow = (waits >= LOCK_SECONDS[0]) | (events >= LOCK_EVENTS[0])
    return union(
        [
            finding(runs, F.col("batch_id").isNull(), "parser", "never-run", "unknown", F.lit("no batch yet")),
            finding(runs, F.col("status") == "error", "parser", "run-failed", "error", F.lit("the last run failed")),
            finding(runs, bad, "parser", "lock-contention", "error", F.lit("locks are contended")),
            finding(runs, slow & ~bad, "parser", "lock-contention", "degraded", F.lit("locks are slow")),
        ]
    )


def databases(states: DataFrame, now: Column) -> DataFrame:
    """Findings of schema states (name, expected, applied, ledger, recorded, vacuumed_at)."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("vacuumed_at")) / 86400)
    return union(
        [
            finding(states, F.col("applied").isNull(), "db", "missing", "error", F.lit("no schema")),
            finding(states, F.col("applied") < F.col("expected"), "db", "pending", "degraded", F.lit("migrations are pending")),
            finding(states, F.col("ledger") != F.col("recorded"), "db", "ledger-drift", "error", F.lit("the ledger changed")),
            finding(states, age > VACUUM_DAYS, "db", "vacuum-stale", "degraded", F.lit("not compacted lately")),
        ]
    )


def sources(rows: DataFrame, now: Column) -> DataFrame:
    """Findings of sources (name, enabled, exists, target, readable, refreshed_at)."""
    return union(
        [
            finding(rows, ~F.col("enabled"), "source", "disabled", "unknown", F.lit("disabled")),
            finding(rows, ~F.col("exists"), "source", "missing-directory", "error", F.lit("its directory is missing")),
            finding(rows, F.col("target").isNull(), "source", "no-target", "degraded", F.lit("no target")),
            finding(rows, F.col("target").isNotNull() & ~F.col("readable"), "source", "unreadable-target", "error", F.lit("the target cannot be read")),
            finding(rows, F.col("refreshed_at").isNull(), "source", "never-refreshed", "unknown", F.lit("never refreshed")),
        ]
    )


def merge(report: DataFrame, new: DataFrame) -> DataFrame:
    """Modules of `new` replace theirs in the report; others are carried forward."""
    return report.join(new.select("module").distinct(), "module", "left_anti").unionByName(new)
