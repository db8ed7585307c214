"""From files to staged tables: scan, plan, parse, stage, publish, and a run record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import text as T
from quillstrata.operators import chunking, staging
from quillstrata.operators.parsers import base as parsers

VERSION = "1.0.0"
SLICES = (
    "batch_id string, file_id string, chunk_id string, part_index int, part_total int, handler_name string, handler_version string, symbol_id string, parent_symbol_id string, start_line int, end_line int, start_byte long, end_byte long, "
    "token_count int, content_hash string, content_norm_hash string, content_text string, overflow_is_truncated boolean, overflow_reason string, metadata_json string, created_at timestamp, updated_at timestamp, first_seen_batch string, last_seen_batch string"
)
SYMBOLS = "file_id string, symbol_path string, kind string, start_line int, end_line int, symbol_sha string, symbol_norm_sha string, docstring string, tokens int, first_seen_batch string, last_seen_batch string"


def text_slices(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Slices of plain text as staging takes them."""
    c = chunking.with_hashes(chunking.text_chunks(docs, key, text))
    return c.select(
        F.col(key).cast("string").alias("file_id"), "chunk_id", F.lit(0).alias("part_index"), F.lit(1).alias("part_total"), F.lit(chunking.HANDLER).alias("handler_name"), F.lit(chunking.VERSION).alias("handler_version"),
        F.lit(None).cast("string").alias("symbol_id"), F.lit(None).cast("string").alias("parent_symbol_id"), "start_line", "end_line", F.col("start_byte").cast("long").alias("start_byte"), F.col("end_byte").cast("long").alias("end_byte"), "token_count", "content_hash", "content_norm_hash", "content_text",
        F.lit(False).alias("overflow_is_truncated"), F.lit(None).cast("string").alias("overflow_reason"), T.canonical_json(strategy=F.col("strategy"), char_start=F.col("char_start"), char_end=F.col("char_end")).alias("metadata_json"),
    )


def parsed_slices(parsed: DataFrame) -> DataFrame:
    """Slices of parsed files; a file with errors gives none."""
    c = parsers.chunks(parsed.where(F.size("errors") == 0))
    name = F.coalesce("delegate", "handler")
    norm = T.normalize_lines(F.col("content_text"))
    meta = lambda name: F.get_json_object("metadata_json", f"$.{name}")
    return c.select(
        F.col("key").alias("file_id"), "chunk_id", F.lit(0).alias("part_index"), F.lit(1).alias("part_total"), name.alias("handler_name"), F.lit(VERSION).alias("handler_version"), F.col("symbol").alias("symbol_id"), meta("delegate_parent_symbol").alias("parent_symbol_id"),
        "start_line", "end_line", "start_byte", "end_byte", "token_count", T.versioned_hash(VERSION, F.col("content_text"), F.col("chunk_id"), name).alias("content_hash"),
        F.when(norm != "", T.versioned_hash(VERSION, norm, F.col("chunk_id"), name)).alias("content_norm_hash"), "content_text",
        (F.coalesce(meta("overflow"), F.lit("false")).eqNullSafe("true") | F.coalesce(meta("overflow_is_truncated"), F.lit("false")).eqNullSafe("true")).alias("overflow_is_truncated"), meta("overflow_reason").alias("overflow_reason"), "metadata_json",
    )


def parsed_symbols(parsed: DataFrame) -> DataFrame:
    """Symbols with the hashes, tokens and lines of their chunks."""
    good = parsed.where(F.size("errors") == 0)
    s, c = parsers.symbols(good), parsers.chunks(good).where(F.col("symbol").isNotNull())
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_index", "start_byte", "content_text"))), lambda x: x["content_text"]), "")
    own = c.groupBy("key", F.col("symbol").alias("symbol_id")).agg(body.alias("text"), F.sum("token_count").cast("int").alias("tokens"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    line = F.get_json_object("metadata_json", "$.line").cast("int")
    j = s.join(own, ["key", "symbol_id"], "left").withColumns({"text": F.coalesce("text", F.lit("")), "start_line": F.coalesce("start_line", line, F.lit(0))})
    norm = T.normalize_lines(F.col("text"))
    return j.select(
        F.col("key").alias("file_id"), F.col("symbol_id").alias("symbol_path"), "kind", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), T.versioned_hash(VERSION, F.col("text"), F.col("symbol_id")).alias("symbol_sha"),
        F.when(norm != "", T.versioned_hash(VERSION, norm, F.col("symbol_id"))).alias("symbol_norm_sha"), "docstring", F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )


def partition_targets(targets: DataFrame, enabled: str = "enabled") -> tuple[DataFrame, DataFrame]:
    """Targets that are enabled, and those that are not (an unknown state counts as not)."""
    on = F.coalesce(F.col(enabled), F.lit(False))
    return targets.where(on), targets.where(~on)


def stage(slices: DataFrame, new: DataFrame, batch: str, at: Column) -> DataFrame:
    return staging.persist_slices(slices, new, batch, at)


def empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def run_counters(planned: DataFrame, parsed: DataFrame, staged: DataFrame) -> DataFrame:
    """One row: files found, parsed, failed and fallen back, chunks written and reused,
    and files by handler."""
    by = planned.groupBy("handler").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("handler", "count")))).alias("handlers"))
    found = planned.agg(F.count("*").alias("discovered"), F.count_if(F.col("reason") == "fallback").alias("fallbacks"))
    done = parsed.agg(F.count_if(F.size("errors") == 0).alias("parsed"), F.count_if(F.size("errors") > 0).alias("failed"), F.sum(F.size("warnings")).alias("warnings"))
    return found.crossJoin(done).crossJoin(by).crossJoin(staging.outcomes(staged))  # one row each


def summary_text(status: Column, parsed: Column, failed: Column, written: Column, reused: Column) -> Column:
    """What a run did, in a sentence."""
    n = lambda c, one: F.concat(c.cast("string"), F.lit(" " + one), F.when(c == 1, "").otherwise("s"))
    return F.concat(status, F.lit(": "), F.concat_ws(", ", F.concat(n(parsed, "file"), F.lit(" parsed")), F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" failed"))), F.concat(n(written, "chunk"), F.lit(" written")), F.when(reused > 0, F.concat(reused.cast("string"), F.lit(" reused")))))


def run_status(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "error").when(warnings > 0, "degraded").otherwise("ok")
