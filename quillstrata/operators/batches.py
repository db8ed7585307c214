"""Batches: selection, summaries, and removal with reassignment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class BatchError(ValueError):
    """A batch that is missing, in use, or the latest one without force."""


def recent(batches: DataFrame, limit: int = 10) -> DataFrame:
    return batches.orderBy(F.desc("generated_at"), F.desc("id")).limit(limit)


def latest(batches: DataFrame) -> DataFrame:
    return recent(batches, 1)


def select(batches: DataFrame, selector: str) -> DataFrame:
    return latest(batches) if selector == "latest" else batches.where(F.col("id") == selector)


def summary(batches: DataFrame, files: DataFrame, symbols: DataFrame, slices: DataFrame) -> DataFrame:
    """Every batch with its files, symbols and slices; counted before they are joined."""
    out = batches
    for df, key, name in ((files, "batch_id", "files"), (symbols, "last_seen_batch", "symbols"), (slices, "batch_id", "slices")):
        counts = df.groupBy(F.col(key).alias("__b")).agg(F.count("*").alias(name))
        out = out.join(counts, F.col("id") == F.col("__b"), "left").drop("__b").fillna(0, [name])
    return out


@dataclass
class Removal:
    batches: DataFrame
    files: DataFrame
    symbols: DataFrame
    slices: DataFrame
    counts: DataFrame


def _is(column: str, batch: str) -> Column:
    return F.col(column) == F.lit(batch)


def remove(batches: DataFrame, files: DataFrame, symbols: DataFrame, slices: DataFrame, vdbs: DataFrame | None, batch: str, force: bool = False) -> Removal:
    """A batch removed: what later batches reuse moves to them, the rest goes.

    The steps depend on each other's results and run in this order; each is an
    expression over the table before it.  Each of the five results reads the tables that it
    needs, so a caller that wants several hands in written tables, not long plans.
    """
    if batches.where(_is("id", batch)).isEmpty():
        raise BatchError(f"no batch {batch}")
    if vdbs is not None and not vdbs.where(_is("batch_id", batch)).isEmpty():
        raise BatchError(f"batch {batch} is used by a vector set")
    if not force and latest(batches).first()["id"] == batch:
        raise BatchError(f"batch {batch} is the latest; force removes it")

    first, last = "first_seen_batch", "last_seen_batch"
    moves = _is("batch_id", batch) & ~_is(last, batch)
    s = slices.withColumns({"__moved": moves, "__gone": _is("batch_id", batch) & _is(last, batch)})
    s = s.withColumns({first: F.when(moves & _is(first, batch), F.col(last)).otherwise(F.col(first)), "batch_id": F.when(moves, F.col(last)).otherwise(F.col("batch_id"))})
    slice_counts = [F.count_if("__moved").alias("chunks_reassigned"), F.count_if("__gone").alias("chunks_deleted")]
    kept = s.where(~F.col("__gone"))
    kept = kept.withColumns({"__f": _is(first, batch) & ~_is("batch_id", batch), "__l": _is(last, batch) & ~_is("batch_id", batch)})
    rest = kept.agg(F.count_if("__f").alias("chunk_first_reassigned"), F.count_if("__l").alias("chunk_last_seen_reset"))
    after = kept.withColumns({first: F.when(F.col("__f"), F.col("batch_id")).otherwise(F.col(first)), last: F.when(F.col("__l"), F.col("batch_id")).otherwise(F.col(last))}).select(slices.columns)

    newest = lambda key, name: after.where(~_is(last, batch)).groupBy(F.col(key).alias("__k")).agg(F.max(last).alias(name))
    y = symbols.withColumn("__first", _is(first, batch) & ~_is(last, batch))
    y = y.withColumn(first, F.when(F.col("__first"), F.col(last)).otherwise(F.col(first))).withColumn("__reset", _is(last, batch) & ~_is(first, batch))
    y = y.join(newest("symbol_id", "__seen"), F.col("id") == F.col("__k"), "left").withColumn(last, F.when(F.col("__reset"), F.coalesce("__seen", first)).otherwise(F.col(last)))
    symbol_counts = y.agg(F.count_if("__first").alias("symbols_reassigned"), F.count_if("__reset").alias("symbol_last_seen_reset"), F.count_if(_is(last, batch)).alias("symbols_deleted"))

    f = files.join(newest("file_id", "__seen"), F.col("id") == F.col("__k"), "left").withColumn("__moved", _is("batch_id", batch) & F.col("__seen").isNotNull())
    f = f.withColumn("batch_id", F.when(F.col("__moved"), F.col("__seen")).otherwise(F.col("batch_id")))
    file_counts = f.agg(F.count_if("__moved").alias("files_reassigned"), F.count_if(_is("batch_id", batch)).alias("files_deleted"))
    # four tables of one row each
    counts = s.agg(*slice_counts).crossJoin(rest).crossJoin(symbol_counts).crossJoin(file_counts)
    return Removal(batches.where(~_is("id", batch)), f.where(~_is("batch_id", batch)).select(files.columns), y.where(~_is(last, batch)).select(symbols.columns), after, counts)
