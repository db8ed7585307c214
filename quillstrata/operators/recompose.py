"""Slices put together again: chunk texts, delegate trees, symbol texts, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import text as T


def _in_order(part: str, value: str) -> Column:
    """Texts of a group, joined in part order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(part).alias("i"), F.coalesce(F.col(value), F.lit("")).alias("v")))), lambda x: x["v"]), "")


def recompose(slices: DataFrame, key: list[str], part: str = "part_index", text: str = "content_text") -> DataFrame:
    """One row for each chunk: text in part order, token sum, outer bounds, part count,
    and what the first part says of handler and symbols.  A group is one chunk, which a
    document bounds."""
    have = set(slices.columns)
    first = [c for c in ("handler_name", "handler_version", "symbol_id", "parent_symbol_id", "batch_id", "first_seen_batch", "last_seen_batch", "metadata_json", "delegate_parent") if c in have]
    bounds = [F.min(c).alias(c) for c in ("start_line", "start_byte") if c in have] + [F.max(c).alias(c) for c in ("end_line", "end_byte") if c in have]
    tokens = [F.sum("token_count").cast("long").alias("token_count")] if "token_count" in have else []
    return slices.groupBy(*key).agg(_in_order(part, text).alias("text"), F.count("*").alias("parts"), *tokens, *bounds, *[F.min_by(c, part).alias(c) for c in first])


def delegate_tree(chunks: DataFrame) -> DataFrame:
    """Top-level chunks (chunk_id, delegate_parent, start_byte) with their children, two
    levels deep, children in order of place and id."""
    child = chunks.where(F.col("delegate_parent").isNotNull())
    kids = child.groupBy("file_id", F.col("delegate_parent").alias("chunk_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("start_byte", F.lit(0)).alias("at"), "chunk_id"))), lambda x: x["chunk_id"]).alias("delegate_children")
    )
    top = chunks.where(F.col("delegate_parent").isNull())
    empty = F.array().cast("array<string>")
    return top.join(kids, ["file_id", "chunk_id"], "left").withColumn("delegate_children", F.coalesce("delegate_children", empty))


def orphans(chunks: DataFrame) -> DataFrame:
    """Chunks that name a parent which is not there."""
    parents = chunks.select("file_id", F.col("chunk_id").alias("delegate_parent"))
    return chunks.where(F.col("delegate_parent").isNotNull()).join(parents, ["file_id", "delegate_parent"], "left_anti")


def tree_order(chunks: DataFrame) -> DataFrame:
    place = F.coalesce(*[F.col(c) for c in ("start_byte", "start_line", "part_index") if c in chunks.columns], F.lit(0))
    return chunks.orderBy("file_id", place, "chunk_id")


def symbol_candidates(chunks: DataFrame, version: str) -> DataFrame:
    """Symbols' texts from their chunks: hashes, tokens and line bounds."""
    text = _in_order("part_index", "content_text")
    out = chunks.where(F.col("symbol_path").isNotNull()).groupBy("file_id", "symbol_path").agg(
        text.alias("text"), F.sum("token_count").cast("int").alias("tokens"), F.coalesce(F.min("start_line"), F.lit(0)).alias("start_line"), F.coalesce(F.max("end_line"), F.min("start_line"), F.lit(0)).alias("end_line")
    )
    norm = T.normalize_lines(F.col("text"))
    return out.withColumns(
        {
            "symbol_sha": T.versioned_hash(version, F.col("text"), F.col("symbol_path")),
            "symbol_norm_sha": F.when(norm != "", T.versioned_hash(version, norm, F.col("symbol_path"))),
        }
    )


def ordered_distinct(df: DataFrame, group: list[str], order: str, value: str, name: str = "values") -> DataFrame:
    """The different values of each group in the order of their first appearance."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*group).agg(F.array_distinct(F.transform(rows, lambda r: r["v"])).alias(name))


def integrity(slices: DataFrame, key: list[str]) -> DataFrame:
    """Chunks whose parts do not fit: uneven totals, or indexes that are not 0..n-1."""
    g = slices.groupBy(*key).agg(
        F.min("part_total").alias("least_total"), F.max("part_total").alias("most_total"), F.count("*").alias("parts"), F.count_distinct("part_index").alias("indexes"), F.min("part_index").alias("low"), F.max("part_index").alias("high")
    )
    issue = (
        F.when(F.col("least_total") != F.col("most_total"), "inconsistent-total")
        .when((F.col("low") != 0) | (F.col("high") != F.col("most_total") - 1) | (F.col("indexes") != F.col("most_total")) | (F.col("parts") != F.col("most_total")), "missing-parts")
    )
    return g.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(*key, "issue", "parts", F.col("most_total").alias("part_total"))
