"""Vector index descriptions: what a set of vectors was built from, and whether it still
is what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import vectors

VERSION = 1
META = "vdb_id string, version int, provider string, model_id string, model_name string, dim int, metric string, index_type string, vector_count long, built_at timestamp, checksum string"
#: Index kinds that are the exact table.
EXACT = ("IDMap,Flat", "Flat", "flat")


def describe(vecs: DataFrame, vdb_id: str, provider: str, model: str, dim: int, metric: str, built_at: Column, index_type: str = "IDMap,Flat", key: str = "chunk_id") -> DataFrame:
    """The one-row description of a set's vectors."""
    if metric not in vectors.METRICS:
        raise vectors.VectorError(f"unknown metric {metric}")
    if index_type not in EXACT:
        raise vectors.VectorError(f"unknown index type {index_type}")
    sums = vectors.checksum(vecs, key)
    return sums.select(
        F.lit(vdb_id).alias("vdb_id"), F.lit(VERSION).alias("version"), F.lit(provider).alias("provider"), F.lit(f"{provider}:{model}").alias("model_id"), F.lit(model).alias("model_name"), F.lit(dim).alias("dim"),
        F.lit(metric).alias("metric"), F.lit(index_type).alias("index_type"), F.col("vectors").cast("long").alias("vector_count"), built_at.alias("built_at"), "checksum",
    )


def validate(meta: DataFrame, vecs: DataFrame, dim: int, metric: str, key: str = "chunk_id") -> DataFrame:
    """Codes of what does not hold: no rows where the description fits the vectors."""
    found = vectors.checksum(vecs, key).select(F.col("vectors").alias("n"), F.col("checksum").alias("now"))
    wrong = vecs.agg(F.count_if(F.size("embedding") != dim).alias("odd"))
    j = meta.crossJoin(found).crossJoin(wrong)  # a row each
    rules = {
        "dim-mismatch": (F.col("dim") != dim) | (F.col("odd") > 0), "metric-mismatch": F.col("metric") != metric, "count-mismatch": F.col("vector_count") != F.col("n"), "checksum-mismatch": F.col("checksum") != F.col("now"), "version-mismatch": F.col("version") != VERSION,
    }
    codes = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return j.select("vdb_id", F.explode(codes).alias("code"))
