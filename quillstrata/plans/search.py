"""Extensions: keyword search over an inverted index, and retrieval by vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.operators import vectors


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, n: how often a term occurs in a document."""
    terms = F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\W+"))
    return docs.select(key, terms.alias("term")).where("term != ''").groupBy("term", key).agg(F.count("*").alias("n"))


def keyword_search(index: DataFrame, terms: list[str], key: str) -> DataFrame:
    """Documents that hold all terms, with the terms' total count."""
    own = index.where(F.col("term").isin(terms))
    return own.groupBy(key).agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("n")).where(F.col("terms") == len(set(terms))).select(key, "n")


def retrieve(chunks: DataFrame, vecs: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The chunks of the best vectors of every query."""
    hits = vectors.search(vecs, queries, k, metric, key="chunk_key")
    return hits.join(chunks, "chunk_key")
