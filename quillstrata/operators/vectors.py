"""Vector sets: payloads, materialised chunks, the vector table, exact search, reset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = {"cosine": "ip", "ip": "ip", "inner_product": "ip", "l2": "l2", "euclidean": "l2"}
#: Bytes of queries that go to the vectors at once (65,536 of 64 doubles), and of the
#: scores that a task holds at once (it works on a few matrices of that size).
QUERY_BYTES, MATRIX_BYTES = 32 << 20, 16 << 20


class VectorError(ValueError):
    """Unknown ids, wrong dimensions, unknown metrics or sizes out of range."""


def header(symbol_path: Column, repo_path: Column, kind: Column, chunk: Column, handler: Column, version: Column, start: Column, end: Column) -> Column:
    """Markdown that says where a chunk is from."""
    lines = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("- Lines: "), start.cast("string"), F.lit("-"), end.cast("string")))
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), symbol_path), F.lit(""), F.concat(F.lit("- File: `"), repo_path, F.lit("`")), F.concat(F.lit("- Kind: "), kind),
        F.concat(F.lit("- Chunk: `"), chunk, F.lit("`")), F.concat(F.lit("- Handler: "), handler, F.lit(" v"), version), lines,
    )


def payloads(chunks: DataFrame, symbols: DataFrame, files: DataFrame, include_unsymbolized: bool = False) -> DataFrame:
    """Recomposed chunks with their symbol and file: file_id, chunk_id, symbol_id,
    header_md, body_text, token_count.  Chunks without a symbol are left out."""
    how = "left" if include_unsymbolized else "inner"
    s = symbols.select(F.col("id").alias("symbol_id"), "symbol_path", "kind")
    f = files.select(F.col("id").alias("file_id"), "repo_path")
    joined = chunks.join(f, "file_id").join(s, "symbol_id", how)  # recomposed chunks lie by file already
    path = F.coalesce("symbol_path", "chunk_id")
    head = header(path, F.col("repo_path"), F.coalesce("kind", F.lit("chunk")), F.col("chunk_id"), F.col("handler_name"), F.col("handler_version"), F.col("start_line"), F.col("end_line"))
    return joined.select("file_id", "chunk_id", "symbol_id", head.alias("header_md"), F.col("text").alias("body_text"), "token_count")


def missing_references(chunks: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose symbol or file is not there."""
    named = chunks.where(F.col("symbol_id").isNotNull())
    a = named.join(symbols, named["symbol_id"] == symbols["id"], "left_anti").select("chunk_id", F.lit("symbol").alias("missing"))
    return a.unionByName(chunks.join(files, chunks["file_id"] == files["id"], "left_anti").select("chunk_id", F.lit("file").alias("missing")))


def materialize(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table (symbol_id, header_md, body_text, token_count) after payloads, with
    op; of several payloads of a symbol the last in chunk order wins.  Each column is taken
    on its own, so that one nobody asks for does not move."""
    won = new.groupBy("symbol_id").agg(*[F.max_by(c, F.struct("chunk_id", "file_id")).alias(c) for c in ("header_md", "body_text", "token_count")], F.count("*").alias("payloads"))
    o, n = chunks.alias("o"), won.alias("n")
    joined = o.join(n, F.col("o.symbol_id") == F.col("n.symbol_id"), "full")
    op = F.when(F.col("n.payloads").isNull(), "keep").when(F.col("o.symbol_id").isNull(), "insert").otherwise("update")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return joined.select(F.coalesce("o.symbol_id", "n.symbol_id").alias("symbol_id"), pick("header_md"), pick("body_text"), pick("token_count"), op.alias("op"), F.coalesce("payloads", F.lit(0)).alias("payloads"))


def targets(records: DataFrame, vectors: DataFrame, key: str, recompute: bool = False) -> DataFrame:
    """Records to embed: those without a vector, or all."""
    return records if recompute else records.join(vectors.select(key), key, "left_anti")


def plan(records: DataFrame, vectors: DataFrame, key: str, order: str, recompute: bool = False, limit: int | None = None) -> DataFrame:
    """One row: total, to embed, skipped."""
    due = targets(records, vectors, key, recompute).agg(F.count("*").alias("due"))
    both = records.agg(F.count("*").alias("total")).crossJoin(due)  # one row each
    n = F.least("due", F.lit(limit)) if limit is not None else F.col("due")
    return both.select("total", n.cast("long").alias("embed"), (F.col("total") - n).cast("long").alias("skipped"))


def totals(counters: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of sets and the sum of each counter over them."""
    return counters.agg(F.count("*").alias("sets"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])


def limited(records: DataFrame, vectors: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    return targets(records, vectors, key).orderBy(order).limit(limit)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length in doubles; the zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def check_dim(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """vectors, failing on the first of another dimension."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, found "), F.size(column).cast("string")))
    return vectors.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(wrong.cast(vectors.schema[column].dataType)))


def add(vectors: DataFrame, new: DataFrame, dim: int, key: str = "vec_id") -> DataFrame:
    new = check_dim(new, dim)
    return vectors.join(new.select(key), key, "left_anti").unionByName(new.select(vectors.columns))


def _need_all(vectors: DataFrame, ids: DataFrame, key: str) -> None:
    lost = ids.select(key).distinct().join(vectors.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise VectorError(f"no vector {lost[0][0]}")


def remove(vectors: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    _need_all(vectors, ids, key)
    return vectors.join(ids.select(key), key, "left_anti")


def reconstruct(vectors: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    _need_all(vectors, ids, key)
    return vectors.join(ids.select(key).distinct(), key, "left_semi")


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", query_key: str = "query_id", column: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank of the k best vectors of every query, exact.

    Inner product from large to small, squared distance from small to large, ties by id.
    A set of queries of checked size goes to the vectors, each partition keeps its own k
    best of every query (one matrix product for a batch), and only those are ranked:
    what is shuffled is k rows for a query and partition, never all pairs.
    """
    if metric not in METRICS:
        raise VectorError(f"unknown metric {metric}")
    if k <= 0:
        raise VectorError("k must be positive")
    kind = METRICS[metric]
    held = queries.select(query_key, column)
    size = held.agg(F.count("*"), F.max(F.size(column))).first()
    if not size[0]:
        return vectors.sparkSession.createDataFrame([], f"{query_key} long, {key} long, score double, rank int")
    block = max(1, QUERY_BYTES // (8 * size[1]))
    parts = -(-size[0] // block)
    best = None
    for p in range(parts):
        own = held if parts == 1 else held.where(F.pmod(F.xxhash64(query_key), F.lit(parts)) == p)
        block_rows = own.select(F.col(query_key).cast("long"), F.col(column).cast("array<double>")).toArrow()  # about QUERY_BYTES
        if not block_rows.num_rows:
            continue
        flat = block_rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        found = _partial(vectors, block_rows.column(0).to_numpy(), flat.reshape(block_rows.num_rows, -1), k, kind, key, query_key, column)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy(query_key).orderBy(F.desc("score") if kind == "ip" else F.asc("score"), key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(q: np.ndarray, v: np.ndarray, bound: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, vector rows and scores of the k best pairs of every query, with those
    that tie with the last of them and without those behind the query's bound (the k-th
    score so far, or no number).  Products are summed in the order of the dimensions, as a
    fold over them would, in place: two matrices, and one of booleans."""
    s, part = np.zeros((len(q), len(v))), np.empty((len(q), len(v)))
    for d in range(v.shape[1]):
        if kind == "ip":
            np.multiply(q[:, d, None], v[None, :, d], out=part)
        else:
            np.subtract(q[:, d, None], v[None, :, d], out=part)
            np.multiply(part, part, out=part)
        s += part
    behind = np.less if kind == "ip" else np.greater
    out = behind(s, bound[:, None])
    if len(v) > k:
        (np.negative if kind == "ip" else np.positive)(s, out=part)
        part.partition(k - 1, axis=1)
        last = part[:, k - 1, None]
        out |= behind(s, -last if kind == "ip" else last)  # what is no number is never behind, and loses the ranking
    r, c = np.nonzero(~out)
    return r, c, s[r, c]


def _best(rows: list[np.ndarray], k: int, kind: str) -> list[np.ndarray]:
    """Of query rows, ids and scores the k best of every query, by score and id."""
    r, i, s = rows
    order = np.lexsort((i, -s if kind == "ip" else s, r))
    r = r[order]
    kept = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
    return [x[kept] for x in rows]


def _partial(vectors: DataFrame, ids: np.ndarray, rows: np.ndarray, k: int, kind: str, key: str, query_key: str, column: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids.astype(np.int64), rows.astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        found, bound = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], np.full(len(qid), np.nan)
        step = max(16, MATRIX_BYTES // (8 * max(1, len(qid))))
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            i = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            r, c, s = _nearest(q, v, bound, k, kind)
            found = _best([np.concatenate(x) for x in zip(found, (r, i[c], s), strict=True)], k, kind)
            ends = np.cumsum(np.bincount(found[0], minlength=len(qid)))
            whole_k = np.diff(ends, prepend=0) == k
            bound[whole_k] = found[2][ends[whole_k] - 1]
        r, i, s = found
        yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(i), pa.array(s)], names=[query_key, key, "score"])

    return vectors.select(F.col(key).cast("long"), column).mapInArrow(run, f"{query_key} long, {key} long, score double")


def missing(chunks: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors.select(key), key, "left_anti")


def orphaned(chunks: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Vectors without a chunk."""
    return vectors.join(chunks.select(key), key, "left_anti")


def checksum(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row: a checksum that depends on ids and floats and not on their order."""
    row = F.xxhash64(key, column)
    return vectors.agg(F.count("*").alias("vectors"), F.bit_xor(row).alias("xor"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("sum")).select("vectors", F.sha2(F.concat_ws(":", "vectors", "xor", "sum").cast("binary"), 256).alias("checksum"))


def reset(vdbs: DataFrame, chunks: DataFrame, vectors: DataFrame, vdb: int, drop: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables without a set's chunks and vectors (and the set, with drop), and counts."""
    own = F.col("vdb_id") == vdb
    counts = chunks.agg(F.count_if(own).alias("chunks_deleted")).crossJoin(vectors.agg(F.count_if(own).alias("vectors_deleted"))).crossJoin(vdbs.agg(F.count_if((F.col("id") == vdb) & F.lit(drop)).alias("vdbs_deleted")))
    return (vdbs.where(F.col("id") != vdb) if drop else vdbs), chunks.where(~own), vectors.where(~own), counts
