"""Versioned staging: batches, files, symbols and chunk slices with content reuse.

Parquet has no MERGE, so every mutation is a function of the old table and the change;
quillstrata.sources.storage publishes the result as a new version.  Keys are natural
strings; numeric ids are made at output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_KEY = ["file_id", "chunk_id", "part_index"]
#: Columns whose equality makes a slice the same as before.
#: The key and content_text count as well: the key is what rows are matched by, and the
#: text is in content_hash.
SIGNATURE = [
    "handler_name", "handler_version", "part_total", "symbol_id", "parent_symbol_id", "start_line", "end_line", "start_byte", "end_byte", "token_count", "content_hash", "content_norm_hash",
    "overflow_is_truncated", "overflow_reason", "metadata_json",
]
SYMBOL_SIGNATURE = ["kind", "start_line", "end_line", "symbol_sha", "symbol_norm_sha", "docstring", "tokens"]


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of new over rows of old with the same key; `keep` columns stay as they were."""
    if keep:
        prior = old.select(*key, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(prior, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).select(*new.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_batches(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"])


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slowly changing files, keyed by path; ids are stable, new ones follow the largest.

    The numbering window runs over new files only, by leading hash digits of the path,
    so that it is not one sorted run.
    """
    known = new.join(old.select("repo_path", F.col("id").alias("__id")), "repo_path", "left")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    fresh = known.where(F.col("__id").isNull()).withColumn("__bucket", F.substring(F.md5("repo_path"), 1, 3))
    counts = fresh.groupBy("__bucket").count()
    starts = counts.select("__bucket", F.coalesce(F.sum("count").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    order = Window.partitionBy("__bucket").orderBy(F.md5("repo_path"), "repo_path")
    numbered = fresh.join(F.broadcast(starts), "__bucket").crossJoin(F.broadcast(top)).withColumn("id", F.col("__top") + F.col("__start") + F.row_number().over(order))
    seen = known.where(F.col("__id").isNotNull()).withColumn("id", F.col("__id"))
    rows = seen.select(old.columns).unionByName(numbered.select(old.columns))
    return old.join(new.select("repo_path"), "repo_path", "left_anti").select(old.columns).unionByName(rows)


def _same(columns: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def merge_symbols(old: DataFrame, new: DataFrame, batch: str) -> DataFrame:
    """The symbol table after a batch, with op: insert, update, touch or keep."""
    key = ["file_id", "symbol_path"]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full")
    there, given = F.col("o.symbol_path").isNotNull(), F.col("n.symbol_path").isNotNull()
    op = F.when(~given, "keep").when(~there, "insert").when(_same(SYMBOL_SIGNATURE, "o", "n"), "touch").otherwise("update")
    pick = lambda c: F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(
        *[pick(c) for c in (*key, *SYMBOL_SIGNATURE)],
        F.coalesce(F.col("o.first_seen_batch"), F.lit(batch)).alias("first_seen_batch"),
        F.when(given, F.lit(batch)).otherwise(F.col("o.last_seen_batch")).alias("last_seen_batch"),
        op.alias("op"),
    )


def latest_slices(slices: DataFrame) -> DataFrame:
    """The newest version of every part."""
    order = Window.partitionBy(*SLICE_KEY).orderBy(F.desc("updated_at"), F.desc("last_seen_batch"))
    return slices.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def renumber_parts(slices: DataFrame) -> DataFrame:
    """part_index from 0 without gaps in the order given, and part_total."""
    chunk = Window.partitionBy("file_id", "chunk_id")
    return slices.withColumns({"part_total": F.count("*").over(chunk).cast("int"), "part_index": (F.row_number().over(chunk.orderBy("part_index")) - 1).cast("int")})


MARKS = {"batch_id": "string", "first_seen_batch": "string", "last_seen_batch": "string", "created_at": "timestamp", "updated_at": "timestamp"}


def _signed(slices: DataFrame, columns: list[str], old: bool) -> DataFrame:
    """One side's slices with a digest of their signature.  It is made before rows move, so
    that columns which only the signature has need not."""
    digest = F.unhex(F.md5(F.to_json(F.struct(*[c for c in SIGNATURE if c in slices.columns])).cast("binary")))
    own = [F.col(c) if old or c not in MARKS else F.lit(None).cast(MARKS[c]).alias(c) for c in columns]
    return slices.select(*own, F.lit(old).alias("__old"), digest.alias("__sig"))


def _widened(df: DataFrame, other: DataFrame) -> DataFrame:
    """df with nulls for the signature columns that only the other has."""
    lacking = [f for f in other.schema if f.name in SIGNATURE and f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}) if lacking else df


def decide(old: DataFrame, new: DataFrame, batch: str) -> DataFrame:
    """Every old and new slice with __old, what becomes of it (__op: insert, update, touch,
    keep, or drop) and, for rows that are written, __held_at and __first_seen.

    Old and new rows, texts and all, meet once, by file; all windows below are over that
    one distribution, and what groups by file or chunk afterwards finds it in place.
    """
    rows = _signed(old, old.columns, True).unionByName(_signed(new, old.columns, False)).repartition("file_id")
    is_old, part, chunk = F.col("__old"), Window.partitionBy(*SLICE_KEY), Window.partitionBy("file_id", "chunk_id")
    newest = F.row_number().over(Window.partitionBy(*SLICE_KEY, "__old").orderBy(F.desc("updated_at"), F.desc("last_seen_batch"))) == 1
    rows = rows.withColumn("__latest", is_old & newest)
    now, before = F.max(F.when(~is_old, F.col("__sig"))).over(part), F.max(F.when(F.col("__latest"), F.col("__sig"))).over(part)
    held = F.max(F.when(is_old & (F.col("batch_id") == batch), F.struct("created_at", "first_seen_batch"))).over(part)
    rows = rows.withColumns({"__same": F.coalesce(now == before, F.lit(False)), "__renewed": now.isNotNull(), "__held": held})
    counts = F.col("__latest") | ~is_old
    born = F.min(F.when(is_old, F.struct("created_at", "first_seen_batch"))).over(chunk)
    rows = rows.withColumns({"__given": F.max(~is_old).over(chunk), "__reused": F.every(~counts | F.col("__same")).over(chunk), "__born": born})
    written = F.col("__given") & ~F.col("__reused")
    op_old = F.when(F.col("__latest") & F.col("__given") & F.col("__reused"), "touch").when(written & F.col("__renewed") & (F.col("batch_id") == batch), "drop").otherwise("keep")
    op_new = F.when(~written, "drop").when(F.col("__held").isNull(), "insert").otherwise("update")
    first = F.coalesce("__held.first_seen_batch", "__born.first_seen_batch", F.lit(batch))
    return rows.select(*old.columns, "__old", F.when(is_old, op_old).otherwise(op_new).alias("__op"), F.col("__held.created_at").alias("__held_at"), first.alias("__first_seen"))


def persist_slices(old: DataFrame | None, new: DataFrame, batch: str, at: Column) -> DataFrame:
    """The slice table after a batch, with op: insert, update, touch or keep.

    A chunk all of whose parts equal their latest versions is reused: its rows keep
    their batch and only last_seen_batch moves.  Any other chunk of the batch is written
    anew, with the first-seen batch of its oldest version.  Chunks the batch does not
    name stay as they are, so reading by last_seen_batch no longer shows them.

    Either side is read once.  A column that one side lacks (a store from before it was
    added) is null there.  Without an old table (None) every slice is an insert.
    """
    if old is None:
        first = {"batch_id": F.lit(batch), "created_at": at, "updated_at": at, "first_seen_batch": F.lit(batch), "last_seen_batch": F.lit(batch)}
        return new.withColumns(first).withColumn("op", F.lit("insert"))
    old, new = _widened(old, new), _widened(new, old)
    made = decide(old, new, batch).where("__op != 'drop'")
    fresh, op = ~F.col("__old"), F.col("__op")
    seen = fresh | (op == "touch")
    moved = {
        "batch_id": F.when(fresh, F.lit(batch)).otherwise(F.col("batch_id")), "first_seen_batch": F.when(fresh, F.col("__first_seen")).otherwise(F.col("first_seen_batch")), "last_seen_batch": F.when(seen, F.lit(batch)).otherwise(F.col("last_seen_batch")),
        "created_at": F.when(fresh, F.coalesce("__held_at", at)).otherwise(F.col("created_at")), "updated_at": F.when(seen, at).otherwise(F.col("updated_at")),
    }
    return made.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in old.columns], op.alias("op"))


def touch_chunks(slices: DataFrame, chunks: DataFrame, batch: str, at: Column) -> DataFrame:
    """last_seen_batch and updated_at of the named chunks' slices not yet seen in batch."""
    named = slices.join(chunks.select("file_id", "chunk_id").distinct().withColumn("__named", F.lit(True)), ["file_id", "chunk_id"], "left")
    hit = F.col("__named").isNotNull() & (F.col("last_seen_batch") != batch)
    return named.withColumns({"updated_at": F.when(hit, at).otherwise(F.col("updated_at")), "last_seen_batch": F.when(hit, F.lit(batch)).otherwise(F.col("last_seen_batch"))}).select(slices.columns)


def delete_batch(slices: DataFrame, batch: str) -> DataFrame:
    return slices.where(F.col("batch_id") != batch)


def active(slices: DataFrame, batch: str, strict: bool = False) -> DataFrame:
    """What a batch sees: slices last seen in it, or, strictly, written by it."""
    return slices.where(F.col("batch_id" if strict else "last_seen_batch") == batch)


def by_chunk(slices: DataFrame, batch: str, chunk_id: str) -> DataFrame:
    return active(slices, batch).where(F.col("chunk_id") == chunk_id).orderBy("part_index")


def by_file(slices: DataFrame, batch: str, file_id: int) -> DataFrame:
    return active(slices, batch).where(F.col("file_id") == file_id).orderBy("chunk_id", "part_index")


def history(slices: DataFrame) -> DataFrame:
    """All versions, numbered within their file as they are listed."""
    order = Window.partitionBy("file_id").orderBy("chunk_id", F.desc("last_seen_batch"), "part_index")
    return slices.withColumn("position", F.row_number().over(order))


def outcomes(staged: DataFrame) -> DataFrame:
    """One row: written, reused and kept rows of a staged table."""
    return staged.agg(
        F.count_if(F.col("op").isin("insert", "update")).alias("written"), F.count_if(F.col("op") == "touch").alias("reused"), F.count_if(F.col("op") == "keep").alias("kept")
    )
