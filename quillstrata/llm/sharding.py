"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

Native: DataFrame expressions only.  The 64-bit linear congruential step of the
published algorithm wraps around, which Spark's checked arithmetic refuses, so it
runs on 16-bit limbs of the state.

Defined results
    null key            the key 0
    non-integral key    its xxhash64
    repeated rows       the same shard, slots of their own
    equal keys          ordered by size, then by checksum of the text
    empty table         no rows
    clashing columns    shard, slot, grown_shard, size, text_crc32 and law replace columns
                        of that name; all others stay
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Multiplier of the published generator, as 16-bit limbs, lowest first.
MULTIPLIER = 2862933555777941757
LIMBS = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]

#: Rows that one slot bucket holds on average.
BUCKET_ROWS = 20_000


def _step(state: Column) -> Column:
    """state * MULTIPLIER + 1 modulo 2**64; the state is struct(a, b, c, d) of
    16-bit limbs, lowest first."""
    s = [state[x] for x in "abcd"]
    sums = []
    for i in range(4):
        terms = [s[j] * F.lit(LIMBS[i - j]) for j in range(i + 1)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        sums.append(total + F.lit(1) if i == 0 else total)
    c0 = sums[0]
    c1 = sums[1] + F.shiftright(c0, 16)
    c2 = sums[2] + F.shiftright(c1, 16)
    c3 = sums[3] + F.shiftright(c2, 16)
    mask = F.lit(0xFFFF).cast("long")
    return F.struct(*[x.bitwiseAND(mask).alias(n) for n, x in zip("abcd", (c0, c1, c2, c3), strict=True)])


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key among `shards`.

    A candidate rises by at least one each step, so `shards` steps always reach
    the end; steps after the end leave the state as it is.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    mask = F.lit(0xFFFF).cast("long")
    k = F.coalesce(key, F.lit(0)).cast("long")
    limbs = [F.shiftrightunsigned(k, 16 * i).bitwiseAND(mask) for i in range(4)]
    start = F.struct(
        F.struct(*[x.alias(n) for n, x in zip("abcd", limbs, strict=True)]).alias("state"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def walk(acc: Column, _: Column) -> Column:
        # the state is stepped by an inner fold of one element, so that it is evaluated once
        def jump(acc2: Column, state: Column) -> Column:
            high = state["d"] * F.lit(32768) + F.shiftright(state["c"], 1)
            nxt = F.floor((acc2["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double")))
            return F.struct(state.alias("state"), acc2["j"].alias("b"), nxt.cast("long").alias("j"))

        done = acc["j"] >= F.lit(shards)
        return F.when(done, acc).otherwise(F.aggregate(F.array(_step(acc["state"])), acc, jump))

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, walk, lambda acc: acc["b"]).cast("int")


def key_of(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return F.col(column).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(column)


def assign_shards(df: DataFrame, key: str, shards: int, grown: int | None = None) -> DataFrame:
    """df with `shard` and, where `grown` is given, `grown_shard`."""
    k = key_of(df, key)
    out = df.withColumn("shard", jump_shard(k, shards))
    return out.withColumn("grown_shard", jump_shard(k, grown)) if grown else out


def number_slots(df: DataFrame, key: str, ties: list[str], rows: int | None = None) -> DataFrame:
    """df (with `shard`) with `slot`: gapless from 0 within each shard.

    A shard may hold an eighth of all rows, and a key (null, say) a third, so no task
    numbers a whole shard or key: rows are numbered within buckets of a hash of key and
    ties, and the buckets of a shard are offset by prefix sums over their counts (a table
    of one row for each bucket).  The caller's columns travel in a struct.
    """
    rows = df.count() if rows is None else rows
    buckets = max(1, -(-rows // BUCKET_ROWS)) * 4
    own = [c for c in df.columns if c != "slot"]
    bucket = F.pmod(F.xxhash64(key, *ties), F.lit(buckets)).cast("int")
    order = [F.col(c).alias(f"order{i}") for i, c in enumerate((key, *ties))]
    b = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in own]).alias("doc"), F.col("shard").alias("place"), bucket.alias("bucket"), *order)
    counts = b.groupBy("place", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("place").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("place", "bucket").orderBy(*[f"order{i}" for i in range(len(order))])
    numbered = b.withColumn("at", F.row_number().over(inside) - 1)
    joined = numbered.join(starts, (F.col("place") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc.*", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """All columns of docs with size, text_crc32, law, shard, slot, grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.withColumn("size", (F.octet_length(body) + 1).cast("long")).withColumn("text_crc32", F.crc32(body.cast("binary")))
    placed = assign_shards(sized, key, shards, shards + 1).withColumn("law", F.lit("key"))
    return number_slots(placed, key, ["size", "text_crc32"], docs.select(key).count())
