"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: how its share moves over training time
from 0 to 1 (piecewise linear, integral 1).  A source's cumulative demand is its
target times the integrated schedule.  Its documents lie in a fixed pseudo-random
order, repeated as often as the target needs; a document that starts at a given
cumulative size is due at the time at which the demand reaches that size, found by
inverting the integral.  The mix is the documents range-sorted by that time.

Targets share all sizes by weight, stop at `repeats` times a source's own size, and
the excess is shared again by weight among the others until none is above: the
level that solves this is read off prefix sums over sources in order of
cap / weight.

Defined results
    null text or no words     size 0, nothing taken
    null source               a source of its own, last in order
    source without words      target 0
    repeated rows             follow each other; each is taken by itself
    equal or null ids         ordered by checksum of the text
    empty table               no rows
    extra columns             ignored; `text` and the id may have any name
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Schedules as knots (time, relative weight); each integrates to 1.
SCHEDULES = {
    "flat": [(0.0, 1.0), (1.0, 1.0)],
    "warm": [(0.0, 0.5), (1.0, 1.5)],
    "cool": [(0.0, 1.5), (1.0, 0.5)],
    "peak": [(0.0, 0.5), (0.5, 1.5), (1.0, 0.5)],
}

#: Rows of one order bucket on average.
BUCKET_ROWS = 20_000


def invert_schedule(fraction: Column, knots: list[tuple[float, float]]) -> Column:
    """Time at which the integral of the schedule reaches `fraction` of its whole."""
    area, parts = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        parts.append((area, t0, t1, w0, w1))
        area += (w0 + w1) / 2 * (t1 - t0)
    out = None
    for begun, t0, t1, w0, w1 in reversed(parts):
        need = fraction * F.lit(area) - F.lit(begun)
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            t = F.lit(t0) + need / F.lit(w0)
        else:
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * need)) - F.lit(w0)) / F.lit(slope)
        out = t if out is None else F.when(fraction * F.lit(area) >= F.lit(begun + (w0 + w1) / 2 * (t1 - t0)), out).otherwise(t)
    return out


def source_targets(sizes: DataFrame, repeats: int) -> DataFrame:
    """source, source_size, weight, rank, target.  One row for each source: the
    windows here run over sources, not over documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(prior), F.lit(0))).cast("double") / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    # The first source, in order of cap / weight, that its share does not fill sets the level.
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    final = F.min(F.when(open_, F.struct((F.col("cap") / F.col("weight")).alias("r"), "rank", "level"))).over(everything)["level"]
    share = final * F.col("weight")
    target = F.when(share < F.col("cap"), share).otherwise(F.col("cap").cast("double"))
    return levels.withColumn("final", final).select("source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", repeats: int = 3, schedules: tuple[str, ...] = ("flat", "warm", "cool"), carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, position of every document, in
    order of position (time of its first use; null, and last, if never used).

    A source may hold a third of all rows, so its order is not one sorted run: rows
    are dealt to buckets of the leading digits of their order key, the buckets'
    sums give each bucket's start, and rows accumulate within their bucket.  Rows without
    an id share one order key; they are dealt by the checksum that orders them.
    With `carry`, the columns of docs come along in a struct `doc`.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    order_key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    keep = [F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc")] if carry else []
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), order_key.alias("key"), F.crc32(body.cast("binary")).alias("crc"), *keep
    )
    rows = docs.select(doc_id).count()
    digits = 1
    while 16**digits * BUCKET_ROWS < rows * 4:
        digits += 1
    blank = hashlib.md5(b"").hexdigest()  # the order key of a null id
    part = F.when(F.col("key") < blank, "0").when(F.col("key") > blank, "2").otherwise(F.concat(F.lit("1"), F.substring(F.lpad(F.lower(F.hex("crc")), 8, "0"), 1, digits)))
    sized = sized.withColumn("bucket", F.concat(F.substring("key", 1, digits), part))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.withColumnRenamed("bucket_size", "size"), repeats)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    plan = starts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumnRenamed("source", "plan_source").withColumnRenamed("bucket", "plan_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("bucket") == F.col("plan_bucket")))
    offset = F.col("start") + F.col("inside")
    whole = F.floor("target").cast("long")
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") * p - offset)) for p in range(repeats)]
    taken = passes[0]
    for p in passes[1:]:
        taken = taken + p
    due = F.when(F.col("target") > 0, F.least(F.lit(1.0), offset.cast("double") / F.col("target")))
    position = None
    for i, name in enumerate(schedules):
        t = invert_schedule(due, SCHEDULES[name])
        position = F.when(F.col("rank") % len(schedules) == i, t) if position is None else position.when(F.col("rank") % len(schedules) == i, t)
    done = placed.withColumn("taken", taken.cast("long")).withColumn("position", F.when(F.col("taken") > 0, F.round(position, 9)))
    out = done.select("doc_id", "size", "source_size", "target", "taken", "position", *(["doc"] if carry else []))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", repeats: int = 3) -> DataFrame:
    """The rows of docs as the mix uses them, in order of position: as often as their
    taken words come nearest to (0 to `repeats` times), all columns kept."""
    mixed = mix(docs, doc_id, text, source, repeats, carry=True)
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    return mixed.withColumn("__times", times).where(F.col("__times") > 0).select("doc", F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__pass")).select("doc.*")
