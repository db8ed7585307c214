"""Benchmark decontamination: a broadcast hash set of normalised item n-grams,
scanned over training token windows, with every hit verified word by word.

Native: DataFrame expressions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.
A window is `n` consecutive item words; an item of fewer words, but not none, is
one window of its own length.  A document word inside an occurrence is hit.

Defined results
    null or wordless text      no words, no hits
    wordless or null item      no windows
    null item_id               its windows hit, but it is not listed as an item
    repeated items             listed once
    repeated document rows     each gets its own row
    empty benchmark            no hits; empty documents: no rows
    clashing column names      inputs are renamed inside; outputs replace them
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import ascii_lower, cut

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which the hash set is broadcast with its words (about 300 bytes each).
#: Beyond it only the hashes are (about 50 bytes each), in as many passes as keep one
#: broadcast within BROADCAST_KEYS; the windows that they find meet the words in a
#: shuffle join, so what is shuffled grows with hits and not with the text.
BROADCAST_WINDOWS = 500_000
BROADCAST_KEYS = 3_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def item_windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """One row for each different window: key (hash), words, ids of its items."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - n + 1, F.lit(1))
    spans = F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, n))
    rows = words.select("item", F.explode(spans).alias("words"))
    return rows.groupBy("words").agg(F.array_compact(F.collect_set("item")).alias("items")).select(F.xxhash64("words").alias("key"), "words", "items")


def find_hits(docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """One row for each row of docs: doc (struct of the carried columns), n_words,
    spans (struct(pos, len) of occurrences, 1-based word positions, in order),
    items (sorted ids of the items that occur)."""
    windows = item_windows(items, item_id, item_text, n)
    sizes = windows.groupBy(F.size("words").alias("len")).count().collect()  # at most n rows
    lengths = sorted(r["len"] for r in sizes)
    total = sum(r["count"] for r in sizes)
    known = windows.select(F.col("key").alias("item_key"), F.col("words").alias("item_words"), "items")

    # A row's number follows from its partition and place, so a task that runs again
    # gives the same numbers; it only groups a row's own hits.
    doc = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry])
    rows = docs.select(doc.alias("doc"), words_of(F.col(text)).alias("w"), F.monotonically_increasing_id().alias("row"))
    if total > BROADCAST_WINDOWS:
        rows = cut(rows, "numbered")  # read more than once below, with the same numbers

    # Position 0 stands for the row itself, so that rows without hits stay.  All from
    # here to the join is one stage of generated code: no array is built for a window.
    last = F.greatest(F.size("w") - min(lengths, default=n) + 1, F.lit(0))
    probes = rows.select("doc", "w", "row", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    lens = F.when(F.col("pos") == 0, F.array(F.lit(0))).otherwise(F.lit(lengths or [n]))
    probes = probes.select("*", F.explode(lens).alias("len")) if len(lengths) > 1 else probes.withColumn("len", F.lit(max(lengths, default=n)))
    fits = (F.col("pos") > 0) & (F.col("pos") + F.col("len") - 1 <= F.size("w"))
    window = F.slice("w", F.greatest(F.col("pos"), F.lit(1)), F.col("len"))
    own = F.col("pos") == 0
    if total <= BROADCAST_WINDOWS:
        # The hash finds, the words confirm.  when() keeps the words out of the join's key,
        # which stays one long.
        confirmed = F.when(F.col("items").isNotNull(), window == F.col("item_words"))
        found = probes.join(F.broadcast(known), (F.xxhash64(window) == F.col("item_key")) & fits & confirmed, "left")
    else:
        found = rows.select("row", "doc", "w", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("array<string>").alias("items"))
        passes = -(-total // BROADCAST_KEYS)
        for p in range(passes):
            keys = known.where(F.pmod("item_key", F.lit(passes)) == p).select(F.col("item_key").alias("known_key")).distinct()
            near = probes.where(fits).join(F.broadcast(keys), F.xxhash64(window) == F.col("known_key"), "left_semi")
            near = near.select("row", "pos", "len", window.alias("words"), F.xxhash64(window).alias("key"))
            hits = near.join(known, (F.col("key") == F.col("item_key")) & (F.col("words") == F.col("item_words")))
            found = found.unionByName(hits.select("row", F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"), F.lit(None).cast("array<string>").alias("w"), "pos", "len", "items"))
    return (
        found.where(own | F.col("items").isNotNull())
        .groupBy("row")
        .agg(
            F.first(F.when(own, F.col("doc")), ignorenulls=True).alias("doc"),
            F.max(F.when(own, F.size("w"))).alias("n_words"),
            F.array_sort(F.array_distinct(F.collect_list(F.when(~own, F.struct("pos", "len"))))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .drop("row")
    )


def covered(spans: Column) -> Column:
    """Number of words inside the union of spans, which are in order."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        last = s["pos"] + s["len"] - 1
        return F.struct(
            F.greatest(acc["end"], last).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), last - F.greatest(acc["end"], s["pos"] - 1))).alias("n"),
        )

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    hits = find_hits(docs, items, [doc_id], text, item_id, item_text, n)
    n_hit = covered(F.col("spans")).cast("long")
    return hits.select(
        F.col(f"doc.`{doc_id}`").alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """The rows of docs without a hit, all columns kept."""
    hits = find_hits(docs, items, docs.columns, text, item_id, item_text, n)
    return hits.where(F.size("spans") == 0).select("doc.*")


def cut_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """All rows of docs; hit words leave the text, each with the separators after it."""
    hits = find_hits(docs, items, docs.columns, text, item_id, item_text, n)
    body = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    word, gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z]", r"(?![A-Z])[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(body, F.lit(f"((?:{word})+(?:{gap})*)"), 1)
    head = F.regexp_extract(body, f"^((?:{gap})*)", 1)
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))
    kept = F.filter(F.col("pieces"), lambda _, i: ~F.array_contains(F.col("hit"), i + 1))
    cleaned = F.when(F.size("spans") == 0, F.col(f"doc.`{text}`")).otherwise(F.concat(F.col("head"), F.array_join(kept, "")))
    split = hits.select("doc", "spans", pieces.alias("pieces"), head.alias("head"), hit.alias("hit")).withColumn("cleaned", cleaned)
    return split.select(*[F.col("cleaned").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
