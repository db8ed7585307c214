"""Quality by perplexity: an interpolated modified Kneser-Ney byte n-gram model.

Training text is what labels trust, outside a held-out fold; every such document is
counted.  Counts, continuation counts, discounts, context weights and probabilities
are tables keyed by (language, order, bytes), built by grouped counts and joins on the
key, so the model is sharded however large it grows.

Scoring goes in blocks of text of one language, which are written once.  A block lists
its distinct n-grams and asks the shard of each for probability and context weight (a
count join by shard that ships an n-gram once a block); the answers meet the block's
text, and every byte of every document is scored.  Shards grow in number with the model;
each is copied once for `PART_BYTES` of text (more where the model is large, so that
copies stay a tenth of the text), so neither rows nor tasks grow with the input's square.

A document's bits for each byte, shrunk towards its language's mean by `PRIOR` bytes so
that a short text is not judged by chance, give its perplexity.  A document is kept up
to the `QUANTILE` of its language's held-out trusted documents.

Defined results
    null or empty text            0 bytes, the language's mean, kept
    null language                 judged by all trusted text together, with its own limit
    language without trusted text: not judged, perplexity null, kept
    ids                           whole numbers, or TypeError
    no held-out trusted document  threshold null, kept
    repeated rows                 each gets its row
    repeated labels               trusted if any row says so
    empty table                   no rows
    extra columns                 ignored
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.llm.common import crc32_of, cut

ORDER = 4
BLOCK_BYTES = 3 << 20
#: N-grams of a shard of the model, and what one takes; text that asks one copy of a shard.
SHARD_GRAMS, GRAM_BYTES, PART_BYTES = 1_000_000, 24, 64 << 20
PRIOR = 300
QUANTILE = 0.99
#: Trusted ids up to which their table is broadcast to pick training text.
BROADCAST_IDS = 2_000_000
PRIME = 2147483647
MODEL = "key long, p double, gamma double"


def _key(lang: int, order: int, grams: np.ndarray) -> np.ndarray:
    return grams | (lang << 48 | order << 40)


def compose(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[dict[str, np.ndarray]], np.ndarray]:
    """Numbers the n-grams of texts laid end to end (text i at starts[i]:starts[i + 1]).

    Gives the number of the full-order n-gram that ends at each place of the padded
    bytes, for each order 0 to ORDER its table (grams packed; prefix and suffix numbers
    in the order below), and which places are text.  A gram is numbered from its prefix
    and its last byte through dense tables, so no search or sort over places is needed.
    """
    pad = ORDER - 1
    lengths = np.diff(starts)
    padded = np.zeros(len(text) + pad * len(lengths), np.uint8)
    real = np.ones(len(padded), bool)
    blanks = (starts[:-1] + np.arange(len(lengths)) * pad)[:, None] + np.arange(pad)
    real[blanks.ravel()] = False
    padded[real] = text
    codes = np.full(256, -1, np.int32)
    used = np.unique(np.append(padded, np.uint8(0)))
    codes[used] = np.arange(len(used))
    c, a = codes[padded], len(used)
    tables = [{"gram": np.zeros(1, np.int64), "prefix": np.zeros(1, np.int32), "suffix": np.zeros(1, np.int32)}]
    below = np.zeros(len(padded), np.int32)  # numbers of the order below, by last place
    for _ in range(ORDER):
        slot = np.empty_like(below)
        slot[0], slot[1:] = 0, below[:-1]
        slot *= np.int32(a)
        slot += c
        there = np.zeros(len(tables[-1]["gram"]) * a, bool)
        there[slot] = True
        slots = np.flatnonzero(there)
        number = np.zeros(len(there), np.int32)
        number[slots] = np.arange(len(slots), dtype=np.int32)
        ids = number[slot]
        prefix = (slots // a).astype(np.int32)
        suffix = np.zeros(len(slots), np.int32)
        suffix[ids] = below
        tables.append({"gram": tables[-1]["gram"][prefix] << 8 | used[slots % a], "prefix": prefix, "suffix": suffix})
        below = ids
    return below, tables, real


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], list[bytes]]]:
    """(language, ids, texts) in blocks of about BLOCK_BYTES of one language; the
    columns are id, lang (number), text."""
    held: dict[int, tuple[list, list, list]] = {}
    for b in batches:
        for i, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            raw = b"" if t is None else t.encode()
            ids, texts, size = held.setdefault(lang, ([], [], [0]))
            ids.append(i)
            texts.append(raw)
            size[0] += len(raw) + 64
            if size[0] > BLOCK_BYTES:
                yield lang, ids, texts
                del held[lang]
    for lang, (ids, texts, _) in held.items():
        yield lang, ids, texts


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def count(docs: DataFrame) -> DataFrame:
    """key, a: counts of full-order n-grams of (id, lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, texts in _runs(batches):
            text, starts = _join(texts)
            if not len(text):
                continue
            ids, tables, real = compose(text, starts)
            n = np.bincount(ids[real], minlength=len(tables[ORDER]["gram"]))
            seen = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(_key(lang, ORDER, tables[ORDER]["gram"][seen])), pa.array(n[seen])], names=["key", "a"])

    return docs.mapInArrow(run, "key long, a long").groupBy("key").agg(F.sum("a").alias("a"))


def _lang(key: Column) -> Column:
    return F.shiftright(key, 48)


def _part(key: Column, order: int, grams: Column) -> Column:
    return _lang(key) * F.lit(1 << 48) + F.lit(order << 40) + grams


def _suffix(key: Column, order: int) -> Column:
    return _part(key, order - 1, key.bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)))


def _prefix(key: Column, order: int) -> Column:
    return _part(key, order - 1, F.shiftright(key.bitwiseAND(F.lit((1 << 40) - 1)), 8))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; set values where any is 0."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def build(counts: DataFrame) -> DataFrame:
    """key, p, gamma: the interpolated probability of each n-gram's last byte, and the
    weight of the shorter context behind it where the n-gram is a context."""
    spark = counts.sparkSession
    tables = {ORDER: cut(counts, "counts")}
    for order in range(ORDER - 1, 0, -1):
        shorter = tables[order + 1].select(_suffix(F.col("key"), order + 1).alias("key"))
        tables[order] = cut(shorter.groupBy("key").agg(F.count("*").alias("a")), "counts")
    rows = []
    for order, t in tables.items():
        n = [F.count_if(F.col("a") == i).alias(f"n{i}") for i in range(1, 5)]
        rows += [(r["lang"], order, *discounts(*r[1:])) for r in t.groupBy(_lang(F.col("key")).alias("lang")).agg(*n).collect()]
    known = spark.createDataFrame(rows, "dl long, do int, d1 double, d2 double, d3 double")  # a row for each language and order
    parts, lower = [], None
    for order in range(1, ORDER + 1):
        own = F.broadcast(known.where(F.col("do") == order).drop("do"))
        t = tables[order].join(own, _lang(F.col("key")) == F.col("dl")).withColumn("context", _prefix(F.col("key"), order))
        d = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.select("key", "a", "context", d.alias("d"))
        contexts = t.groupBy("context").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("gamma")).withColumnRenamed("context", "c")
        t = t.join(contexts, F.col("context") == F.col("c"))
        if lower is None:
            below = F.lit(1 / 256)
        else:
            t = t.join(lower.select(F.col("key").alias("sk"), F.col("p").alias("sp")), _suffix(F.col("key"), order) == F.col("sk"))
            below = F.col("sp")
        lower = cut(t.select("key", ((F.col("a") - F.col("d")) / F.col("total") + F.col("gamma") * below).alias("p")), "probabilities")
        parts += [lower.select("key", "p", F.lit(None).cast("double").alias("gamma")), contexts.select(F.col("c").alias("key"), F.lit(None).cast("double").alias("p"), "gamma")]
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return model.groupBy("key").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma"))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return key % PRIME % shards


def score(docs: DataFrame, model: DataFrame, shards: int, parts: int, top: int) -> DataFrame:
    """id, lang, n (bytes), bits of every row of docs (id, lang number, text); languages
    above `top` are scored as `top`."""

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6).compress  # written and shuffled once each
        task = TaskContext.get().partitionId()
        for made, (lang, ids, texts) in enumerate(_runs(batches)):
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | made], pa.int64()), pa.array([-1], pa.int32()), pa.array([lang], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([squeeze(b"".join(texts))], pa.binary())],
                names=["block", "cell", "lang", "ids", "sizes", "blob"],
            )

    def read(blob: bytes, sizes: list[int], lang: int) -> tuple[np.ndarray, list[dict], np.ndarray, np.ndarray, np.ndarray]:
        """A block's n-grams: keys, and what compose() gives; starts of its texts."""
        text, starts = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), np.cumsum([0, *sizes])
        number, tables, real = compose(text, starts)
        return np.concatenate([_key(min(lang, top), o, t["gram"]) for o, t in enumerate(tables)]), tables, number, real, starts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for block, lang, sizes, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not sum(sizes):
                    continue
                keys = read(blob, sizes, lang)[0]
                shard = _shard(keys, shards)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                part = (block ^ block >> 32) % parts
                rows = [(part * shards + s, squeeze(keys[order[edges[s] : edges[s + 1]]].tobytes())) for s in range(shards) if edges[s] < edges[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "cell", "blob"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        key = held.column("key").to_numpy()
        order = np.argsort(key)
        key = key[order]
        values = [held.column(c).to_numpy(zero_copy_only=False).astype(np.float32)[order] for c in ("p", "gamma")]
        blobs = []
        for blob in asked.column("blob").to_pylist():
            want = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            hit = key[at] == want if len(key) else np.zeros(len(want), bool)
            got = [np.where(hit, v[at], np.float32("nan")) if len(key) else np.full(len(want), np.nan, np.float32) for v in values]
            short = np.concatenate(got).view(np.uint32) & np.uint32(0xFFFFFF80)  # 16 bits after the leading one, as much as scores need
            blobs.append(zstandard.ZstdCompressor(level=3).compress(short.tobytes()))
        none = pa.nulls(len(blobs))
        return pa.table([asked.column("block"), asked.column("cell"), none.cast(pa.int32()), none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names=["block", "cell", "lang", "ids", "sizes", "blob"])

    def finish(table: pa.Table) -> pa.Table:
        rows = {c % shards if c >= 0 else -1: i for i, c in enumerate(table.column("cell").to_pylist())}
        own = table.slice(rows[-1], 1)
        lang, ids, sizes, blob = (own.column(c)[0].as_py() for c in ("lang", "ids", "sizes", "blob"))
        bits = np.zeros(len(ids))
        if sum(sizes):
            keys, tables, number, real, starts = read(blob, sizes, lang)
            shard = _shard(keys, shards)
            order = np.argsort(shard, kind="stable")
            got = [np.frombuffer(zstandard.ZstdDecompressor().decompress(table.column("blob")[rows[s]].as_py()), np.float32) for s in np.unique(shard).tolist()]
            p, gamma = np.empty(len(keys), np.float64), np.empty(len(keys), np.float64)
            p[order] = np.concatenate([g[: len(g) // 2] for g in got])
            gamma[order] = np.concatenate([g[len(g) // 2 :] for g in got])
            base, value = 0, np.full(1, 1 / 256)
            for t, below in zip(tables[1:], tables, strict=False):
                width = len(below["gram"])
                weight = gamma[base : base + width][t["prefix"]]
                seen = p[base + width : base + width + len(t["gram"])]
                value = np.where(np.isnan(seen), np.where(np.isnan(weight), 1.0, weight) * value[t["suffix"]], seen)
                base += width
            cost = -np.log2(value)[number[real]]
            filled = np.flatnonzero(np.array(sizes) > 0)
            bits[filled] = np.add.reduceat(cost, starts[filled])
        return pa.table({"id": pa.array(ids, pa.int64()), "lang": pa.array([lang] * len(ids), pa.int32()), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.float64())})

    # Blocks are written once: what asks and what finishes reads the same ones, also when
    # a task runs again.
    layout = "block long, cell int, lang int, ids array<long>, sizes array<long>, blob binary"
    blocks = cut(docs.mapInArrow(hand_on, layout), "blocks")
    asked = blocks.select("block", "lang", "sizes", "blob").mapInArrow(ask, "block long, cell int, blob binary")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = model.select("*", copies.alias("part")).select((F.col("part") * shards + F.col("key") % PRIME % shards).cast("int").alias("cell"), "key", "p", "gamma")
    answers = asked.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(answer, layout)
    return blocks.unionByName(answers).groupBy("block").applyInArrow(finish, "id long, lang int, n long, bits double")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", folds: int = 5, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep of every document."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError("ids must be whole numbers")
    trusted = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("trusted_id")).where(F.col("trusted_id").isNotNull()).distinct()
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    ids = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    fold = F.pmod(crc32_of(F.col("id")), F.lit(folds))
    sound = slim.select("id", "lang").join(ids, F.col("id") == F.col("trusted_id"), "left_semi").where(F.col("lang").isNotNull())
    names = sorted(r["lang"] for r in sound.select("lang").distinct().collect())
    if len(names) > 30_000:
        raise ValueError("more languages than keys have room for")
    pool = len(names)  # all trusted text together, for texts without a language; the one after it marks held-out texts that are scored under it too
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, number int")  # a row for each language
    known_lang = F.when(F.col("lang").isNull(), F.lit(pool)).otherwise(F.coalesce("number", F.lit(-1)))
    numbered = slim.join(F.broadcast(numbers), F.col("lang") == F.col("name"), "left").select("id", known_lang.alias("lang"), "text")
    training = numbered.where((F.col("lang") >= 0) & (fold != 0)).join(ids, F.col("id") == F.col("trusted_id"), "left_semi")
    probes = numbered.where((F.col("lang") >= 0) & (fold == 0)).join(ids, F.col("id") == F.col("trusted_id"), "left_semi").withColumn("lang", F.lit(pool + 1))
    nameless = not slim.where(F.col("lang").isNull()).isEmpty()
    if nameless:
        training = training.where(F.col("lang") < pool).unionByName(training.withColumn("lang", F.lit(pool)))
    model = cut(build(count(training)), "model")
    volume, grams = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0, model.count()
    shards = max(1, -(-grams // SHARD_GRAMS))
    parts = max(1, volume // max(PART_BYTES, 10 * GRAM_BYTES * grams))
    due = numbered.where(F.col("lang") >= 0)
    known = score(due.unionByName(probes) if nameless else due, model, shards, parts, pool)
    scored = cut(known, "scores")

    own = scored.where(F.col("lang") <= pool)
    held = scored.where((fold == 0) & (F.col("lang") != pool)).join(trusted, F.col("id") == F.col("trusted_id"), "left_semi").withColumn("lang", F.least("lang", F.lit(pool)))
    means = held.groupBy("lang").agg(F.try_divide(F.sum("bits"), F.sum("n")).alias("mean")).withColumnRenamed("lang", "m")
    rate = (F.col("bits") + F.col("mean") * PRIOR) / (F.col("n") + PRIOR)
    limits = held.join(means, F.col("lang") == F.col("m")).groupBy("lang").agg(F.percentile_approx(rate, quantile, 10000).alias("limit"), F.first("mean").alias("mean"))
    limits = limits.withColumnRenamed("lang", "m")  # a row for each language
    joined = own.join(F.broadcast(limits), F.col("lang") == F.col("m"), "left").withColumn("rate", F.coalesce(rate, F.try_divide("bits", "n")))
    named = joined.join(F.broadcast(numbers), F.col("lang") == F.col("number"), "left")
    judged = named.select("id", F.col("name").alias("lang"), "n", F.pow(F.lit(2.0), "rate").alias("perplexity"), F.pow(F.lit(2.0), "limit").alias("threshold"))
    unknown = slim.join(F.broadcast(numbers), F.col("lang") == F.col("name"), "left_anti").where(F.col("lang").isNotNull())
    other = unknown.select("id", "lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    blank = other.select("id", "lang", "n", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.unionByName(blank).select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_bytes"), "perplexity", "threshold", keep.alias("keep"))
