"""Substring dedup by super-k-mer partitioning.

Words are `[^\\x20\\x09-\\x0D]+`; a window is `k` consecutive words of one document.  A
word goes if a window that covers it holds a word sequence that also starts earlier
(smaller id, or same document, earlier start); windows are judged on the input.

1. Each map task takes its documents in runs of `RUN_BYTES`.  Windows that are not the
   first of their sequence within the run are settled there.  The rest are cut into
   super-k-mers: consecutive windows with the same minimiser (the smallest hash among
   the window's m-word groups) travel as one string to the minimiser's bucket, packed
   with those of the run that go the same way.  So a passage that a third of all
   documents share reaches its bucket once a run, not once a document.  Windows of a
   minimiser that is in very many windows (near copies that differ elsewhere, say) go by
   the smallest hash of their longer groups instead, to many buckets.  Which minimisers
   are so is estimated on one document in `SAMPLE_IN`: it only decides the way, which is
   the same for equal windows whatever the estimate.
2. A bucket sorts its windows by hash, confirms equal neighbours word by word, and
   reports those that are not the first.  Buckets stream by; one above `HOLD_BYTES` is
   settled in pieces, and the windows that are first in their piece go on by a hash of
   all their words, to further rounds, until every bucket is held whole.  A piece is of
   at least two parts and hands on one window of each sequence, so rounds end.
3. Reports meet the documents in a join on the document, and words are cut.

Defined results
    null or short text     no windows; null has no words, and nothing is removed
    null id                after all others
    repeated rows          same id and text: one document; each row gets its result
    same id, other text    two documents, in order of a hash of the text
    very long text         a run of its own; no prefix is taken
    empty table            no rows
    extra columns          ignored
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.llm.common import cut as write_once

WINDOW = 20
GROUP = 3
RUN_BYTES = 4 << 20
#: Bytes of text for each bucket; its super-k-mers are about three times as long.
BUCKET_BYTES = 3 << 20
#: Unpacked bytes of a bucket that are settled at once; ways from a bucket above it.
HOLD_BYTES, WAYS = 32 << 20, 64
#: Windows from which a minimiser is split (more where the list would exceed HOT_MOST),
#: the share of documents it is estimated on, and words that the longer groups lack.
HOT_WINDOWS, HOT_MOST, SAMPLE_IN, SHORTER = 200_000, 1_000_000, 32, 4
LAST = (1 << 63) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> number, in order of appearance, with the words' hashes beside it."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return ids, np.array(self.hashes, np.uint64)[ids]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place, by doubling; the last k - 1 are void."""
    out, have, part, width = None, 0, _mix(h), 1
    left = k
    while left:
        if left & 1:
            moved = np.roll(part, -have)
            out = moved if out is None else out * MIX + moved
            have += width
        left >>= 1
        if left:
            part = _mix(part * MIX + np.roll(part, -width))
            width *= 2
    return _mix(out)


def minimisers(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """The smallest hash of the m-word groups in the k words from each place."""
    low, span, width = window_hashes(h, m), k - m + 1, 1
    while width * 2 <= span:
        low = np.minimum(low, np.roll(low, -width))
        width *= 2
    return np.minimum(low, np.roll(low, -(span - width)))


def firsts(ids: np.ndarray, hashes: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """For each window (places, in document order): the first place of its sequence."""
    if not len(places):
        return places
    key = hashes[places]
    order = np.argsort(key, kind="stable")
    p, key = places[order], key[order]
    same = np.zeros(len(p), bool)
    same[1:] = key[1:] == key[:-1]
    near = np.flatnonzero(same)
    true = np.ones(len(near), bool)
    for j in range(k):
        true &= ids[p[near] + j] == ids[p[near - 1] + j]
    begin = np.flatnonzero(~same)
    first = p[begin][np.cumsum(~same) - 1]
    if not true.all():  # sequences that share a hash: settle their groups one by one
        group = np.cumsum(~same) - 1
        for g in np.unique(group[near[~true]]):
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(group == g):
                first[i] = seen.setdefault(ids[p[i] : p[i] + k].tobytes(), p[i])
    out = np.empty_like(first)
    out[order] = first
    return out


def ways(h: np.ndarray, sent: np.ndarray, k: int, m: int, hot: np.ndarray) -> np.ndarray:
    """What a window's bucket follows from: its minimiser, or, where that is hot, the
    smallest hash of its longer groups.  Equal windows have equal ways."""
    low = minimisers(h, k, m)[sent]
    if not len(hot):
        return low
    is_hot = hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low
    if is_hot.any():
        low[is_hot] = _mix(minimisers(h, k, max(m, k - SHORTER))[sent[is_hot]] ^ MIX)
    return low


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] items, and so on."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def _runs(places: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of stretches of consecutive places; `new` marks a forced start."""
    if not len(places):
        return places, places
    start = new.copy()
    start[0] = True
    start[1:] |= places[1:] != places[:-1] + 1
    at = np.flatnonzero(start)
    return places[at], places[np.append(at[1:], len(places)) - 1]


def split_run(docs: list[tuple[int, int, bytes]], buckets: int, k: int, m: int, hot: np.ndarray = np.zeros(0, np.uint64)) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """docs: (id, text hash, text).  Gives packed super-k-mers by bucket, and the settled
    windows that are not first: rows of (id, text hash, first start, last start)."""
    docs = sorted(docs, key=lambda d: d[:2])
    split = [d[2].split() for d in docs]
    counts = np.array([len(w) for w in split])
    begin = np.cumsum(counts) - counts
    words = [w for ws in split for w in ws]
    none = np.zeros((0, 4), np.int64)
    if not len(words):
        return [], none
    ids, h = Words().encode(words)
    windows = np.maximum(counts - k + 1, 0)
    places = _spread(begin, windows)
    if not len(places):
        return [], none
    first = firsts(ids, window_hashes(h, k), places, k)
    owner = np.repeat(np.arange(len(docs)), windows)
    # A repeated row is the same document as the one before it.
    same = np.array([i > 0 and docs[i][:2] == docs[i - 1][:2] for i in range(len(docs))])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(docs))))
    doc_of = np.repeat(np.arange(len(docs)), counts)
    itself = (lead[doc_of[first]] == lead[owner]) & (first - begin[doc_of[first]] == places - begin[owner])
    later = ~itself
    a, b = _runs(places[later], np.diff(owner[later], prepend=-1) != 0)
    who = doc_of[a]
    settled = np.stack([np.array([docs[i][0] for i in who], np.int64), np.array([docs[i][1] for i in who], np.int64), a - begin[who], b - begin[who]], 1) if len(a) else none

    sent = places[first == places]
    low = ways(h, sent, k, m, hot)
    new = (np.diff(low, prepend=low[:1]) != 0) | (np.diff(doc_of[sent], prepend=-1) != 0)
    a, b = _runs(sent, new)
    text = b" ".join(words)
    offset = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    offset = np.concatenate([[0], offset])
    bucket = (_mix(low[np.searchsorted(sent, a)]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    a, b, bucket = a[order], b[order], bucket[order]
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    who = doc_of[a]
    fields = np.stack([np.array([d[0] for d in docs], np.int64)[who], np.array([d[1] for d in docs], np.int64)[who], a - begin[who], b - a + k], 1)
    low_at, high_at = offset[a].tolist(), (offset[b + k] - 1).tolist()
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = []
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        body = b" ".join([text[i:j] for i, j in zip(low_at[s:e], high_at[s:e], strict=True)])
        out.append((int(bucket[s]), squeeze(struct.pack("<q", e - s) + fields[s:e].tobytes() + body)))
    return out, settled


def judge_bucket(raws: list[bytes], k: int, level: int | None = None) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Windows of a bucket that are not first: rows as split_run() settles.  With a
    level, also the first ones, packed by the way (0 to WAYS - 1) of their words."""
    fields, words = [], []
    for raw in raws:
        n = struct.unpack("<q", raw[:8])[0]
        fields.append(np.frombuffer(raw[8 : 8 + 32 * n], np.int64).reshape(n, 4))
        words += raw[8 + 32 * n :].split()
    f = np.concatenate(fields)
    known = Words()
    ids, h = known.encode(words)
    del words
    order = np.lexsort((f[:, 2], f[:, 1], f[:, 0]))
    began = np.cumsum(f[:, 3]) - f[:, 3]
    take = _spread(began[order], f[order, 3])
    ids, h, f = ids[take], h[take], f[order]
    began = np.cumsum(f[:, 3]) - f[:, 3]
    windows = f[:, 3] - k + 1
    places = _spread(began, windows)
    whole = window_hashes(h, k)
    first = firsts(ids, whole, places, k)
    owner = np.repeat(np.arange(len(f)), windows)
    of = np.repeat(np.arange(len(f)), f[:, 3])
    lead = of[first]
    itself = (f[lead, 0] == f[owner, 0]) & (f[lead, 1] == f[owner, 1]) & (f[lead, 2] + first - began[lead] == f[owner, 2] + places - began[owner])
    later = ~itself
    a, b = _runs(places[later], np.diff(owner[later], prepend=-1) != 0)
    who = of[a]
    done = np.stack([f[who, 0], f[who, 1], f[who, 2] + a - began[who], f[who, 2] + b - began[who]], 1)
    if level is None:
        return done, []
    lone = first == places
    at, who = places[lone], owner[lone]
    way = (_mix(whole[at] ^ np.uint64(level)) % np.uint64(WAYS)).astype(np.int64)
    text, squeeze = list(known), zstandard.ZstdCompressor(level=1).compress
    packed = []
    for w in np.unique(way).tolist():
        own = np.flatnonzero(way == w)
        rows = np.stack([f[who[own], 0], f[who[own], 1], f[who[own], 2] + at[own] - began[who[own]], np.full(len(own), k)], 1)
        body = b" ".join(text[i] for i in ids[at[own][:, None] + np.arange(k)].ravel().tolist())
        packed.append((w, squeeze(struct.pack("<q", len(own)) + rows.tobytes() + body)))
    return done, packed


def judge_stream(batches: Iterator[pa.RecordBatch], k: int, level: int, hold: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob) in order of bucket: reports, and what buckets of more than
    `hold` bytes hand on."""

    def rows(done: np.ndarray, packed: list[tuple[int, bytes]]) -> pa.RecordBatch:
        gap = [None] * len(packed)
        numbers = [pa.array([*done[:, i].tolist(), *gap], pa.int64()) for i in range(4)]
        on = [[*[None] * len(done), *column] for column in ([(bucket * WAYS + w) & LAST for w, _ in packed], [blob for _, blob in packed])]
        return pa.RecordBatch.from_arrays([*numbers, pa.array(on[0], pa.int64()), pa.array(on[1], pa.binary())], schema=REPORT)

    bucket, held, size, overfull = None, [], 0, False
    for batch in batches:
        for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(blob)
            if struct.unpack("<q", raw[:8])[0] < 0:  # settled within its run
                yield rows(np.frombuffer(raw[8:], np.int64).reshape(-1, 4), [])
                continue
            if own != bucket or (len(held) > 1 and size + len(raw) > hold):
                overfull = overfull or own == bucket
                if held:
                    yield rows(*judge_bucket(held, k, level if overfull else None))
                overfull = overfull and own == bucket
                bucket, held, size = own, [], 0
            held.append(raw)
            size += len(raw)
    if held:
        yield rows(*judge_bucket(held, k, level if overfull else None))


REPORT = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])


def even_keys(parts: int) -> np.ndarray:
    """For each of so many shuffle partitions a number that Spark's hash sends there, so
    that buckets dealt in turn fill partitions evenly.  (Were the hash another one, only
    the evenness would suffer.)"""

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return x << np.uint32(r) | x >> np.uint32(32 - r)

    def blend(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        h = h ^ turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        return turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)

    key = np.arange(max(1000, 40 * parts), dtype=np.uint32)  # Murmur3 of a long with seed 42
    h = blend(blend(np.full(len(key), 42, np.uint32), key), np.zeros(len(key), np.uint32)) ^ np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    part = ((h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64)) % parts
    out = np.arange(parts, dtype=np.int64)
    out[part[::-1]] = key[::-1]
    return out


def hot_minimisers(slim: DataFrame, volume: int, k: int, m: int) -> np.ndarray:
    """Minimisers of about HOT_WINDOWS windows or more, in order: at most about HOT_MOST."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            while texts:
                run, held = [], 0
                while texts and (not run or held < RUN_BYTES):
                    run.append(texts.pop().encode().split())
                    held += 8 * len(run[-1])
                counts = np.array([len(w) for w in run])
                places = _spread(np.cumsum(counts) - counts, np.maximum(counts - k + 1, 0))
                if len(places):
                    low, n = np.unique(minimisers(Words().encode([w for ws in run for w in ws])[1], k, m)[places], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(n, pa.int64())], names=["low", "n"])

    least = max(HOT_WINDOWS, volume // (6 * HOT_MOST)) // SAMPLE_IN
    some = slim.where(F.pmod(F.xxhash64("id", "hash"), F.lit(SAMPLE_IN)) == 0).select("text")
    found = some.mapInArrow(tally, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, 1))
    return np.sort(np.array([r["low"] for r in found.select("low").collect()], np.int64).view(np.uint64))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = GROUP) -> DataFrame:
    """id, hash (of the text), spans: for each document with windows that are not first,
    their starts as struct(first, last), counted in words from 0."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError("ids must be whole numbers")
    slim = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id), F.lit(LAST)).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    volume = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(64, volume // BUCKET_BYTES)
    spark = docs.sparkSession
    ways_to = even_keys(int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast((hot_minimisers(slim, volume, k, m), ways_to))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(run: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            hot, keys = shared.value
            packed, settled = split_run(run, buckets, k, m, hot)
            if len(settled):
                packed.append((int(settled[0, 1]) % buckets, zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", -1) + settled.tobytes())))
            bucket = np.array([p[0] for p in packed], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(keys[bucket % len(keys)]), pa.array(bucket), pa.array([p[1] for p in packed], pa.binary())], names=["way", "bucket", "blob"])

        run, held = [], 0
        for batch in batches:
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = t.encode()
                if run and held + len(raw) > RUN_BYTES:
                    yield rows(run)
                    run, held = [], 0
                run.append((i, h, raw))
                held += len(raw)
        if run:
            yield rows(run)

    due, level, reports = slim.mapInArrow(cut, "way long, bucket long, blob binary"), 1, None
    while True:
        judge = functools.partial(judge_stream, k=k, level=level, hold=HOLD_BYTES)
        dealt = due.repartition("way").sortWithinPartitions("bucket").select("bucket", "blob")
        found = write_once(dealt.mapInArrow(judge, "id long, hash long, first long, last long, bucket long, blob binary"), "reports")
        own = found.where(F.col("blob").isNull()).select("id", "hash", "first", "last")
        reports = own if reports is None else reports.unionByName(own)
        due, level = found.where(F.col("blob").isNotNull()).select(F.col("bucket").alias("way"), "bucket", "blob"), level + 1
        if due.isEmpty():
            return reports.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def kept_words(text: str | None, spans: list[dict] | None, k: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, kept words joined by one space."""
    words = [] if text is None else text.encode().split()
    if not spans:
        return len(words), 0, b" ".join(words)
    keep, at, removed = [], 0, 0
    for s in spans:
        first, end = max(s["first"], at), s["last"] + k
        if end > at:
            keep += words[at:first]
            removed += end - first
            at = end
    keep += words[at:]
    return len(words), removed, b" ".join(keep)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = GROUP, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (text), or kept_sha256 with `digest`."""
    spans = repeats(docs, doc_id, text, k, m).withColumnsRenamed({"id": "__id", "hash": "__hash"})
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id), F.lit(LAST)).cast("long").alias("__i"), F.xxhash64(text).alias("__h"))
    joined = slim.join(spans.hint("shuffle_hash"), (F.col("__i") == F.col("__id")) & (F.col("__h") == F.col("__hash")), "left").select("doc_id", "text", "spans")
    name = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kept_words(t, s, k) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            last = [hashlib.sha256(o[2]).hexdigest() if digest else o[2].decode() for o in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array(last, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, {name} string")
