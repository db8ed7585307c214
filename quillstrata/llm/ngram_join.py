"""N-gram Jaccard self-join by universe-partition pigeonhole (as in PartEnum and
PartAlloc), with exact verification and connected components.

Two documents link when den * |x & y| >= num * |x | y| for their sets of distinct
n-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased).  Then x and y differ in at
most (|x| + |y|) (den - num) / (den + num) shingles.

1. Sets.  Documents with equal sets are one class; only classes go on, so groups of
   copies of any size cost one set.
2. Signatures.  Sizes fall into bands; a band fixes the most H by which a pair whose
   smaller set is in it may differ.  The universe of shingles is hashed into m segments,
   and each non-empty segment of a set gives the hash of its content.  With m = H + 1 + e,
   linked sets agree on more than e segments, so on a non-empty one unless both have
   more than e empty segments.  Where it costs less (small sets), half as many segments
   are used, with signatures of every content less one shingle beside: then two sets
   that miss every signature differ by two in each segment.  Sets with more than e empty
   segments also sign those.  Equal signatures come from equal segments, so signatures
   go in passes over residues of the segment number, as many as keep the signatures of
   one pass near the size of the text; what a pass shuffled goes before the next.
3. Hubs.  In each bucket of equal signatures every class is paired with one of them, so
   pairs grow with members, not with their square.  Verified pairs are contracted.
4. The rest.  Buckets whose members, the hub aside, are still of several components
   compare those pairs by parity sketches (a bound that cannot miss a link) inside the
   task.  Where at most two pairs for each member are left, the pairs leave it and are
   compared exactly, once for all buckets; else the members do, and their sets are
   compared inside a task, joining as they go, so that what leaves it is at most one
   link for each member.  Buckets above `BUCKET` members are dealt as pairs of blocks.
5. Links are contracted to components; a component's id is its smallest document id.

Shingles are compared by 64-bit hashes.  Two sets that share a 64-bit class key while
their second keys differ stop the job.

Defined results
    null text or no words    empty set, size 0, its own component
    fewer than n words       the whole sequence as one shingle
    null id                  after all others; its component is null if alone
    repeated rows            equal sets, so one component; keep_one keeps one of them
    ties                     the smallest id names the component
    very long texts          whole; sketches grow with the set
    empty table              no rows
    extra columns            ignored
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.llm.common import cut, drop_cut
from quillstrata.llm.substring import LAST, MIX, _mix, window_hashes

#: Size ratio of a band; rivals that a weak signature is taken to meet.
RATIO, CROWD = 1.2, 50.0
SKETCH_BITS = 512
#: Members, and their shingles, of a block of a large bucket.
BUCKET, BUCKET_SHINGLES = 2048, 4 << 20
#: Members that are compared with one copy of their hub's text.
HUB_BLOCK = 64
BATCH_BYTES = 4 << 20
#: Shuffled bytes of a signature, and of signatures in a pass for each byte of text.
SIGN_BYTES, PASS_SHARE = 14, 1.0


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    reach: int  # largest partner
    differ: int  # H
    segments: int
    empties: int  # e
    deletions: bool


class Bands:
    """Bands of set sizes for one threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.all: list[Band] = []
        self.least = 1
        while self.differ(self.least, self.partner(self.least)) < 1:
            self.least += 1

    def partner(self, size: int) -> int:
        return size * self.den // self.num

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def _allocate(self, low: int, high: int) -> Band:
        h = self.differ(high, self.partner(high))
        best = None
        for deletions in (False, True):
            e = 0
            while True:
                m = h + 1 + e if not deletions else -(-(h + 1 + 2 * e) // 2)
                mean = m * math.exp(-low / m) if m > 1 else 0.0
                if mean <= 1e-9 or 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(min(e, 100) + 1)) < 1e-3 or e >= 100:
                    break
                e += 1
            signatures = m + low * deletions
            cost = signatures * (1 + CROWD * math.exp(-(low / m - deletions)))
            if best is None or cost < best[0]:
                best = (cost, Band(low, high, self.partner(high), h, m, e, deletions))
        return best[1]

    def of(self, size: int) -> list[int]:
        """Bands in which a set of this size is signed."""
        if size < self.least:
            return []
        while not self.all or self.all[-1].high < size:
            low = self.all[-1].high + 1 if self.all else self.least
            self.all.append(self._allocate(low, max(low, int(low * RATIO))))
        own = next(i for i in range(len(self.all) - 1, -1, -1) if self.all[i].low <= size)
        first = own
        while first and self.all[first - 1].reach >= size:
            first -= 1
        return list(range(first, own + 1))

    def signs(self, size: int) -> int:
        """Signatures of a set of this size, its empty segments aside."""
        return sum(b.segments + size * b.deletions for b in map(self.all.__getitem__, self.of(size)))


class Hashes(dict):
    """Word -> hash; remembers up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: list[bytes], n: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    return np.unique(window_hashes(h, k)[: len(h) - k + 1])


def sketch(x: np.ndarray) -> bytes:
    """Parity of shingles by hash, in a power of two of bits: two sets differ in at
    least as many shingles as their sketches in bits."""
    bits = SKETCH_BITS
    while bits * 2 < len(x):
        bits *= 2
    at = (_mix(x) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(s: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer words (uint64) from a larger one."""
    while len(s) > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def signatures(sets: list[np.ndarray], bands: Bands, turn: int = 0, passes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for sets of hashes; of several passes, those of the
    segments whose number leaves `turn`."""
    by: dict[int, list[int]] = {}
    for i, x in enumerate(sets):
        for g in bands.of(len(x)):
            by.setdefault(g, []).append(i)
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for g, members in by.items():
        band = bands.all[g]
        m = band.segments
        seed = np.uint64((g + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = np.concatenate([sets[i] for i in members])
        who = np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        slot = who * m + (_mix(x ^ seed) % np.uint64(m)).astype(np.int64)
        filled = np.zeros(len(members) * m, bool)
        filled[slot] = True
        if passes > 1:
            due = slot % m % passes == turn
            x, slot = x[due], slot[due]
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], _mix(x[order] + seed)
        member = np.array(members, np.int64)
        salt = lambda place: seed ^ ((place % m).astype(np.uint64) * MIX)
        if len(slot):
            start = np.flatnonzero(np.diff(slot, prepend=-1))
            total = np.add.reduceat(value, start)
            used = slot[start]
            sigs.append(_mix(total ^ salt(used)))
            owners.append(member[used // m])
            if band.deletions:
                lengths = np.diff(np.append(start, len(slot)))
                less = np.repeat(total, lengths) - value
                sigs.append(_mix(less ^ salt(slot)))
                owners.append(member[slot // m])
        filled = filled.reshape(len(members), m)
        bare = np.flatnonzero(m - filled.sum(1) > band.empties)
        row, place = np.nonzero(~filled[bare])
        own = place % passes == turn
        sigs.append(_mix(salt(place[own])))
        owners.append(member[bare[row[own]]])
    return np.concatenate(sigs), np.concatenate(owners)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def row_key(doc_id: str, text: str) -> Column:
    """A digest of id and text: equal for repeated rows alone, null id and text included."""
    marked = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text), F.lit("")))
    return F.unhex(F.md5(marked.cast("binary")))


def prepare(docs: DataFrame, doc_id: str, text: str, n: int, num: int, den: int, key: Column | None = None) -> DataFrame:
    """id, size, cls and chk (keys of the set), sketch and words (packed; null where the
    set is too small to link with another), key (null unless asked for), and the bytes of
    the text and number of signatures."""
    own = F.lit(None).cast("binary") if key is None else key
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), own.alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, squeeze, bands = Hashes(), zstandard.ZstdCompressor(level=1).compress, Bands(num, den)
        least = bands.least
        for b in batches:
            size, cls, chk, drawn, packed, bulk, signs = [], [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                raw = b"" if t is None else t.encode()
                words = raw.lower().split()
                x = shingles(words, n, hashes)
                size.append(len(x))
                bulk.append(len(raw))
                signs.append(bands.signs(len(x)))
                key = xxhash.xxh3_128_intdigest(x.tobytes())
                cls.append((key >> 64) - (1 << 63) if len(x) else None)
                chk.append((key & (1 << 64) - 1) - (1 << 63) if len(x) else None)
                drawn.append(sketch(x) if len(x) >= least else None)
                packed.append(squeeze(b" ".join(words)) if len(x) >= least else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(chk, pa.int64()), pa.array(drawn, pa.binary()), pa.array(packed, pa.binary()), b.column(2), pa.array(bulk, pa.int64()), pa.array(signs, pa.int64())],
                names=["id", "size", "cls", "chk", "sketch", "words", "key", "bytes", "signs"],
            )

    return slim.mapInArrow(run, "id long, size long, cls long, chk long, sketch binary, words binary, key binary, bytes long, signs long")


def _unpack(blob: bytes, n: int, hashes: Hashes) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(blob).split(), n, hashes)


def postings(base: DataFrame, n: int, num: int, den: int, turn: int = 0, passes: int = 1) -> DataFrame:
    """sig, cls, hub of every bucket of a pass with at least two classes; the hub is the
    smallest of them.  Buckets stream by in order, so one of any size fits in memory."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, hashes = Bands(num, den), Hashes()

        def rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            sig, owner = signatures(list(held.values()), bands, turn, passes)
            cls = np.array(list(held), np.int64)[owner]
            return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls)], names=["sig", "cls"])

        held: dict[int, np.ndarray] = {}
        bulk = 0
        for b in batches:
            for cls, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if cls in held:
                    continue
                held[cls] = x = _unpack(blob, n, hashes)
                bulk += x.nbytes
                if bulk > BATCH_BYTES:
                    yield rows(held)
                    held, bulk = {}, 0
        if held:
            yield rows(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the bucket that the last batch left open: sig, hub, the last class, was the hub handed on
        sig, hub, cls, told = 0, 0, 0, True
        began = False
        for b in batches:
            s, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            if began:
                fresh = (s != sig) | (c != cls)
                s, c = np.concatenate([[sig], s[fresh]]), np.concatenate([[hub], c[fresh]])
            if len(s) < 1 + began:
                continue
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
            s, c = s[new], c[new]
            start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            count = np.diff(np.append(start, len(s)))
            wide = np.repeat(count > 1, count)
            hubs = np.repeat(c[start], count)
            open_told = count[-1] > 1 or (began and told and len(start) == 1)
            if began and told:
                wide[0] = False
            sig, hub, cls, told, began = s[-1], hubs[-1], c[-1], open_told, True
            yield pa.RecordBatch.from_arrays([pa.array(s[wide]), pa.array(c[wide]), pa.array(hubs[wide])], names=["sig", "cls", "hub"])

    signed = base.where(F.col("words").isNotNull()).select("cls", "words").mapInArrow(sign, "sig long, cls long")
    return signed.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(meet, "sig long, cls long, hub long")


def verify(pairs: DataFrame, info: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) that link.  Sizes and sketches rule out most before sets
    are fetched."""
    small = info.select("cls", "size", "sketch")
    a = small.select(F.col("cls").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    b = small.select(F.col("cls").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for r in batches:
            left, right, na, nb, sa, sb = (r.column(i).to_pylist() for i in range(6))
            keep = [may_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), bands.differ(p, q)) for x, y, p, q in zip(sa, sb, na, nb, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([r.column(0).filter(mask), r.column(1).filter(mask)], names=["a", "b"])

    likely = cut(sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(screen, "a long, b long"), "likely")
    out = cut(compare(likely, info, n, num, den), "verified")
    drop_cut(likely)
    return out


def compare(pairs: DataFrame, info: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b) whose sets link, by their words.  The words of a are sent once
    for each block of about HUB_BLOCK partners, and partners stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hub, x = Hashes(), None, None
        for r in batches:
            a, b = [], []
            for p, block, q, words in zip(*(c.to_pylist() for c in r.columns), strict=True):
                if q is None:
                    hub, x = (p, block), _unpack(words, n, hashes)
                elif (p, block) != hub:
                    raise ValueError("a block came without its hub")
                elif linked(x, _unpack(words, n, hashes), num, den):
                    a.append(p)
                    b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    members = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_BLOCK).alias("blocks"))
    dealt = pairs.join(members, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b")
    words = info.select("cls", "words")
    hubs = dealt.select("a", "block").distinct().join(words, F.col("a") == F.col("cls")).select("a", "block", F.lit(None).cast("long").alias("b"), "words")
    partners = dealt.join(words, F.col("b") == F.col("cls")).select("a", "block", "b", "words")
    rows = hubs.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long")


def may_link(x: np.ndarray, y: np.ndarray, differ: int) -> bool:
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= differ


class Forest:
    """Union-find over the members of one bucket."""

    def __init__(self, roots: np.ndarray):
        first: dict[int, int] = {}
        self.up = [first.setdefault(r, i) for i, r in enumerate(roots.tolist())]

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(j)] = self.find(i)


def likely_pairs(sizes: np.ndarray, sketches: list[np.ndarray], roots: np.ndarray, bands: Bands, sides: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each member i: the members j > i of another root that size and sketch allow
    (from the other side, where sides are given)."""
    least = min(map(len, sketches))
    s = np.stack([fold(x, least) for x in sketches])
    for i in range(len(sizes) - 1):
        j = np.arange(i + 1, len(sizes))
        n, o = sizes[i], sizes[j]
        ok = (roots[j] != roots[i]) & (np.minimum(n, o) * bands.den >= np.maximum(n, o) * bands.num)
        if sides is not None:
            ok &= sides[j] != sides[i]
        j = j[ok]
        if len(j):
            differ = (n + sizes[j]) * (bands.den - bands.num) // (bands.den + bands.num)
            j = j[np.bitwise_count(s[i] ^ s[j]).sum(1, dtype=np.int64) <= differ]
            if len(j):
                yield i, j


def rest(posts: DataFrame, roots: DataFrame, info: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links among members of a bucket that the hub did not join."""
    named = posts.where("cls != hub").join(roots, "cls", "left").join(info.select("cls", "size"), "cls").select("sig", "cls", "size", F.coalesce("root", "cls").alias("root"))
    buckets = named.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.sum("size").alias("shingles"))
    mixed = named.join(buckets.where("low != high").select("sig", "members", "shingles"), "sig")
    # Large buckets are dealt as pairs of blocks: every two members meet in one of them.
    blocks = F.ceil(F.greatest(F.col("members") / BUCKET, F.col("shingles") / BUCKET_SHINGLES)).cast("int")
    block = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, block).alias("p"), F.greatest(o, block).alias("q"), block.alias("side")))
    dealt = mixed.select("sig", "cls", "root", "size", F.explode(pairs).alias("at")).select("sig", "cls", "root", "size", "at.p", "at.q", "at.side")
    drawn = dealt.join(info.select("cls", "sketch"), "cls")

    def near(key: tuple, table: pa.Table) -> pa.Table:
        bands = Bands(num, den)
        sizes, roots = table.column("size").to_numpy(), table.column("root").to_numpy()
        side = table.column("side").to_numpy() if key[1].as_py() != key[2].as_py() else None
        found = np.zeros(len(sizes), bool)
        left, right, few = [], [], 2 * len(sizes)
        sketches = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        for i, j in likely_pairs(sizes, sketches, roots, bands, side):
            found[i] = True
            found[j] = True
            if len(left) <= few:
                left += [i] * len(j)
                right += j.tolist()
        table = table.select(["sig", "p", "q", "side", "cls", "root"])
        if len(left) <= few:  # few pairs: each is compared once, however many buckets find it
            return table.take(pa.array(left, pa.int64())).append_column("other", table.column("cls").take(pa.array(right, pa.int64())).cast(pa.int64()))
        return table.filter(pa.array(found)).append_column("other", pa.nulls(int(found.sum()), pa.int64()))

    marked = cut(drawn.groupBy("sig", "p", "q").applyInArrow(near, "sig long, p int, q int, side int, cls long, root long, other long"), "likely")
    pairs = marked.where(F.col("other").isNotNull()).select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
    held = marked.where(F.col("other").isNull()).drop("other").join(info.select("cls", "size", "sketch", "words"), "cls")

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        bands, hashes = Bands(num, den), Hashes()
        sizes, roots, cls = (table.column(c).to_numpy() for c in ("size", "root", "cls"))
        side = table.column("side").to_numpy() if key[1].as_py() != key[2].as_py() else None
        sets = [_unpack(w, n, hashes) for w in table.column("words").to_pylist()]
        sketches = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        forest, out = Forest(roots), []
        for i, js in likely_pairs(sizes, sketches, roots, bands, side):
            for j in js.tolist():
                if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], num, den):
                    forest.join(i, j)
                    out.append((cls[i], cls[j]))
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    pairs = cut(pairs, "pairs")
    found = cut(compare(pairs, info, n, num, den).unionByName(held.groupBy("sig", "p", "q").applyInArrow(settle, "a long, b long")).distinct(), "found")
    drop_cut(marked)
    drop_cut(pairs)
    return found


def components(links: DataFrame) -> DataFrame:
    """cls, root for every class in links (a, b).

    Each round points every node at its smallest neighbour and relabels the links;
    keys are hashes, so a round removes at least about half of the nodes.
    """
    labels = None
    edges = cut(links.where(F.col("a") != F.col("b")).distinct(), "links")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        hook = cut(hook, "hooks")
        x = hook.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        y = hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        after = edges.join(x, "a").join(y, "b").where(F.col("ta") != F.col("tb"))
        shrunk = cut(after.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
        drop_cut(edges)
        edges, prior = shrunk, labels
        new = hook.select(F.col("node").alias("cls"), F.col("to").alias("root"))
        if labels is not None:
            moved = labels.join(hook, labels["root"] == hook["node"], "left")
            old = moved.select("cls", F.coalesce("to", "root").alias("root"))
            new = old.unionByName(new.join(labels.select("cls"), "cls", "left_anti"))
        labels = cut(new, "labels")
        drop_cut(hook)
        if prior is not None:
            drop_cut(prior)
    drop_cut(edges)
    if labels is None:
        return links.sparkSession.createDataFrame([], "cls long, root long")
    return _settle_labels(labels)


def _settle_labels(labels: DataFrame) -> DataFrame:
    """Follows labels to their ends: a root's own root, until nothing moves."""
    while True:
        up = labels.select(F.col("cls").alias("n"), F.col("root").alias("to"))
        moved = labels.join(up, labels["root"] == up["n"], "left")
        done = cut(moved.select("cls", F.coalesce("to", "root").alias("root"), (F.coalesce("to", "root") != F.col("root")).alias("moved")), "labels")
        drop_cut(labels)
        if done.where("moved").isEmpty():
            return done.drop("moved")
        labels = done.drop("moved")


def passes_for(base: DataFrame) -> int:
    """Passes that keep the signatures of each within PASS_SHARE of the text."""
    total = base.agg(F.sum("signs"), F.sum("bytes")).first()
    return max(1, math.ceil((total[0] or 0) * SIGN_BYTES / (PASS_SHARE * max(total[1] or 0, 1 << 20))))


def _grouped(docs: DataFrame, doc_id: str, text: str, n: int, num: int, den: int, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """id, size, cls and key of every row; and of every class its root and its first
    row (id, null last, and key)."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError("ids must be whole numbers")
    base = cut(prepare(docs, doc_id, text, n, num, den, key), "sets")
    passes = passes_for(base)
    turns = [cut(postings(base, n, num, den, turn, passes), "postings") for turn in range(passes)]
    posts = turns[0]
    for t in turns[1:]:
        posts = posts.unionByName(t)
    involved = posts.select("cls").distinct()
    info = base.where(F.col("words").isNotNull()).join(involved, "cls", "left_semi")
    info = cut(info.groupBy("cls").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("words").alias("words")), "members")
    keyed = cut(base.select("id", "size", "cls", "chk", "key"), "keys")
    drop_cut(base)
    pairs = cut(posts.where("cls != hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    first = verify(pairs, info, n, num, den)
    drop_cut(pairs)
    joined = components(first)
    second = rest(posts, joined, info, n, num, den)
    roots = components(first.union(second))
    for t in (*turns, info, first, second, joined):
        drop_cut(t)

    first = F.min(F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), "key"))
    classes = keyed.where(F.col("cls").isNotNull()).groupBy("cls").agg(first.alias("least"), F.min("chk").alias("c0"), F.max("chk").alias("c1"))
    sound = F.when(F.col("c0") == F.col("c1"), F.col("least.id")).otherwise(F.raise_error(F.lit("two sets share a class key")).cast("long"))
    classes = classes.select("cls", F.struct(sound.alias("id"), F.col("least.key").alias("key")).alias("least"))
    return keyed.drop("chk"), classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (default: five words, 0.8)."""
    kind = docs.schema[doc_id].dataType
    keyed, classes = _grouped(docs, doc_id, text, n, num, den)
    named = classes.groupBy("root").agg(F.min("least.id").alias("component"))
    whole = classes.select("cls", "root").join(named, "root").select("cls", "component")
    out = keyed.select("id", "size", "cls").join(whole.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c"), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").cast(kind).alias(doc_id), F.col("size").alias("n_shingles"), F.when(component != LAST, component).cast(kind).alias("component_id")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component: that of the smallest id (null last), then the smallest
    digest of id and text.  Texts without words lose their repeated rows only."""
    key = row_key(doc_id, text)
    keyed, classes = _grouped(docs, doc_id, text, n, num, den, key)
    firsts = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("__kept"))
    names = firsts.unionByName(keyed.where(F.col("cls").isNull()).select(F.col("key").alias("__kept")).distinct())
    rows = docs.withColumn("__key", key).join(names, F.col("__key") == F.col("__kept"), "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0)]
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*others)))
    return rows.withColumn("__place", place).where("__place = 1").drop("__key", "__place")
