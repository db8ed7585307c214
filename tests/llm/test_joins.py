"""Near duplicates, repeated passages and decontamination against brute force."""

import hashlib
import re
import struct

import numpy as np
import pytest

from quillstrata.llm import decontam, ngram_join, substring
from tests.llm.conftest import SPACE, lower, make_rows


def components(rows, n, num, den):
    sets = []
    for r in rows:
        w = SPACE.findall(lower(r[1] or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    known = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], len(sets[i]), known[find(i)]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5), (1, 7, 10)])
def test_components_match_brute_force(docs, rows, n, num, den):
    got = sorted((tuple(r) for r in ngram_join.link(docs, n=n, num=num, den=den).collect()), key=repr)
    assert got == components(rows, n, num, den)


def test_join_of_empty_table(empty):
    assert ngram_join.link(empty).collect() == []


def test_keep_one_keeps_columns_and_one_of_each_group(docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in components(rows, 5, 4, 5)}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_keep_one_counts_rows(spark):
    one, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, one)] * 5 + [(1, other)] + [(2, one), (None, one)] + [(None, third)] * 3 + [(None, third + " x"), (None, other), (4, ""), (4, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect()]
    alone = [r for r in kept if r[0] is None]
    assert len(alone) == 1 and alone[0][1] in (third, third + " x")
    assert sorted((r for r in kept if r[0] is not None), key=repr) == sorted([(1, one), (1, other), (4, ""), (5, ""), (6, None)], key=repr)


def test_rest_finds_links_that_no_hub_shares(spark):
    """A chain of near copies around no common centre, in one bucket of many members."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(i, i + 3):
            w[k * 2] = f"v{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.link(docs, n=3, num=4, den=5).collect()), key=repr)
    assert got == components(rows, 3, 4, 5)


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        bands = ngram_join.Bands(num, den)
        for _ in range(150):
            size = int(rng.integers(bands.least, 400))
            x = rng.integers(0, 1 << 63, size).astype(np.uint64)
            budget = bands.differ(size, size)
            swap = int(rng.integers(0, budget // 2 + 1))
            y = np.unique(np.concatenate([x[swap:], rng.integers(0, 1 << 63, swap).astype(np.uint64)]))
            if ngram_join.linked(np.sort(x), y, num, den):
                sig, who = ngram_join.signatures([np.sort(x), y], bands)
                assert set(sig[who == 0]) & set(sig[who == 1])


def test_passes_share_out_the_signatures():
    rng = np.random.default_rng(4)
    bands = ngram_join.Bands(4, 5)
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300))).astype(np.uint64)) for _ in range(60)]
    whole = sorted(zip(*(x.tolist() for x in ngram_join.signatures(sets, bands)), strict=True))
    parts = [p for turn in range(3) for p in zip(*(x.tolist() for x in ngram_join.signatures(sets, bands, turn, 3)), strict=True)]
    assert sorted(parts) == whole
    assert len(whole) >= sum(bands.signs(len(x)) for x in sets) * 0.5


def test_buckets_stream_through_small_batches(spark, docs):
    base = ngram_join.cut(ngram_join.prepare(docs, "doc_id", "text", 1, 7, 10), "sets")
    want = sorted(tuple(r) for r in ngram_join.postings(base, 1, 7, 10).collect())
    assert want
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("1", "3"):
            spark.conf.set(name, size)
            assert sorted(tuple(r) for r in ngram_join.postings(base, 1, 7, 10).collect()) == want
    finally:
        spark.conf.set(name, before)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from quillstrata.llm.common import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        shared_dir(session)


def test_sketch_never_hides_a_link():
    rng = np.random.default_rng(5)
    for _ in range(100):
        n = int(rng.integers(20, 3000))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 30 :], rng.integers(0, 1 << 63, n // 30).astype(np.uint64)]))
        apart = len(np.setxor1d(x, y))
        sx, sy = (np.frombuffer(ngram_join.sketch(z), np.uint64) for z in (x, y))
        assert ngram_join.may_link(sx, sy, apart)


def cut_repeats(rows, k):
    order = sorted({(r[0] if r[0] is not None else 1 << 62, r[1]) for r in rows if r[1] is not None})
    seen, out = set(), {}
    for i, t in order:
        w = SPACE.findall(t)
        gone = set()
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if g in seen:
                gone |= set(range(j, j + k))
            seen.add(g)
        out[i, t] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    nothing = (0, 0, hashlib.sha256(b"").hexdigest())
    return sorted(((r[0], *(out[r[0] if r[0] is not None else 1 << 62, r[1]] if r[1] is not None else nothing)) for r in rows), key=repr)


@pytest.mark.parametrize("k,m", [(20, 3), (5, 2), (3, 3)])
def test_repeats_match_brute_force(docs, rows, k, m, monkeypatch):
    monkeypatch.setattr(substring, "RUN_BYTES", 3000)
    got = sorted((tuple(r) for r in substring.remove_repeats(docs, k=k, m=m, digest=True).collect()), key=repr)
    assert got == cut_repeats(rows, k)


def test_repeats_through_overfull_buckets_and_hot_minimisers(docs, rows, monkeypatch):
    """Every bucket is settled in pieces, over several rounds, and every minimiser is hot."""
    rounds = []
    whole = substring.write_once
    monkeypatch.setattr(substring, "write_once", lambda df, name: rounds.append(name) or whole(df, name))
    monkeypatch.setattr(substring, "RUN_BYTES", 2000)
    monkeypatch.setattr(substring, "HOLD_BYTES", 1)
    monkeypatch.setattr(substring, "SAMPLE_IN", 1)
    monkeypatch.setattr(substring, "HOT_WINDOWS", 5)
    got = sorted((tuple(r) for r in substring.remove_repeats(docs, k=5, m=2, digest=True).collect()), key=repr)
    assert got == cut_repeats(rows, 5)
    assert len(rounds) > 2


def test_even_keys_reach_every_partition(spark):
    from pyspark.sql import functions as F

    for parts in (1, 4, 51, 300):
        keys = spark.createDataFrame([(i, int(k)) for i, k in enumerate(substring.even_keys(parts))], "part int, key long")
        assert keys.where(F.pmod(F.hash("key"), F.lit(parts)) == F.col("part")).count() == parts


def test_hot_minimisers_split_one_bucket():
    """Windows that share a three-word group go to many buckets once it is hot."""
    text = b" ".join(b"%d of the and %d" % (i, i + 1) for i in range(300))
    words = text.split()
    h = substring.Words().encode(words)[1]
    sent = np.arange(len(words) - 19)
    plain = substring.ways(h, sent, 20, 3, np.zeros(0, np.uint64))
    hot = np.sort(np.unique(plain))
    split = substring.ways(h, sent, 20, 3, hot)
    assert len(np.unique(split)) > 2 * len(np.unique(plain))


def test_repeats_of_empty_table(empty):
    assert substring.remove_repeats(empty).collect() == []


def test_firsts_settles_hash_collisions():
    ids = np.array([1, 2, 3, 1, 2, 3, 9, 9], np.int32)
    hashes = np.zeros(8, np.uint64)
    places = np.arange(7)
    want, seen = [], {}
    for p in places:
        want.append(seen.setdefault(tuple(ids[p : p + 2]), p))
    assert substring.firsts(ids, hashes, places, 2).tolist() == want


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, n=10):
    known = {}
    for i, t in items:
        w = ITEM_WORD.findall(lower(t or ""))
        for j in range(max(1, len(w) - n + 1) if w else 0):
            known.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = []
    for r in rows:
        w = ITEM_WORD.findall(lower(r[1] or ""))
        hit, ids = set(), set()
        for size in {len(k) for k in known}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in known:
                    hit |= set(range(j, j + size))
                    ids |= {str(x) for x in known[tuple(w[j : j + size])] if x is not None}
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = make_rows()
    pick = [" ".join(rows[i][1].split()[3:40]) for i in (0, 5, 9, 12)]
    data = [(i, t) for i, t in enumerate(pick)] + [(7, "Changed"), (8, None), (9, ""), (None, "one two"), (2, pick[2]), (11, "ONE")]
    return data, spark.createDataFrame(data, "item_id long, text string")


def test_decontamination_matches_brute_force(docs, rows, items):
    got = sorted((tuple(r) for r in decontam.report(docs, items[1]).collect()), key=repr)
    assert got == contamination(rows, items[0])


def test_decontamination_without_broadcast(docs, rows, items, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 50)
    assert decontam.drop_contaminated(docs, items[1]).columns == docs.columns
    got = sorted((tuple(r) for r in decontam.report(docs, items[1]).collect()), key=repr)
    assert got == contamination(rows, items[0])


def test_decontamination_of_empty_tables(spark, docs, empty, items):
    assert decontam.report(empty, items[1]).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontam.report(docs, none).collect())
    assert decontam.drop_contaminated(docs, none).count() == docs.count()


def test_drop_and_cut(docs, rows, items):
    bad = {r[0] for r in contamination(rows, items[0]) if r[5]}
    kept = decontam.drop_contaminated(docs, items[1])
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - bad
    cleaned = decontam.cut_spans(docs, items[1])
    assert cleaned.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    for r, (i, n, hit, *_) in zip(sorted(rows, key=lambda r: repr((r[0],))), sorted(contamination(rows, items[0]), key=lambda x: repr((x[0],))), strict=True):
        assert len(ITEM_WORD.findall(lower(by[i] or ""))) == n - hit
        if not hit:
            assert by[i] == r[1]


def test_packed_rows_survive_bytes():
    packed, settled = substring.split_run([(1, 2, b"a b c d a b c d")], 4, 3, 2)
    assert settled.tolist() == [[1, 2, 4, 5]]
    assert sum(struct.unpack("<q", __import__("zstandard").ZstdDecompressor().decompress(b)[:8])[0] for _, b in packed) >= 1
