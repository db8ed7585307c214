"""Operators that judge, store, place or mix single documents."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstrata.llm import flac, langid, mixing, quality, queries, sharding, toxicity, urlfilter
from tests.llm.conftest import SPACE

MASK = (1 << 64) - 1


def jump(key, shards):
    key, b, j = key & MASK, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_matches_published_algorithm(spark):
    keys = [0, 1, 2, 10, 256, -1, (1 << 63) - 1, -(1 << 63), *range(1000, 1400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 100):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()}
        assert got == {k: jump(k, shards) for k in keys}


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == sorted(
        (r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), jump(r[0] or 0, 8), jump(r[0] or 0, 9)) for r in rows
    )
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)


def test_sharding_of_empty_table_and_text_keys(empty, docs):
    assert sharding.shard_documents(empty).collect() == []
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r["shard"] for r in sharding.shard_documents(named).collect()} <= set(range(8))


def test_slots_keep_columns_and_split_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    extra = "_s _b _bucket _start _row doc place bucket n at s b start order0".split()
    rows = [(None if i % 3 else i, f"text {i}", *[f"{c}{i}" for c in extra]) for i in range(200)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in extra]]))
    got = sharding.shard_documents(docs).collect()
    assert sorted(tuple(r[c] for c in ("text", *extra)) for r in got) == sorted((r[1], *r[2:]) for r in rows)
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    placed = sharding.assign_shards(docs.withColumn("size", F.lit(1)).withColumn("crc", F.crc32(F.col("text").cast("binary"))), "doc_id", 8)
    sharding.number_slots(placed, "doc_id", ["size", "crc"]).collect()


def fill(sizes, weights, repeats):
    """Targets by sharing again until none is above."""
    total, caps = sum(sizes.values()), {s: repeats * n for s, n in sizes.items()}
    fixed = {}
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(fixed.values())
        w = sum(weights[s] for s in free)
        share = {s: left * weights[s] / w for s in free} if free else {}
        over = [s for s in free if share[s] > caps[s]]
        if not over:
            return fixed | share
        fixed |= {s: caps[s] for s in over}


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(SPACE.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_stops_at_three_times(spark):
    rows = [(i, "w " * 10, "big") for i in range(60)] + [(100, "w " * 7, "small"), (101, "w w w", "tiny")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[100]["taken"] == 21 and by[101]["taken"] == 9 and by[100]["target"] == 21.0
    assert sum(r["taken"] for r in got) == 610


def test_mixing_deals_rows_without_an_id_in_the_same_order(spark, monkeypatch):
    rows = [(None, "w " * (i % 7 + 1) + str(i), "a") for i in range(300)] + [(i, "x y", "a") for i in range(300)] + [(9, "z " * 400, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(map(repr, mixing.mix(docs).collect())) == whole


def test_mixing_of_empty_table(empty):
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed_documents(empty).columns == empty.columns


def test_schedules_invert(spark):
    for knots in mixing.SCHEDULES.values():
        t = np.linspace(0, 1, 401)
        w = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
        got = spark.createDataFrame([(float(a),) for a in area], "f double").select(mixing.invert_schedule(F.col("f"), knots).alias("t")).collect()
        assert np.allclose([r["t"] for r in got], t, atol=1e-3)


def test_flac_round_trip():
    rng = np.random.default_rng(1)
    noise = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (1, 191, 192, 193, 5000)]
    wave = [(np.sin(np.arange(4000) / 9) * 90 + 128).astype(np.uint8).tobytes(), b"a" * 1000, b"", "héé".encode() * 900, bytes(range(256)) * 200]
    payloads = [flac.pad(t) for t in noise + wave]
    assert all(len(p) % 192 == 0 and p for p in payloads)
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert flac.decode([streams[3]]) == [payloads[3]]
    assert len(streams[6]) < 200
    assert dict(flac.blocks(payloads[4], 384))[384] == payloads[4][384:768]


def test_flac_linear_predictor_is_used_and_read():
    x = (np.cumsum(np.random.default_rng(2).normal(0, 4, 192 * 6)) % 200).astype(np.uint8)
    decay = np.zeros(192)
    for i in range(1, 192):
        decay[i] = 0.8 * decay[i - 1] + np.random.default_rng(i).normal(0, 9)
    p = [x.tobytes(), (np.clip(decay, -120, 120) + 128).astype(np.uint8).tobytes()]
    assert flac.decode(flac.encode(p)) == p


def test_flac_damage_is_found():
    stream = bytearray(flac.encode([flac.pad(b"some text " * 100)])[0])
    for at in (0, 60, 100, len(stream) - 1, 30):
        bad = bytearray(stream)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


class Writer:
    """Bits of a frame, put down one by one."""

    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += f"{value & (1 << width) - 1:0{width}b}" if width else ""

    def bytes(self):
        return int(self.text + "0" * (-len(self.text) % 8), 2).to_bytes(-(-len(self.text) // 8), "big")


def plain_crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (width - 1) & 1 else 0)) & (1 << width) - 1
    return c


def write_subframe(w, x, bits, kind, parts=0, method=0, escape=False, wasted=0):
    """kind: constant, verbatim, or (weights, shift); fixed predictors by their order."""
    codes = {"constant": 0, "verbatim": 1}
    code = codes.get(kind, 8 + kind if isinstance(kind, int) else 31 + len(kind[0]) if not isinstance(kind, str) else 0)
    w.put(0, 1), w.put(code, 6), w.put(bool(wasted), 1)
    if wasted:
        w.put(1, wasted)
        x, bits = [v >> wasted for v in x], bits - wasted
    if kind == "constant":
        return w.put(x[0], bits)
    if kind == "verbatim":
        return [w.put(v, bits) for v in x]
    weights, shift = (flac.FIXED[kind], 0) if isinstance(kind, int) else kind
    order = len(weights)
    for v in x[:order]:
        w.put(v, bits)
    if not isinstance(kind, int):
        w.put(11, 4), w.put(shift, 5)
        for c in weights:
            w.put(c, 12)
    residual = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))]
    w.put(method, 2), w.put(parts, 4)
    size = len(x) >> parts
    for p in range(1 << parts):
        own = residual[max(0, p * size - order) : (p + 1) * size - order]
        if escape and p % 2:
            w.put((1 << 4 + method) - 1, 4 + method), w.put(bits + 4, 5)
            for r in own:
                w.put(r, bits + 4)
            continue
        k = min(13, int(np.log2(1 + np.mean(np.abs(own))))) + p % 2 if own else 0
        w.put(k, 4 + method)
        for r in own:
            folded = r << 1 if r >= 0 else (-r << 1) - 1
            w.text += "0" * (folded >> k) + "1"
            w.put(folded, k)


def write_stream(samples, bits, block, subframes, layout=None, md5=True):
    """A stream of channels x n samples; subframes: how each frame's channels are written."""
    channels, n = len(samples), len(samples[0])
    frames = b""
    for number, at in enumerate(range(0, n, block)):
        x = [list(c[at : at + block]) for c in samples]
        size, mode = len(x[0]), layout[number % len(layout)] if layout else channels - 1
        if mode == 8:
            x = [x[0], [a - b for a, b in zip(*x, strict=True)]]
        elif mode == 9:
            x = [[a - b for a, b in zip(*x, strict=True)], x[1]]
        elif mode == 10:
            x = [[a + b >> 1 for a, b in zip(*x, strict=True)], [a - b for a, b in zip(*x, strict=True)]]
        w = Writer()
        w.put(0x7FFC, 15), w.put(0, 1), w.put(7, 4), w.put(13, 4), w.put(mode, 4), w.put({8: 1, 12: 2, 16: 4, 20: 5, 24: 6}[bits], 3), w.put(0, 1)
        for b in flac._number(number):
            w.put(b, 8)
        w.put(size - 1, 16), w.put(44100, 16)
        w.put(plain_crc(w.bytes(), 0x07, 8), 8)
        for c in range(channels):
            side = mode > 7 and c == (0 if mode == 9 else 1)
            write_subframe(w, x[c], bits + side, *subframes[(number * channels + c) % len(subframes)])
        raw = w.bytes()
        frames += raw + plain_crc(raw, 0x8005, 16).to_bytes(2, "big")
    width = -(-bits // 8)
    flat = b"".join(int(c[i]).to_bytes(width, "little", signed=True) for i in range(n) for c in samples)
    packed = 44100 << 44 | channels - 1 << 41 | bits - 1 << 36 | n
    head = block.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + (hashlib.md5(flat).digest() if md5 else bytes(16))
    return b"fLaC\x00\x00\x00\x22" + head + b"\x81\x00\x00\x03abc" + frames


LINEAR = ((1500, -700, 120), 10)
KINDS = [(0, 2), (1, 0), (2, 3, 1), (3, 1, 0, True), (4, 2, 1, True), (LINEAR, 2), ("verbatim",), (LINEAR, 3, 1, True)]


@pytest.mark.parametrize("bits,channels,layout", [(8, 1, None), (16, 2, (8, 9, 10, 1)), (24, 2, (10, 8)), (12, 3, None), (20, 1, None)])
def test_flac_of_other_encoders_is_read(bits, channels, layout):
    rng = np.random.default_rng(bits)
    top = 1 << (bits - 2)
    wave = [(np.sin(np.arange(1000) / (5 + c)) * top * 0.7 + rng.integers(-9, 9, 1000)).astype(int) for c in range(channels)]
    stream = write_stream(wave, bits, 256, KINDS, layout)  # the last frame is shorter: 232 samples
    about, got = flac.read(stream)
    assert (about.bits, about.channels, about.rate, about.samples) == (bits, channels, 44100, 1000)
    assert np.array_equal(got, np.stack(wave))
    whole = flac._pcm(got, bits)
    width = channels * -(-bits // 8)
    assert flac.seek(stream, 300, 450) == whole[300 * width : 750 * width]
    assert b"".join(p for _, p in flac.block_lists([stream], 100)[0]) == whole
    for at in (0, 60, len(stream) - 1, len(stream) // 2):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.read(bytes(bad))


def test_flac_constant_wasted_and_escaped_frames():
    rows = [[7 * 8] * 192 + [8 * int(v) for v in np.random.default_rng(0).integers(-12, 12, 192)]]
    stream = write_stream(rows, 8, 192, [("constant",), (2, 4, 0, True, 3)])
    assert flac.info(stream).own  # by its description; partitions and wasted bits say otherwise
    assert np.array_equal(flac.read(stream)[1], np.array(rows))
    mine = flac.encode([flac.pad(b"mine")])[0]
    both = flac.block_lists([mine, stream], 100)
    assert b"".join(p for _, p in both[0]) == flac.pad(b"mine")
    assert b"".join(p for _, p in both[1]) == (np.array(rows[0]) + 128).astype(np.uint8).tobytes()


def test_flac_seeks_without_decoding_the_rest(monkeypatch):
    payload = flac.pad("".join(f"line {i} of a longer text\n" for i in range(4000)).encode())
    stream = flac.encode([payload])[0]
    about, reads = flac.info(stream), []
    assert [p[0] for p in about.points] == list(range(0, len(payload), flac.SEEK))
    plain = flac._subframe
    monkeypatch.setattr(flac, "_subframe", lambda *a: reads.append(1) or plain(*a))
    for first, count in ((0, 10), (flac.SEEK * 5, 400), (50_001, 7000), (len(payload) - 5, 50)):
        reads.clear()
        assert flac.seek(stream, first, count) == payload[first : first + count]
        assert len(reads) <= flac.SEEK // 192 + count // 192 + 3
    assert np.array_equal(flac.read(stream)[1][0], np.frombuffer(payload, np.uint8).astype(int) - 128)


def test_flac_media_of_null_and_damaged_streams(spark):
    kind = "doc_id long, media binary, extra string, blocks int"
    stream = flac.encode([flac.pad(b"x")])[0]
    got = flac.pcm(spark.createDataFrame([(1, stream, "e", 3), (2, None, "f", 4)], kind)).collect()
    assert {r["doc_id"]: (r["extra"], r["blocks"] and len(r["blocks"])) for r in got} == {1: ("e", 1), 2: ("f", None)}
    with pytest.raises(Exception, match="FLAC stream"):
        flac.pcm(spark.createDataFrame([(1, stream[:-1] + b"?", "e", 3)], kind)).collect()


def test_flac_digest(docs, rows, empty):
    got = sorted((tuple(r) for r in flac.digest(flac.pcm(flac.store(docs))).collect()), key=repr)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    for r in rows:
        raw = (r[1] or "").encode()
        p = flac.pad(raw)
        assert by[r[0]][1:5] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert flac.digest(flac.pcm(flac.store(empty))).collect() == []
    pcm = flac.pcm_blocks(flac.store(docs.where("doc_id < 3"))).orderBy("doc_id", "sample_offset").collect()
    assert b"".join(r["pcm"] for r in pcm if r["doc_id"] == 1) == flac.pad(rows[1][1].encode())


def test_flac_memory_is_bounded_by_bytes_not_rows(spark, monkeypatch):
    """One batch of many rows, as Spark makes it: every operator holds a run of it at a time."""
    taken, frame = [], type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, run, schema: taken.append(run) or plain(df, run, schema))
    monkeypatch.setattr(flac, "CHUNK", 1 << 15)
    flac.digest(flac.pcm(flac.store(spark.createDataFrame([], "doc_id long, text string"))))
    texts = [chr(97 + i % 26) * 20000 for i in range(150)]  # about 1 KB each as a stream
    batch = pa.RecordBatch.from_pydict({"doc_id": range(150), "text": texts})
    for run in taken:
        made, peak = [], 0
        tracemalloc.start()
        try:
            made.extend(run(iter([batch])))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < sum(map(len, texts)) / 2
        assert max(b.nbytes for b in made) < 4 * flac.CHUNK
        batch = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    assert batch.column(3).to_pylist() == [hashlib.sha256(flac.pad(t.encode())).hexdigest() for t in texts]


def test_flac_features_are_those_of_the_three_operators(docs, empty):
    once = flac.features(docs)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # one Python worker a task
    three = flac.digest(flac.pcm(flac.store(docs)))
    assert once.schema == three.schema
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, three.collect()), key=repr)
    assert flac.features(empty).collect() == []


def test_flac_feature_over_several_chunks(monkeypatch):
    payload = np.random.default_rng(3).integers(0, 256, 192 * 50).astype(np.uint8).tobytes()
    x = [v - 128 for v in payload]
    mean = sum(x) // len(x)
    crossings = sum((a > mean) != (b > mean) for a, b in zip(x, x[1:], strict=False))
    monkeypatch.setattr(flac, "CHUNK", 1000)
    assert flac.feature(payload) == f"samples={len(x)};mean={mean};energy={sum(v * v for v in x) // len(x)};crossings={crossings}"


def slow_bits(model, text):
    s = [int(model.codes[b]) for b in text]
    out = np.zeros(len(model.languages))
    for i, sym in enumerate(s):
        key = 0
        for back in (1, 2, 3):
            key = key * model.size + (s[i - back] if i >= back else 0)
        out += model.bits[int(model.contexts[key]) * model.size + sym]
    return out


def test_ppm():
    model = langid.train([("en", "the cat and the dog " * 20), ("fr", "le chat et le chien " * 20), ("fr", "é")])
    probability = np.exp2(-model.bits.reshape(-1, model.size, len(model.languages)).astype(float))
    assert (probability.sum(1) <= 1.0001).all() and (probability > 0).all()
    texts = [b"the", b"", b"chat", "é et".encode(), b"x"]
    starts = np.cumsum([0, *map(len, texts)])
    bits = langid.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), starts)
    for b, t in zip(bits, texts, strict=True):
        assert np.allclose(b, slow_bits(model, t))
    assert model.languages[bits[0].argmin()] == "en" and model.languages[bits[2].argmin()] == "fr"


def test_ppm_counts_and_escapes_match_the_definition():
    """Trees counted in dictionaries: every context of up to three bytes, method C."""
    rng = np.random.default_rng(2)
    samples = [(lang, "".join(rng.choice(list(letters), int(n)))) for lang, letters in (("a", "abcé "), ("b", "bcd ")) for n in rng.integers(0, 60, 12)]
    model = langid.train(samples)
    symbols = sorted({b for _, t in samples for b in t.encode()})
    for i, lang in enumerate(model.languages):
        seen = {}
        for name, t in samples:
            if name == lang:
                for at, b in enumerate(raw := t.encode()):
                    past = [*raw[:at][::-1][:3], None, None, None][:3]
                    for k in range(4):
                        tally = seen.setdefault(tuple(past[:k]), {})
                        tally[b] = tally.get(b, 0) + 1

        def chance(past, b, seen=seen):
            tally = seen.get(tuple(past))
            below = 1 / (len(symbols) + 1) if not past else chance(past[:-1], b)
            if not tally:
                return below
            n, d = sum(tally.values()), len(tally)
            return tally[b] / (n + d) if b in tally else d / (n + d) * below

        for _ in range(20):
            raw = "".join(rng.choice(list("abcdé "), int(rng.integers(1, 40)))).encode()
            want = -sum(np.log2(chance([*raw[:at][::-1][:3], None, None, None][:3], b if b in symbols else -1)) for at, b in enumerate(raw))
            got = langid.code_lengths(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert got[0, i] == pytest.approx(want, rel=1e-5)


def test_only_letters_make_a_language(spark):
    texts = ["²½", "١٢٣", "Ⅻ", "①", "𝟙", "_", "1ª", "a", "Ж", "字", None, ""]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)] + [(100 + i, "abc", "xx") for i in range(9)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert [got[i] for i in range(len(texts))] == ["und"] * 6 + ["xx"] * 4 + ["und"] * 2


def test_ppm_table_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "TABLE_BYTES", 1000)
    with pytest.raises(ValueError):
        langid.train([("en", "the cat and the dog")])


def test_language_id(docs, rows, empty):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert langid.identify(empty).collect() == []
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in rows if r[1] and any(c.isalpha() for c in r[1]))


def test_language_id_held_out_accuracy(spark, sf):
    got = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    yes = [r for r in got if r["toxic"] == 1]
    assert sum(r["predicted"] for r in yes) >= 0.8 * len(yes)
    assert sum(r["predicted"] for r in got if r["toxic"] == 0) <= 0.02 * len(got)


def test_toxicity_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(1, 60)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(empty, labels).collect() == []
    assert {r["score"] for r in toxicity.score(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_features_match_a_plain_reading():
    strength = toxicity.Strength({"vile": 3.0, "^idio": 2.0})
    text = "You are VILE, v1le idiot! " + "fine words here " * 4 + "vile"
    got = dict(zip(toxicity.FEATURES, toxicity.features(text, strength), strict=True))
    tokens = text.lower().split()
    bad = {2: 3.0, 3: 3.0, 4: 2.0, len(tokens) - 1: 3.0}
    assert got["hits"] == 4 and got["density"] == pytest.approx(4 / len(tokens)) and got["strongest"] == 3.0
    assert got["total"] == pytest.approx(np.log1p(sum(bad.values())))
    assert got["near"] == sum(1 for i in bad if abs(i - 0) <= 5)
    assert got["capitals"] == pytest.approx(5 / sum(c.isalpha() for c in text))
    assert got["obfuscated"] == pytest.approx(1 / len(tokens)) and got["undone"] == 1
    assert got["digits"] == pytest.approx(1 / len(text)) and got["length"] == pytest.approx(len(text) / len(tokens))


def test_toxicity_pairs_in_linear_time():
    strength = toxicity.Strength({"vile": 3.0})
    n = 200_000
    got = dict(zip(toxicity.FEATURES, toxicity.features("vile you " * n, strength), strict=True))
    assert got["near"] == n and got["hits"] == n


def test_first_tree_is_the_best_greedy_one():
    """Gains by trying every cut of every feature, one node at a time."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.5)).astype(float)
    model = toxicity.boost(x, y, trees=1, depth=2, bins=1000)
    g, h = y - 1 / (1 + np.exp(-model.start)), np.full(len(y), 1 / (1 + np.exp(-model.start)) * (1 - 1 / (1 + np.exp(-model.start))))

    def best(own):
        score = lambda part: g[part].sum() ** 2 / (h[part].sum() + 1)
        gains = [(score(own & (x[:, f] <= c)) + score(own & (x[:, f] > c)) - score(own), f, c) for f in range(3) for c in np.unique(x[:, f])]
        return max(gains, key=lambda t: t[0])

    whole = np.ones(len(y), bool)
    gain, f, c = best(whole)
    assert gain > 0 and np.array_equal(x[:, model.feature[0][0]] <= model.cut[0][0], x[:, f] <= c)
    for node, own in ((1, x[:, f] <= c), (2, x[:, f] > c)):
        gain, f2, c2 = best(own)
        if own.sum() >= 10 and gain > 1e-6:
            assert np.array_equal(own & (x[:, model.feature[0][node]] <= model.cut[0][node]), own & (x[:, f2] <= c2))


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at, rate = toxicity.isotonic(m, y)
    assert (np.diff(rate) >= 0).all() and (np.diff(at) >= 0).all()


def plain_rule(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r), r, v) for v, r in queries.URL_RULES if (h := r[: r.index("/")]) is not None and (host == h or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "x://m.example.com/en", "http://a.net/fr/", "http://net/es/1", "http://xnet/es/", "http://a.com", "http://a.com?x/", None, "", "nothing", "http://", "http://é.com/é#z", "a://b://c.com/d", "http://www.example.com/en/" + "x" * 5000, "http://a.com/\n/x"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = sorted(tuple(r) for r in urlfilter.judge(pages, queries.URL_RULES).collect())
    assert got == [(i, *plain_rule(u)) for i, u in enumerate(URLS * 2)]
    assert urlfilter.judge(pages.limit(0), queries.URL_RULES).collect() == []
    assert {r["verdict"] for r in urlfilter.judge(pages, []).collect()} == {"allow"}


def test_url_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "FILE_BYTES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = sorted(tuple(r) for r in urlfilter.judge(pages, queries.URL_RULES).collect())
    assert got == [(i, *plain_rule(u)) for i, u in enumerate(URLS)]
    assert {r["verdict"] for r in urlfilter.judge(pages, []).collect()} == {"allow"}


def test_url_join_asks_only_what_rules_can_answer(spark, monkeypatch):
    """A long url in a deep host costs as many candidates as there are rule shapes."""
    assert len(list(urlfilter.candidates(".".join("a" * 2000), "/" + "x" * 5000, [1, 4], [1, 2, 3]))) == 6
    monkeypatch.setattr(urlfilter, "FILE_BYTES", 0)
    pages = spark.createDataFrame([(1, "http://" + "a." * 2000 + "net/" + "x" * 5000)], "page_id long, url string")
    assert [r["rule"] for r in urlfilter.judge(pages, [("block", "net/"), ("block", "org/x")]).collect()] == ["net/"]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_url_rules_of_odd_shapes(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "FILE_BYTES", limit)
    rules = spark.createDataFrame([("block", "org"), ("allow", "a.org/x"), ("block", None), ("allow", "org")], "verdict string, rule string")
    pages = spark.createDataFrame([(1, "http://org"), (2, "http://b.org/y"), (3, "http://a.org/xy"), (4, None)], "page_id long, url string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules).collect())
    assert got == [(1, "org", "block"), (2, "org", "block"), (3, "a.org/x", "allow"), (4, None, "allow")]


def test_url_index_survives_colliding_digests(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter, "digest", lambda text: 42)
    (tmp_path / "i").write_bytes(urlfilter.pack(queries.URL_RULES))
    index = urlfilter.Index(str(tmp_path / "i"))
    assert index.find(["www.example.com", "a.org"], ["/en/1", "/"]) == (["www.example.com/en/", None], ["allow", None])


def kneser_ney(texts, order):
    """Probabilities by the textbook, over bytes with a padded start."""
    counts = {}
    for t in texts:
        s = b"\0" * (order - 1) + t
        for i in range(order - 1, len(s)):
            g = s[i - order + 1 : i + 1]
            counts[g] = counts.get(g, 0) + 1
    tables = {order: counts}
    for o in range(order - 1, 0, -1):
        tables[o] = {}
        for g in tables[o + 1]:
            tables[o][g[1:]] = tables[o].get(g[1:], 0) + 1
    ds = {o: quality.discounts(*[sum(1 for v in t.values() if v == i) for i in (1, 2, 3, 4)]) for o, t in tables.items()}

    def p(g):
        if not g:
            return 1 / 256
        t, d = tables[len(g)], ds[len(g)]
        rivals = {k: v for k, v in t.items() if k[:-1] == g[:-1]}
        below = p(g[1:])
        if not rivals:
            return below
        cut = lambda v: d[min(v, 3) - 1]
        total = sum(rivals.values())
        return max(rivals.get(g, 0) - (cut(rivals[g]) if g in rivals else 0), 0) / total + sum(map(cut, rivals.values())) / total * below

    return p


def test_kneser_ney_matches_textbook(spark):
    train = [b"the cat sat on the mat", b"a cat and a hat", b"that hat sat flat on the mat"] * 2 + [b"rats chat"]
    docs = spark.createDataFrame([(i, 0, t.decode()) for i, t in enumerate(train)], "id long, lang int, text string")
    model = quality.build(quality.count(docs))
    p = kneser_ney(train, quality.ORDER)
    texts = [b"the rat sat", b"", b"zzz", b"cat", b"mat on the mat"]
    asked = spark.createDataFrame([(i, 0, t.decode()) for i, t in enumerate(texts)], "id long, lang int, text string")
    got = {r["id"]: (r["n"], r["bits"]) for r in quality.score(asked, model, 4, 3, 0).collect()}
    for i, t in enumerate(texts):
        s = b"\0" * (quality.ORDER - 1) + t
        want = sum(-np.log2(p(s[j : j + quality.ORDER])) for j in range(len(t)))
        assert got[i][0] == len(t) and got[i][1] == pytest.approx(want, rel=1e-4)


def test_quality_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["keep"] for r in got if r["perplexity"] is None or r["n_bytes"] == 0)
    assert all(r["perplexity"] is not None and r["threshold"] is not None for r in got if r["lang"] is None)
    with pytest.raises(TypeError):
        quality.judge(docs.withColumn("doc_id", F.col("doc_id").cast("string")), labels)
    assert quality.judge(empty, labels).collect() == []
    assert all(r["keep"] for r in quality.judge(docs, labels.where("false")).collect())


def test_quality_tells_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_quality(spark, sf).join(labels, "doc_id").collect()
    good, bad = [r["keep"] for r in got if r["quality"] == 1], [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_quality_threshold_is_the_quantile_itself(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_quality(spark, sf).join(labels, "doc_id").collect()
    for lang in {r["lang"] for r in got}:
        own = [r for r in got if r["lang"] == lang]
        held = sorted(r["perplexity"] for r in own if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert all(r["threshold"] == pytest.approx(held[-(-99 * len(held) // 100) - 1], rel=1e-9) for r in own)
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(bad) <= 0.1 * len(bad)
