"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of order up to 3 holds symbol counts from
training texts.  A symbol's probability in a context is count / (n + d), with n the
context's count and d its different symbols; an unseen symbol pays the escape
d / (n + d) and is coded in the next shorter context, down to a uniform law over
the alphabet (PPM, method C, without exclusions).  A context a language never saw
costs nothing to leave.  Statistics are frozen after training, so the code length of
a byte depends on the three bytes before it alone: it is tabulated for every context
of the trees, and scoring a text is one table look-up for each of its bytes.

The language with the shortest code wins; the score is its share of the
probability, 2**-bits over the sum over all languages.

Training reads a bounded sample: about `per_language` documents of each language, and
no more than `SAMPLE_BYTES` for each of them on average, picked by a hash of their id (a
documented bound; the trees hold no more with more text, they only get sharper).
Scoring reads every whole text.  The table has a row for each context and symbol and a
column for each language; above `TABLE_BYTES` (about 200 languages of 400 documents)
training stops with an error rather than exceed what a driver and its executors hold.

Defined results
    null text or text without a letter   `und`, score 0 (a letter is of Unicode's category
                                         L; digits, fractions and marks alone are none)
    no training rows                     `und` for all
    ties                                 the language first in code point order
    repeated rows                        each gets its row; equal texts, equal results
    empty table                          no rows
    clashing columns                     inputs are renamed inside; extra ones ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import crc32_of

ORDER = 3
PER_LANGUAGE = 400
LETTER = regex.compile(r"\p{L}")
#: Bytes of training text for each document asked for, on average: longer documents
#: are picked less often, so the sample is bounded in bytes too.
SAMPLE_BYTES = 8 << 10
#: Largest table of code lengths that is built and sent to the executors.
TABLE_BYTES = 1 << 30
#: Bytes that are scored at once.
CHUNK = 1 << 20
SPREAD = 1 << 30


@dataclass
class Ppm:
    """codes: byte -> symbol (0: not in training, or before the text); contexts:
    packed last three symbols -> state; bits: code length by (state, symbol) and language."""

    languages: list[str]
    codes: np.ndarray
    contexts: np.ndarray
    bits: np.ndarray
    size: int


def _windows(codes: np.ndarray) -> list[np.ndarray]:
    """The symbols one, two and three places back; 0 before the text."""
    out = []
    for back in range(1, ORDER + 1):
        prior = np.zeros_like(codes)
        prior[back:] = codes[:-back]
        out.append(prior)
    return out


def train(samples: list[tuple[str, str]]) -> Ppm | None:
    """samples: (language, text)."""
    by: dict[str, list[bytes]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text.encode())
    languages = sorted(by)
    if not languages:
        return None
    seen = np.zeros(256, bool)
    for texts in by.values():
        for t in texts:
            seen[np.frombuffer(t, np.uint8)] = True
    codes = np.zeros(256, np.int64)
    codes[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1

    # grams[lang][k]: packed (k symbols back, nearest first; then the symbol) with counts
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        packed: list[list[np.ndarray]] = [[] for _ in range(ORDER + 1)]
        for t in by[lang]:
            s = codes[np.frombuffer(t, np.uint8)]
            key = np.zeros_like(s)
            packed[0].append(s)
            for k, prior in enumerate(_windows(s), 1):
                key = key * a + prior
                packed[k].append(key * a + s)
        grams.append([np.unique(np.concatenate(p), return_counts=True) for p in packed])

    # States: every context that any language saw, shortest first; state 0 is empty.
    bits, base = [], 0
    parent_keys, lower = np.zeros(1, np.int64), None
    contexts = np.zeros(a**ORDER, np.int32)
    for k in range(ORDER + 1):
        keys = np.zeros(1, np.int64) if k == 0 else np.unique(np.concatenate([g[k][0] // a for g in grams]))
        if (base + len(keys)) * a * len(languages) * 4 > TABLE_BYTES:
            raise ValueError(f"{len(languages)} languages need a table above {TABLE_BYTES} bytes; train on fewer documents")
        table = np.empty((len(keys), a, len(languages)))
        parent = None if k == 0 else np.searchsorted(parent_keys, keys // a)
        for i, g in enumerate(grams):
            gram, count = g[k]
            counts = np.zeros((len(keys), a))
            counts[np.searchsorted(keys, gram // a), gram % a] = count
            n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            shorter = np.full((1, a), 1.0 / a) if k == 0 else lower[parent, :, i]
            total = np.maximum(n + d, 1)
            escape = np.where(n > 0, d / total, 1.0)
            table[:, :, i] = np.where(counts > 0, counts / total, escape * shorter)
        if k:
            width = a ** (ORDER - k)
            spans = (keys[:, None] * width + np.arange(width)[None, :]).ravel()
            contexts[spans] = np.repeat(np.arange(base, base + len(keys), dtype=np.int32), width)
        bits.append((-np.log2(table)).astype(np.float32))
        base += len(keys)
        parent_keys, lower = keys, table
    return Ppm(languages, codes.astype(np.int32), contexts, np.concatenate(bits).reshape(base * a, len(languages)), a)


def code_lengths(model: Ppm, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each text under each language.  data: bytes; text i is
    data[starts[i]:starts[i + 1]]."""
    out = np.zeros((len(starts) - 1, len(model.languages)))
    filled = np.flatnonzero(np.diff(starts) > 0)
    i = 0
    while i < len(filled):
        j = i + 1
        while j < len(filled) and starts[filled[j] + 1] - starts[filled[i]] <= CHUNK:
            j += 1
        own = filled[i:j]
        low, high = starts[own[0]], starts[own[-1] + 1]
        s = model.codes[data[low:high]]
        begin = starts[own] - low
        key = np.zeros(len(s), np.int32)
        for back, prior in enumerate(_windows(s), 1):
            for first in range(back):
                at = begin + first
                prior[at[at < len(s)]] = 0
            key = key * model.size + prior
        # a text shorter than `back` lets the loop above blank symbols of the next
        # text only where they stand before it, which the next text blanks anyway
        cost = model.bits[model.contexts[key].astype(np.int64) * model.size + s]
        out[own] = np.add.reduceat(cost.astype(np.float64), begin, axis=0)
        i = j
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts, null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def predict(docs: DataFrame, model: Ppm | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The carried columns with the predicted language and its score, under `names`."""
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in carry]).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            letters = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            if m is None or not batch.num_rows:
                found, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                bits = code_lengths(m, *text_buffers(texts))
                best = bits.argmin(1)
                share = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                found = [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, share, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*carry, *names])

    return source.mapInArrow(run, schema)


def sample(docs: DataFrame, label: str, key: str, text: str, each: int) -> list[tuple[str, str]]:
    """About `each` (label, text) of every label, picked by a hash of the key; fewer where
    texts are longer than SAMPLE_BYTES on average."""
    sizes = docs.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).collect()  # a row for each language
    if not sizes:
        return []
    share = {r[label]: min(1.0, each / r["n"], each * SAMPLE_BYTES / max(r["bytes"], 1)) for r in sizes}
    limits = F.create_map(*[F.lit(x) for k, part in share.items() for x in (k, int(SPREAD * part))])
    spread = F.pmod(F.xxhash64(key), F.lit(SPREAD))
    rows = docs.where(spread < F.element_at(limits, F.col(label))).select(label, text).collect()
    return [(r[0], r[1]) for r in rows]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, held_out: int = 2, folds: int = 4) -> Ppm | None:
    """Trees from documents with a language outside the held-out fold."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.pmod(crc32_of(F.col(doc_id)), F.lit(folds)) != held_out))
    return train(sample(usable.select(F.col(doc_id).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")), "l", "k", "t", per_language))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = fit(docs, doc_id, text, lang)
    held = F.pmod(crc32_of(F.col(doc_id)), F.lit(4)) == 2
    slim = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return predict(slim, model, "text", ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are in a language: those without a letter go."""
    own = tuple(docs.columns)
    marked = predict(docs, fit(docs, doc_id, text, lang), text, own, ("__language", "__share"))
    return marked.where(F.col("__language") != "und").select(*[F.col(f"`{c}`") for c in own])
