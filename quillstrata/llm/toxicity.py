"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density, number and strength of lexicon words; lexicon words near
a second-person word; share of capitals, punctuation, marks and digits; rates of
obfuscated words (marks or digits between letters) and of those that read as lexicon
words once undone; length.  The lexicon is learned: words and word beginnings that
occur in labelled toxic texts far more often than in others.

Fitting reads a bounded sample of labelled rows (`SAMPLE`, picked by a hash of the
id).  One half gives the lexicon, the other the trees; isotonic regression maps
out-of-fold margins of the second half to probabilities.  Scoring reads every text.

Defined results
    null or empty text      features 0; the score of such a text
    no labelled rows        score 0 for all
    labels of one class     that class's smoothed rate for all
    repeated labels         toxic if any row says so
    repeated documents      each gets its row; equal texts, equal scores; of texts that
                            share an id the smallest is learned from
    empty table             no rows
    clashing columns        inputs are renamed inside; extra ones ignored
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import crc32_of

SAMPLE = 8_000
SPREAD = 1 << 30
WORD = re.compile(r"[^\W\d_]+")
OBFUSCATED = re.compile(r"[^\W\d_]+(?:[*@$#%!0-9_.\-]{1,2}[^\W\d_]+)+")
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su".split())
#: Marks and digits that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
MARKS = re.compile(r"[*#%_.\-]")
STEMS = range(4, 9)
EDGE = ".,;:!?\"'()"
#: Byte classes: 1 capital, 2 small letter, 3 digit, 4 space, 5 sentence marks, 6 other marks, 7 not ASCII.
CLASSES = np.zeros(256, np.int64)
CLASSES[[*range(65, 91)]], CLASSES[[*range(97, 123)]], CLASSES[[*range(48, 58)]], CLASSES[[9, 10, 11, 12, 13, 32]] = 1, 2, 3, 4
CLASSES[[*b".,;:'\"()?-"]], CLASSES[[*b"!@#$%&*+/<=>[\\]^_`{|}~"]], CLASSES[128:] = 5, 6, 7
FEATURES = ("density", "hits", "strongest", "total", "near", "capitals", "marks", "sentence", "digits", "shouts", "obfuscated", "undone", "words", "length")


def units(word: str) -> list[str]:
    """The word, and its beginnings, marked as such."""
    return [word, *("^" + word[:n] for n in STEMS if n < len(word))]


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = 4, precision: float = 0.7) -> dict[str, float]:
    """Unit -> strength (log odds).  A unit counts once for each different text."""
    yes, no = Counter(), Counter()
    n_yes = n_no = 0
    for text, label in {t: y for t, y in zip(texts, labels, strict=True)}.items():
        found = {u for w in set(WORD.findall(text.lower())) for u in units(w)}
        (yes if label else no).update(found)
        n_yes, n_no = n_yes + bool(label), n_no + (not label)
    out = {}
    for u, a in yes.items():
        b = no[u]
        if a >= least and a / (a + b) >= precision:
            odds = math.log((a + 0.5) / (n_yes + 1)) - math.log((b + 0.5) / (n_no + 1))
            if odds > 2:
                out[u] = odds
    return out


class Strength(dict):
    """Token (between white space, lower case) -> 0 if ordinary, else (strength of its
    words, is it obfuscated, strength once undone, is it second-person).  It remembers
    tokens, up to a bound, since most recur."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {u.lstrip("^")[: STEMS[0]] for u in lexicon}

    def of_word(self, word: str) -> float:
        return max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)

    def __missing__(self, token: str) -> tuple[float, bool, float, bool] | int:
        if len(self) > 400_000:
            self.clear()
        bare = token.strip(EDGE)
        if bare.isalpha() and bare[: STEMS[0]] not in self.heads and bare not in SECOND_PERSON:
            self[token] = 0
            return 0
        words = WORD.findall(token)
        plain = max(map(self.of_word, words), default=0.0)
        odd = OBFUSCATED.findall(token) if len(words) > 1 else []
        undone = max((self.of_word(MARKS.sub("", o.translate(LEET))) for o in odd), default=0.0)
        person = not SECOND_PERSON.isdisjoint(words)
        out = (plain, bool(odd), undone, person) if plain or odd or person else 0
        self[token] = out
        return out


def features(text: str | None, strength: Strength) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    tokens = low.split()
    n = max(1, len(tokens))
    special = [(i, v) for i, v in enumerate(map(strength.__getitem__, tokens)) if v]
    hits = [(i, max(v[0], v[2])) for i, v in special if v[0] or v[2]]
    persons = [i for i, v in special if v[3]] if hits else []
    near = sum(1 for i, _ in hits if bisect_left(persons, i - 5) < bisect_right(persons, i + 5))
    raw = np.frombuffer(text.encode(), np.uint8)
    c = np.bincount(CLASSES[raw], minlength=8)
    letters = max(1, c[1] + c[2] + c[7])
    return [
        len(hits) / n, len(hits), max((s for _, s in hits), default=0.0), math.log1p(sum(s for _, s in hits)), near,
        c[1] / letters, c[6] / len(raw), c[5] / len(raw), c[3] / len(raw), low.count("!") / n,
        sum(1 for _, v in special if v[1]) / n, sum(1 for _, v in special if v[2]), math.log1p(len(tokens)), len(raw) / n,
    ]


@dataclass
class Trees:
    """Boosted trees of one depth; node i of a tree has children 2i + 1 and 2i + 2."""

    start: float
    rate: float = 0.15
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += self.rate * leaf[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over histograms of quantile bins."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(math.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(np.unique(col), np.linspace(0, 1, bins + 1)[:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], 1)
    wide = max(len(e) for e in edges) + 1
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for i in range(first, 2 * first + 1):
                own = node == i
                best = 1e-6
                if own.sum() < 10:
                    continue
                total_g, total_h = g[own].sum(), h[own].sum()
                for f in range(x.shape[1]):
                    b = binned[own, f]
                    gl, hl = np.bincount(b, g[own], wide).cumsum()[:-1], np.bincount(b, h[own], wide).cumsum()[:-1]
                    gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                    gain = gain[: len(edges[f])]
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[i], cut[i] = gain[k], f, edges[f][k]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(value)
        margin += model.rate * value[leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing rates at them."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first and last margin
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([float(v), 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], last]
    at = np.array([b[k] for b in blocks for k in (2, 3)])
    rate = np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks for _ in (0, 1)])
    return at, np.maximum.accumulate(rate)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    rate: np.ndarray

    def score(self, texts: list[str | None], strength: Strength) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.rate[0])
        x = np.array([features(t, strength) for t in texts], float)
        return np.interp(self.trees.margin(x), self.at, self.rate)


def train(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        rate = 0.0 if not len(y) else (y.sum() + 0.5) / (len(y) + 1)
        return Model({}, None, np.zeros(1), np.array([rate]))
    half = np.arange(len(y)) % 2 == 0
    lexicon = learn_lexicon([t for t, h in zip(texts, half, strict=True) if h], y[half])
    strength = Strength(lexicon)
    x = np.array([features(t, strength) for t, h in zip(texts, half, strict=True) if not h], float)
    y = y[~half]
    if not len(y) or y.min() == y.max():
        return Model({}, None, np.zeros(1), np.array([(y.sum() + 0.5) / (len(y) + 1)]))
    out = np.zeros(len(y))
    for fold in range(3):
        test = np.arange(len(y)) % 3 == fold
        out[test] = boost(x[~test], y[~test]).margin(x[test]) if y[~test].any() else 0.0
    return Model(lexicon, boost(x, y), *isotonic(out, y))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = SAMPLE, folds: int = 5, held_out: int = 0) -> Model:
    """Learns from labelled rows outside the held-out fold, at most about `bound`."""
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (F.pmod(crc32_of(F.col(doc_id)), F.lit(folds)) != held_out))
    rows = usable.count()
    if not rows:
        return train([], [])
    spread = F.pmod(F.xxhash64(doc_id), F.lit(SPREAD)) < min(SPREAD, int(SPREAD * bound / rows))
    picked = usable.where(spread).groupBy(F.col(doc_id).alias("k")).agg(F.max(label).alias("y"))
    # `picked` has about `bound` rows, whatever the input
    joined = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(picked), F.col("d") == F.col("k"))
    once = joined.groupBy("k", "y").agg(F.min("t").alias("t"))  # one text for each id, however often it is repeated
    got = sorted((r["k"], r["t"] or "", r["y"]) for r in once.collect())
    return train([t for _, t, _ in got], [y for _, _, y in got])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, label))
    held = F.pmod(crc32_of(F.col(doc_id)), F.lit(5)) == 0
    slim = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        strength = Strength(model.lexicon)
        for batch in batches:
            s = model.score(batch.column(2).to_pylist(), strength)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
