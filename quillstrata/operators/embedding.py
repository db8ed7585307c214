"""Embedding providers: request batching, limits, retries, and a column of vectors."""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol
from urllib import error, request

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ProviderError(RuntimeError):
    """A request that cannot succeed."""


class RetryableError(ProviderError):
    """A request that may succeed later."""


class TooLargeError(ProviderError):
    """A text beyond the provider's token limit."""


#: Dimensions of known models.
KNOWN_MODELS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}


@dataclass(frozen=True)
class Limits:
    texts: int = 64
    tokens: int = 8191
    concurrency: int = 8

    def resolve(self, batch_size: int | str = "auto", max_tokens: int | None = None, concurrency: int | str = "auto", cpus: int | None = None) -> Limits:
        """The least of what is configured and what the provider allows."""
        texts = self.texts if batch_size == "auto" else min(int(batch_size), self.texts)
        tokens = self.tokens if max_tokens is None else min(max_tokens, self.tokens)
        most = self.concurrency if concurrency == "auto" else min(int(concurrency), self.concurrency)
        return Limits(texts, tokens, max(1, min(most, cpus) if cpus else most))


class Provider(Protocol):
    limits: Limits

    def dim(self, model: str) -> int: ...

    def embed(self, model: str, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HashProvider:
    """Deterministic vectors without a network: signed hashes of words."""

    size: int = 16
    limits: Limits = field(default_factory=Limits)

    def dim(self, model: str) -> int:
        return KNOWN_MODELS.get(model, self.size)

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        n, out = self.dim(model), []
        for t in texts:
            v = np.zeros(n)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(f"{model}\0{w}".encode(), digest_size=8).digest(), "big")
                v[h % n] += 1 if h >> 63 else -1
            out.append(v.tolist())
        return out


#: Status, headers and body of an answer to (url, headers, body, seconds).
Transport = Callable[[str, dict[str, str], bytes, float], tuple[int, dict[str, str], bytes]]
#: Statuses after which a request may be repeated, besides 500 and above.
AGAIN = (408, 409, 429)


def post(url: str, headers: dict[str, str], body: bytes, seconds: float) -> tuple[int, dict[str, str], bytes]:
    """A POST by the standard library."""
    try:
        with request.urlopen(request.Request(url, body, headers, method="POST"), timeout=seconds) as answer:
            return answer.status, dict(answer.headers), answer.read()
    except error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


@dataclass
class HttpProvider:
    """Embeddings over HTTP, in the common form: model and input in, data with index and
    embedding out.  It is sent to the workers as it is; the key is read there, from the
    environment variable `key_name`."""

    url: str
    key_name: str = "EMBEDDINGS_API_KEY"
    timeout: float = 30.0
    limits: Limits = field(default_factory=Limits)
    transport: Transport = post
    probed: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.timeout <= 0:
            raise ValueError("the timeout must be positive")

    def dim(self, model: str) -> int:
        """Of a known model, or found by one request."""
        if model in KNOWN_MODELS:
            return KNOWN_MODELS[model]
        if model not in self.probed:
            self.probed[model] = len(with_retries(lambda: self.embed(model, ["probe"]))[0])
        return self.probed[model]

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        key = os.environ.get(self.key_name)
        if not key:
            raise ProviderError(f"{self.key_name} is not set")
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        # an empty text is refused by such services; a blank stands for it
        body = json.dumps({"model": model, "input": [t or " " for t in texts]}).encode()
        try:
            status, answered, raw = self.transport(self.url, headers, body, self.timeout)
        except (TimeoutError, OSError) as e:
            raise RetryableError(f"no answer: {type(e).__name__}") from e
        named = {k.lower(): v for k, v in answered.items()}
        what = f"status {status}" + (f", request {named['x-request-id']}" if "x-request-id" in named else "")
        if status in AGAIN or status >= 500:
            raise RetryableError(what)
        if status != 200:
            raise ProviderError(f"{what}: {_reason(raw)}")
        try:
            rows = sorted(json.loads(raw)["data"], key=lambda r: r["index"])
            return [[float(x) for x in r["embedding"]] for r in rows]
        except (ValueError, KeyError, TypeError) as e:
            raise ProviderError(f"{what}: the answer is not of the expected form") from e


def _reason(raw: bytes) -> str:
    """What an error's body says, without what else it may hold."""
    try:
        return str(json.loads(raw)["error"]["message"])[:200]
    except (ValueError, KeyError, TypeError):
        return "no reason given"


def request_tokens(text: str) -> int:
    return 8 + 4 * len(text)


def batches(texts: list[str], limits: Limits, count: Callable[[str], int] = request_tokens) -> Iterator[list[int]]:
    """Indexes of texts in greedy runs within both limits."""
    run, used = [], 0
    for i, t in enumerate(texts):
        n = count(t)
        if n > limits.tokens:
            raise TooLargeError(f"text {i} takes {n} tokens; the limit is {limits.tokens}")
        if run and (len(run) == limits.texts or used + n > limits.tokens):
            yield run
            run, used = [], 0
        run.append(i)
        used += n
    if run:
        yield run


def with_retries(call: Callable[[], list[list[float]]], attempts: int = 5, base: float = 0.5, cap: float = 8.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> list[list[float]]:
    """Calls again after retryable errors: at once, then after growing waits, 20 % jittered."""
    for n in range(attempts):
        try:
            return call()
        except RetryableError as e:
            if n == attempts - 1:
                raise ProviderError(f"gave up after {attempts} attempts") from e
            if n:
                sleep(min(cap, base * 2 ** (n - 1)) * (0.8 + 0.4 * jitter()))
    raise ProviderError("no attempts")


def embed_texts(provider: Provider, model: str, texts: list[str], limits: Limits | None = None, count: Callable[[str], int] = request_tokens) -> list[list[float]]:
    """Vectors in the order of the texts, number and dimension checked."""
    out: list[list[float]] = []
    dim = provider.dim(model)
    for run in batches(texts, limits or provider.limits, count):
        got = with_retries(lambda run=run: provider.embed(model, [texts[i] for i in run]))
        if len(got) != len(run):
            raise ProviderError(f"{len(run)} texts gave {len(got)} vectors")
        if any(len(v) != dim for v in got):
            raise ProviderError(f"a vector is not of {dim} dimensions")
        out += got
    return out


def embed(df: DataFrame, provider: Provider, model: str, key: str, text: str, limits: Limits | None = None, count: Callable[[str], int] = request_tokens) -> DataFrame:
    """key, dim, embedding of every row; partitions are the provider's concurrency."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            v = embed_texts(provider, model, [t or "" for t in b.column(1).to_pylist()], limits, count)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in v], pa.int32()), pa.array(v, pa.list_(pa.float32()))], names=[key, "dim", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, dim int, embedding array<float>")


def packed_batches(df: DataFrame, group: list[str], order: str, tokens: Column, limits: Limits) -> DataFrame:
    """request number of every row of a group: the greedy runs of batches(), native.

    A fold over the group's rows in order; groups are bounded units such as a document.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), tokens.cast("long").alias("t"))))
    kind = "struct<n:long,used:long,size:long,out:array<long>>"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(0).alias("size"), F.array().cast("array<long>").alias("out")).cast(kind)

    def add(acc: Column, r: Column) -> Column:
        new = (acc["size"] > 0) & ((acc["size"] >= limits.texts) | (acc["used"] + r["t"] > limits.tokens))
        n = acc["n"] + F.when(new, 1).otherwise(0)
        return F.struct(
            n.alias("n"), F.when(new, r["t"]).otherwise(acc["used"] + r["t"]).alias("used"), F.when(new, F.lit(1)).otherwise(acc["size"] + 1).alias("size"), F.array_append(acc["out"], n).alias("out")
        ).cast(kind)

    g = df.groupBy(*group).agg(rows.alias("rows")).withColumn("runs", F.aggregate("rows", start, add, lambda a: a["out"]))
    return g.select(*group, F.explode(F.arrays_zip("rows", "runs")).alias("z")).select(*group, F.col("z.rows.o").alias(order), F.col("z.rows.t").alias("tokens"), F.col("z.runs").alias("request"))
