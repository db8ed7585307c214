"""Token counts by the vocabulary file of a public tokenizer, or by the estimate.

An encoder is named by the path of its file, which workers read on first use: `.json`
(tokenizers), `.tiktoken` ranks (tiktoken) or `.model` (sentencepiece).  Without a path,
or where the library is not installed and `strict` is off, a token is a quarter of the
characters, rounded up.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: how byte-level tokenizers of the GPT-2 kind split a text.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, Callable[[str], int]] = {}


class EncoderError(RuntimeError):
    """An encoder that cannot be loaded."""


def estimate(text: str) -> int:
    return -(-len(text) // 4)


def _load(path: str, split: str) -> Callable[[str], int]:
    kind = Path(path).suffix
    if kind == ".json":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    if kind == ".tiktoken":
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        e = tiktoken.Encoding(Path(path).stem, pat_str=split, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(e.encode_ordinary(text))
    if kind == ".model":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(p.encode(text))
    raise EncoderError(f"{path} is of no known kind")


@dataclass(frozen=True)
class Encoder:
    """Counts tokens; it is callable, so it fits wherever a count of tokens is asked for
    (Limits.count of parsers, `count` of request batches)."""

    path: str | None = None
    strict: bool = True
    split: str = SPLIT

    def __call__(self, text: str) -> int:
        if self.path is None:
            return estimate(text)
        if self.path not in _LOADED:
            try:
                _LOADED[self.path] = _load(self.path, self.split)
            except (ImportError, OSError, ValueError) as e:
                if self.strict:
                    raise EncoderError(f"{self.path}: {e}") from e
                _LOADED[self.path] = estimate
        return _LOADED[self.path](text)


def counted(df: DataFrame, text: str, encoder: Encoder, name: str = "tokens") -> DataFrame:
    """df with the number of tokens of a text column; null for null."""
    columns = [c for c in df.columns if c != name]
    slim = df.select(*[df[f"`{c}`"] for c in columns])
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [None if t is None else encoder(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*columns, name])

    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField(name, T.LongType())]))
