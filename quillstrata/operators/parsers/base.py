"""What parsers give, and how they run over a DataFrame."""

from __future__ import annotations

import bisect
import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions.text import extension, shebang


@dataclass
class Symbol:
    symbol_id: str
    name: str
    kind: str
    start: int
    end: int
    parent: str | None = None
    docstring: str | None = None
    meta: dict[str, Any] = field(default_factory=dict)


@dataclass
class Chunk:
    chunk_id: str
    text: str
    start: int
    end: int
    part_index: int = 0
    symbol: str | None = None
    delegate: str | None = None
    delegate_parent: str | None = None
    meta: dict[str, Any] = field(default_factory=dict)


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    chunks: list[Chunk] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Limits:
    """Token cap (None: none; "auto": the general cap, or none for JavaScript and
    TypeScript), how tokens are counted, and which handlers are enabled (None: all)."""

    max_tokens: int | str | None = 2000
    count: Callable[[str], int] = lambda text: -(-len(text) // 4)
    general: int = 2000
    enabled: frozenset[str] | None = None

    def of(self, handler: str) -> Limits:
        """The limits of one handler, with its cap as a number or None."""
        cap = self.max_tokens
        if isinstance(cap, str):
            named = cap.strip().lower()
            cap = int(named) if named.isdigit() else None if handler in ("javascript", "typescript") else self.general
        return replace(self, max_tokens=cap if cap is None or cap > 0 else None)

    def may_delegate(self, handler: str) -> bool:
        return self.enabled is None or handler in self.enabled


class Places:
    """Bytes and lines of character offsets."""

    def __init__(self, text: str):
        self.text = text
        self.plain = text.isascii()
        self.lines = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        self.bytes = None
        if not self.plain:
            self.bytes, total = [0], 0
            for c in text:
                total += len(c.encode())
                self.bytes.append(total)

    def byte(self, char: int) -> int:
        return char if self.plain else self.bytes[char]

    def line(self, char: int) -> int:
        return bisect.bisect_right(self.lines, char)

    def span(self, start: int, end: int) -> dict[str, int]:
        return {"start_line": self.line(start), "end_line": self.line(max(start, end - 1))}


Parser = Callable[[str, str, Limits], Parsed]
_PARSERS: dict[str, Parser | str] = {
    "markdown": "quillstrata.operators.parsers.markdown:parse",
    "html": "quillstrata.operators.parsers.html:parse",
    "css": "quillstrata.operators.parsers.css:parse",
    "python": "quillstrata.operators.parsers.python:parse",
    "javascript": "quillstrata.operators.parsers.javascript:parse_js",
    "typescript": "quillstrata.operators.parsers.javascript:parse_ts",
}
#: Handlers of file suffixes and interpreters.
HANDLER_SUFFIXES = {
    "text": "txt log ini toml cfg",
    "markdown": "md markdown mdown mkdn mkd",
    "python": "py pyw pyi",
    "javascript": "js cjs mjs jsx",
    "typescript": "ts tsx cts mts",
    "html": "html htm",
    "css": "css scss less",
}
HANDLER_INTERPRETERS = {"python": "python python3 python2", "javascript": "node"}
SUFFIXES = {suffix: handler for handler, listed in HANDLER_SUFFIXES.items() for suffix in listed.split()}
INTERPRETERS = {name: handler for handler, listed in HANDLER_INTERPRETERS.items() for name in listed.split()}


def register(name: str, parser: Parser | str) -> None:
    """Adds a parser: a function, or `module:attribute`, looked up where it runs."""
    _PARSERS[name] = parser


def adopt(parsers: dict[str, Parser | str]) -> None:
    """Takes the driver's registrations over in a worker."""
    _PARSERS.update(parsers)


def lookup(name: str) -> Parser:
    p = _PARSERS[name]
    if isinstance(p, str):
        module, _, attribute = p.partition(":")
        p = getattr(importlib.import_module(module), attribute)
    return p


def resolve(path: Column, text: Column, explicit: Column | None = None, override: Column | None = None, enabled: set[str] | None = None) -> tuple[Column, Column]:
    """The handler of a file and why: explicit, override, shebang, suffix, default; one
    that is not enabled falls back to text."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by = {"explicit": explicit, "override": override, "shebang": F.try_element_at(table(INTERPRETERS), shebang(text)), "extension": F.try_element_at(table(SUFFIXES), extension(path)), "default": F.lit("text")}
    given = {k: v for k, v in by.items() if v is not None}
    handler = F.coalesce(*given.values())
    reason = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in given.items()])
    if enabled is not None:
        on = handler.isin(sorted(enabled | {"text"}))
        return F.when(on, handler).otherwise("text"), F.when(on, reason).otherwise("fallback")
    return handler, reason


def split_lines(text: str, limits: Limits, joined: bool = False) -> list[tuple[int, int]]:
    """Greedy runs of whole lines within the cap; a longer line stands alone.  A run's
    tokens are the sum over its lines, or, with `joined`, those of the run as a whole."""
    if limits.max_tokens is None or limits.count(text) <= limits.max_tokens:
        return [(0, len(text))]
    out, start, at, used = [], 0, 0, 0
    for line in text.splitlines(keepends=True):
        n = limits.count(line)
        if used and (limits.count(text[start : at + len(line)]) if joined else used + n) > limits.max_tokens:
            out.append((start, at))
            start, used = at, 0
        at += len(line)
        used += n
    return [*out, (start, at)] if at > start else out


SCHEMA = (
    "key string, handler string, symbols array<struct<symbol_id:string,name:string,kind:string,start_byte:long,end_byte:long,parent:string,docstring:string,metadata_json:string>>, "
    "chunks array<struct<chunk_id:string,content_text:string,token_count:int,start_byte:long,end_byte:long,part_index:int,symbol:string,delegate:string,delegate_parent:string,start_line:int,end_line:int,metadata_json:string>>, "
    "warnings array<string>, errors array<string>"
)


def canonical(meta: dict[str, Any]) -> str | None:
    kept = {k: v for k, v in meta.items() if v is not None}
    return json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if kept else None


def run_one(handler: str, path: str, raw: bytes | str | None, limits: Limits = Limits()) -> Parsed:  # noqa: B008
    """A file through a parser; bad UTF-8, unknown handlers and whatever a parser fails
    with become errors of this file alone."""
    if isinstance(raw, (bytes, bytearray)):
        try:
            raw = bytes(raw).decode()
        except UnicodeDecodeError as e:
            return Parsed(errors=[f"not UTF-8: {e.reason} at {e.start}"])
    if not raw:
        return Parsed()
    if handler not in _PARSERS:
        return Parsed(errors=[f"unknown handler {handler}"])
    try:
        return lookup(handler)(path, raw, limits.of(handler))
    except Exception as e:  # MemoryError of a too deep expression among them
        return Parsed(errors=[f"{type(e).__name__}: {e}"])


#: Characters of results (an item counts ITEM of them besides its text) that go to the JVM at once.
RUN, ITEM = 1 << 20, 200


def parse(files: DataFrame, handler: str | Column, key: str, path: str, content: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """key, handler, symbols, chunks, warnings, errors of every file; a file's rows stay
    in one row, so nothing is shuffled.  Files are taken one by one and results leave in
    runs, so that a worker holds about one input batch and one run, however many files."""
    name = F.lit(handler) if isinstance(handler, str) else handler
    slim = files.select(F.col(key).cast("string").alias("key"), name.alias("handler"), F.col(path).alias("path"), F.col(content).alias("content"))
    schema = arrow_schema()
    known = dict(_PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adopt(known)
        rows, held = [], 0
        for b in batches:
            for i in range(b.num_rows):
                k, h, p, t = (c[i].as_py() for c in b.columns)
                got = run_one(h, p or "", t, limits)
                rows.append(
                    {
                        "key": k, "handler": h, "warnings": got.warnings, "errors": got.errors,
                        "symbols": [{"symbol_id": s.symbol_id, "name": s.name, "kind": s.kind, "start_byte": s.start, "end_byte": s.end, "parent": s.parent, "docstring": s.docstring, "metadata_json": canonical(s.meta)} for s in got.symbols],
                        "chunks": [
                            {"chunk_id": c.chunk_id, "content_text": c.text, "token_count": limits.count(c.text), "start_byte": c.start, "end_byte": c.end, "part_index": c.part_index, "symbol": c.symbol, "delegate": c.delegate,
                             "delegate_parent": c.delegate_parent, "start_line": c.meta.get("start_line"), "end_line": c.meta.get("end_line"), "metadata_json": canonical(c.meta)} for c in got.chunks
                        ],
                    }
                )
                held += sum(len(c.text) + ITEM for c in got.chunks) + ITEM * (len(got.symbols) + 1)
                if held >= RUN:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return slim.mapInArrow(run, SCHEMA)


def arrow_schema() -> pa.Schema:
    s, i, n = pa.string(), pa.int32(), pa.int64()
    symbol = pa.struct([("symbol_id", s), ("name", s), ("kind", s), ("start_byte", n), ("end_byte", n), ("parent", s), ("docstring", s), ("metadata_json", s)])
    chunk = pa.struct([("chunk_id", s), ("content_text", s), ("token_count", i), ("start_byte", n), ("end_byte", n), ("part_index", i), ("symbol", s), ("delegate", s), ("delegate_parent", s), ("start_line", i), ("end_line", i), ("metadata_json", s)])
    return pa.schema([("key", s), ("handler", s), ("symbols", pa.list_(symbol)), ("chunks", pa.list_(chunk)), ("warnings", pa.list_(s)), ("errors", pa.list_(s))])


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("key", "handler", F.explode("symbols").alias("s")).select("key", "handler", "s.*")


def chunks(parsed: DataFrame) -> DataFrame:
    return parsed.select("key", "handler", F.explode("chunks").alias("c")).select("key", "handler", "c.*")
