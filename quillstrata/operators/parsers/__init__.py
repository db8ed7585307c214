"""Structure parsers: one file gives symbols and chunks.  A parser is a plain function
(path, text, limits) -> Parsed; `parse` runs one over a table of files."""

from quillstrata.operators.parsers.base import Chunk, Parsed, Symbol, parse, register, resolve  # noqa: F401
