"""Column helpers for text: hashes, tokens, offsets, normal forms, spans.

Characters are Unicode code points, as Spark's length() counts them; white space is
the Unicode class of the regular expression flag (?U), which lacks U+001C to U+001F.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _bytes(col: Column | str) -> Column:
    return F.encode(F.lit(col) if isinstance(col, str) else col, "utf-8")


def versioned_hash(version: Column | str, text: Column, *extra: Column | str, binary: bool = False) -> Column:
    """sha256 of version, each extra and the content, with a zero byte after all but the last."""
    zero = F.unhex(F.lit("00"))
    parts = []
    for p in (version, *extra):
        parts += [_bytes(p), zero]
    return F.sha2(F.concat(*parts, text if binary else _bytes(text)), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for the empty text."""
    return F.ceil(F.length(text) / 4).cast("int")


def request_tokens(text: Column) -> Column:
    """What a provider request is taken to cost without a tokenizer."""
    return F.lit(8) + F.length(text) * 4


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_lines(text: Column) -> Column:
    """Line ends as \\n, white space around the text gone."""
    return strip(F.regexp_replace(text, "\r\n?", "\n"))


def normalize_sql(text: Column) -> Column:
    """Line ends as \\n, lines without trailing white space, none at either end but one
    line end after the last line; the empty text stays empty."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    whole = strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"))
    return F.when(whole == "", whole).otherwise(F.concat(whole, F.lit("\n")))


def sql_checksum(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_bytes(normalize_sql(text)), 256))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_markup(text: Column) -> Column:
    """Line ends trimmed, blank lines at either end gone."""
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return F.regexp_replace(lines, r"^\n+|\n+$", "")


def byte_offset(text: Column, chars: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), chars))


def char_of_byte(text: Column, byte: Column) -> Column:
    """The 0-based character that begins at a byte of the text (of one within a character:
    the next)."""
    return F.length(F.substring(text.cast("binary"), F.lit(1), byte).cast("string"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def shebang(text: Column) -> Column:
    """Base name of the interpreter in a #! line, in lower case; `env X` gives X."""
    line = F.regexp_extract(text, r"^#!\s*([^\n]*)", 1)
    words = F.split(F.trim(line), r"\s+")
    first = F.regexp_extract(F.get(words, F.lit(0)), r"([^/]*)$", 1)
    return F.lower(F.when((first == "env") & (F.size(words) > 1), F.regexp_extract(F.get(words, F.lit(1)), r"([^/]*)$", 1)).otherwise(first))


def module_name(path: Column) -> Column:
    """Dotted path without the last suffix."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"^/+|/+$", ""), F.lit("/"), F.lit("."))


def delegated_chunk_id(delegate: Column, parent: Column, component: Column, start: Column, end: Column, marker: Column | None = None) -> Column:
    parts = [delegate, F.lit("delegate"), parent, F.replace(component, F.lit(":"), F.lit("-")), start.cast("string"), end.cast("string")]
    return F.concat_ws(":", *parts, *([marker.cast("string")] if marker is not None else []))


def export_names(specifier: Column) -> tuple[Column, Column]:
    """`a as b`: the local and the exported name."""
    parts = F.split(F.trim(specifier), r"\s+as\s+")
    return F.get(parts, F.lit(0)), F.element_at(parts, -1)


def extends_clause(header: Column) -> Column:
    return F.trim(F.regexp_extract(header, r"(?s)\bextends\b(.*?)(?:\{|$)", 1))


def front_matter(text: Column) -> Column:
    """Leading block between --- lines, closing line included; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\A(---[ \t]*\n.*?\n---[^\n]*(?:\n|\z))", 1)


def paragraph_pieces(text: Column) -> Column:
    """The text cut after every blank-line separator; blank pieces are kept as gaps."""
    cut = F.filter(F.regexp_extract_all(text, F.lit(r"(?sU)(.*?(?:\n\s*\n|\z))"), F.lit(1)), lambda x: x != "")
    return F.when(text.rlike(r"(?U)\n\s*\n"), cut).otherwise(F.array(text))


def indentation_pieces(text: Column) -> Column:
    """The text cut before every unindented line that is not blank, the first aside."""
    parts = F.split(text, r"(?U)(?<=\n)(?![ \t])(?=[^\n]*\S)")
    lead = ~F.get(parts, F.lit(0)).rlike(r"(?U)\S")
    joined = F.concat(F.array(F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))
    return F.when(lead & (F.size(parts) > 1), joined).otherwise(parts)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and no nulls; null where nothing is left."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.when(body != "{}", body)


def lenient_int(text: Column) -> Column:
    """The whole number, or null where the text is none."""
    return F.trim(text).try_cast("bigint")
