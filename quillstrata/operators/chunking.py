"""Native chunking of plain text into spans with offsets, lines, tokens and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions import text as T

HANDLER, VERSION = "text", "1.0.0"


#: Pieces that one inner fold places.
RUN = 256


def _placed(pieces: Column) -> Column:
    """Each piece with its start in characters, bytes and lines.

    A fold that appends copies what it has, so pieces are placed within runs of `RUN`, runs
    after each other, and then moved to their run's start: about linear in the pieces.
    """
    place, kind = ("chars", "bytes", "lines"), "struct<chars:int,bytes:int,lines:int,body:string>"

    def fold(items: Column, widths, last: str, of: Column) -> Column:
        """Starts and ends of items of known widths, from 0."""
        zero = F.struct(*[F.lit(0).alias(c) for c in place], F.array().cast(f"array<{of}>").alias("out"))

        def add(acc: Column, item: Column) -> Column:
            here = F.struct(*[acc[c].alias(c) for c in place], item[last].alias(last) if last == "out" else item.alias(last))
            return F.struct(*[(acc[c] + w).alias(c) for c, w in zip(place, widths(item), strict=True)], F.array_append(acc["out"], here).alias("out"))

        return F.aggregate(items, zero, add)

    piece_widths = lambda x: (F.length(x), F.octet_length(x), F.length(x) - F.length(F.replace(x, F.lit("\n"))))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int")), lambda i: fold(F.slice(pieces, i * RUN + 1, F.lit(RUN)), piece_widths, "body", kind))
    moved = fold(runs, lambda r: tuple(r[c] for c in place), "out", f"struct<chars:int,bytes:int,lines:int,out:array<{kind}>>")["out"]
    return F.flatten(F.transform(moved, lambda r: F.transform(r["out"], lambda p: F.struct(*[(p[c] + r[c]).alias(c) for c in place], p["body"].alias("body")))))


def text_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part_index, chunk_id, strategy, content_text, token_count, start and end in
    characters, bytes and lines, for every span of every non-empty text.

    Spans are paragraphs if there are several, else unindented blocks if there are
    several, else the one span that is less than the text, else the whole text.
    """
    t = F.col("__text")
    base = docs.select(F.col(key), F.col(text).alias("__text")).where(F.length(t) > 0)
    base = base.withColumns({"__par": T.paragraph_pieces(t), "__ind": T.indentation_pieces(t)})
    solid = lambda col: F.size(F.filter(col, lambda x: x.rlike(r"(?U)\S")))
    flat = F.exists(F.split(t, "\n"), lambda x: x.rlike(r"(?U)^(?![ \t]).*\S"))
    strategy = (
        F.when(solid(F.col("__par")) > 1, "paragraph")
        .when(flat & (solid(F.col("__ind")) > 1), "indentation")
        .when((solid(F.col("__par")) == 1) & (F.size("__par") > 1), "paragraph")
        .otherwise("fallback")
    )
    pieces = F.when(F.col("strategy") == "paragraph", F.col("__par")).when(F.col("strategy") == "indentation", F.col("__ind")).otherwise(F.array(t))
    placed = base.withColumn("strategy", strategy).withColumn("__at", _placed(pieces))
    kept = F.when(F.col("strategy") == "fallback", F.col("__at")).otherwise(F.filter("__at", lambda p: p["body"].rlike(r"(?U)\S")))
    rows = placed.select(key, "strategy", F.posexplode(kept).alias("part_index", "p"))
    body, first = F.col("p.body"), F.col("p.lines") + 1
    inner = F.substring(body, F.lit(1), F.length(body) - 1)
    out = rows.select(
        key, "part_index", "strategy", body.alias("content_text"), T.token_estimate(body).alias("token_count"),
        F.col("p.chars").alias("char_start"), (F.col("p.chars") + F.length(body)).alias("char_end"),
        F.col("p.bytes").alias("start_byte"), (F.col("p.bytes") + F.octet_length(body)).alias("end_byte"),
        first.alias("start_line"), (first + F.length(inner) - F.length(F.replace(inner, F.lit("\n")))).alias("end_line"),
    )
    return out.withColumn("chunk_id", F.concat_ws(":", F.lit(HANDLER), F.col("start_byte").cast("string"), F.col("end_byte").cast("string")))


def with_hashes(chunks: DataFrame, handler: str = HANDLER, version: str = VERSION) -> DataFrame:
    """content_hash and content_norm_hash (null where nothing but white space is left)."""
    norm = T.normalize_lines(F.col("content_text"))
    return chunks.withColumns(
        {
            "content_hash": T.versioned_hash(version, F.col("content_text"), F.col("chunk_id"), handler),
            "content_norm_hash": F.when(norm != "", T.versioned_hash(version, norm, F.col("chunk_id"), handler)),
        }
    )
