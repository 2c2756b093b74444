"""Text expressions: chunk splitting, markup removal, words."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.fixed import CHUNK_OVERLAP, CHUNK_SIZE

# What runs in tasks travels inside them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD_PATTERN = r"[\p{L}\p{N}_]+"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _fixed_pattern(size: int, overlap: int) -> str:
    # The new characters each chunk brings: `size` at first, then `size - overlap`.
    return rf"(?s)\A.{{0,{size}}}|.{{1,{size - overlap}}}"


def _boundary_pattern(size: int, overlap: int) -> str:
    # As above, but a chunk that is not the last ends after the last newline,
    # else after the last blank, in the second half of its window.
    low, step = size // 2, size - overlap
    return (
        rf"(?s)\A.{{0,{size}}}\z"
        rf"|\A.{{{low},{size}}}(?<=\n)|\A.{{{low},{size}}}(?<= )|\A.{{{size}}}"
        rf"|.{{1,{step}}}\z"
        rf"|.{{{low - overlap},{step}}}(?<=\n)|.{{{low - overlap},{step}}}(?<= )|.{{{step}}}"
    )


def split_text(
    text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, boundary: bool = False
) -> Column:
    """The parts of a text that are new in each chunk, in order.

    Joining the parts gives back the text. One regular expression walks the text
    once, so a long text costs time in proportion to its length, where a
    `substring` per chunk would start again from the first byte each time.
    """
    if overlap < 0 or size < 4 * max(overlap, 1):
        raise ValueError("size must be at least four times the overlap")
    pattern = (_boundary_pattern if boundary else _fixed_pattern)(size, overlap)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def overlap_parts(parts: Column, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks from parts: each starts with the last `overlap` characters before it."""
    return F.transform(
        parts,
        lambda part, i: F.concat(
            F.when(i > 0, F.substring(F.get(parts, i - 1), -overlap, overlap)).otherwise(""), part
        ),
    )


def text_pieces(text: Column, size: int = CHUNK_SIZE) -> Column:
    """A text cut where it hangs together least, into pieces of `size` characters or less.

    Paragraphs, each with the blank lines after it; of a paragraph that is too long its
    lines; of such a line its words; of such a word runs of characters. Joining the
    pieces gives back the text.
    """
    def finer(parts: Column, split) -> Column:
        return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(split(p))))

    def by(pattern: str):
        return lambda p: F.regexp_extract_all(p, F.lit(pattern), F.lit(0))

    runs = by(rf"(?s).{{1,{size}}}")
    words_of = lambda line: finer(by(r"[^ ]* +|[^ ]+")(line), runs)
    lines_of = lambda paragraph: finer(by(r"[^\n]*\n+|[^\n]+")(paragraph), words_of)
    return finer(by(r"(?s).+?(?:\n{2,}|\z)")(text), lines_of)


def piece_runs(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Which pieces make up each chunk, as (first, number): as many as fit into `size`.

    A chunk begins with the last pieces of the one before, as many as `overlap` holds
    and leave room for the next piece. Each piece is added and dropped once.
    """
    first, total, out = 0, 0, []
    for i, n in enumerate(lengths):
        if total + n > size:
            out.append((first, i - first))
            while total > overlap or total + n > size:
                total -= lengths[first]
                first += 1
        total += n
    return [*out, (first, len(lengths) - first)]


def whole_piece_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """The chunks of a text made of whole pieces of it; an empty text is one empty chunk.

    Only the lengths of the pieces leave the JVM: a running choice that drops from the
    front has no built-in form that takes time in proportion to the pieces.
    """
    @F.arrow_udf("array<struct<first: int, n: int>>")
    def runs(lengths: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        rows = (None if x is None else [{"first": f + 1, "n": n} for f, n in piece_runs(x, size, overlap)] for x in lengths.to_pylist())
        return pa.array(rows, kind)

    pieces = text_pieces(text, size)
    return F.transform(
        F.array(F.struct(pieces.alias("pieces"), runs(F.transform(pieces, F.length)).alias("runs"))),
        lambda t: F.transform(t["runs"], lambda r: F.array_join(F.slice(t["pieces"], r["first"], r["n"]), "")),
    )[0]


def strip_markup(html: Column) -> Column:
    """Comments, script and style bodies out, then tags, entities decoded, blanks folded."""
    blank = F.lit(" ")
    bodies = F.regexp_replace(
        F.regexp_replace(html, F.lit(r"(?s)<!--.*?-->"), blank),
        F.lit(r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"),
        blank,
    )
    tags = F.regexp_replace(bodies, F.lit(r"<[^>]*>"), blank)
    return F.trim(F.regexp_replace(decode_entities(tags), F.lit(r"[ \t\r\n\f]+"), blank))


def decode_entities(text: Column) -> Column:
    """`&amp;` and its kind, and numbered characters, as what they stand for.

    One walk over the text, so what an entity leaves is not decoded again. Numbers
    that are no character stay as they are.
    """
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    pattern = rf"&(?:{'|'.join(ENTITIES)}|#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});|[^&]+|&"

    def decoded(piece: Column) -> Column:
        name = F.substring(piece, 2, F.length(piece) - 2)
        hexed = F.lower(F.substring(name, 2, 1)) == "x"
        number = F.when(hexed, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7))
        code = number.cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        entity = piece.startswith("&") & (F.length(piece) > 1)
        return (
            F.when(~entity, piece)
            .when(~name.startswith("#"), F.try_element_at(names, name))
            .when(known, char)
            .otherwise(piece)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), decoded), "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def strip_sql_literals(text: Column) -> Column:
    """Query text without quoted literals and `--` comments."""
    return F.regexp_replace(text, F.lit(r"'[^']*'|--[^\n]*"), F.lit(" "))


def year_pair(text: Column) -> tuple[Column, Column]:
    """The two years of a period text such as `2024 vs 2023`, as INT or null."""
    pattern = r"(\d{4})\s+vs\.?\s+(\d{4})"
    one = F.regexp_extract(text, pattern, 1)
    two = F.regexp_extract(text, pattern, 2)
    as_year = lambda c: F.when(c != "", c).cast("int")
    return as_year(one), as_year(two)
