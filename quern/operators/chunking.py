"""Documents to overlapping, deterministically keyed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.fixed import CHUNK_OVERLAP, CHUNK_SIZE
from quern.functions.text import overlap_parts, split_text, whole_piece_chunks
from quern.operators.spread import running_offset


def with_doc_id(df: DataFrame, path_col: str = "source") -> DataFrame:
    """Adds `doc_hash`, the MD5 of the path (not of the content)."""
    return df.withColumn("doc_hash", F.md5(F.col(path_col)))


def with_chunk_id(
    df: DataFrame, doc_col: str = "doc_hash", idx_col: str = "chunk_index"
) -> DataFrame:
    return df.withColumn("chunk_id", F.concat_ws("_", F.col(doc_col), F.col(idx_col).cast("string")))


def _chunk(
    df: DataFrame, keep: list[str], text_col: str, size: int, overlap: int, boundary: bool, ends: bool = False,
    pieces: bool = False,
) -> DataFrame:
    if pieces:
        parts = df.select(*keep, whole_piece_chunks(F.col(text_col), size, overlap).alias("_parts"))
        texts = F.col("_parts")
    else:
        parts = df.select(*keep, split_text(F.col(text_col), size, overlap, boundary).alias("_parts"))
        texts = overlap_parts(F.col("_parts"), overlap)
    if ends:
        none = F.array(F.lit(None).cast("string"))
        texts = F.coalesce(F.concat(texts, none), none)
    chunks = parts.select(*keep, F.posexplode(texts).alias("_pos", "text_content"))
    return chunks.select(*keep, F.col("_pos").cast("int").alias("chunk_index"), "text_content")


def chunk_fixed(
    df: DataFrame,
    id_col: str,
    text_col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Windows of `size` characters, each starting `size - overlap` after the last."""
    return _chunk(df, [id_col], text_col, size, overlap, boundary=False)


def chunk_boundary(
    df: DataFrame,
    id_col: str,
    text_col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """As `chunk_fixed`, but the cut moves back to a newline, else a blank."""
    return _chunk(df, [id_col], text_col, size, overlap, boundary=True)


def chunk_pieces(
    df: DataFrame,
    id_col: str,
    text_col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of whole paragraphs where these fit, else of lines, words, characters.

    The overlap is of whole pieces too, so it may be less than `overlap`, or none. A null
    text has no chunks, an empty one a single empty chunk.
    """
    return _chunk(df, [id_col], text_col, size, overlap, boundary=False, pieces=True)


def chunk_table(
    df: DataFrame,
    path_col: str,
    text_col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    boundary: bool = False,
    keep: tuple[str, ...] = (),
    ends: bool = False,
    pieces: bool = False,
) -> DataFrame:
    """Documents to rows of the chunk table. No shuffle: one pass over the texts.

    Cuts lie at fixed places, or with `boundary` at line ends and blanks, or with `pieces`
    where `chunk_pieces` has them.

    With `ends`, a row without a text follows each document's last chunk; that of a
    document without chunks is its only one.
    """
    named = df.withColumn("source", F.col(path_col))
    chunks = _chunk(named, ["source", *keep], text_col, size, overlap, boundary, ends, pieces)
    return with_chunk_id(with_doc_id(chunks)).select(
        "chunk_id", "source", "doc_hash", "chunk_index", "text_content", *keep
    )


def chunk_multipart(
    df: DataFrame,
    file_col: str,
    part_col: str,
    text_col: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    boundary: bool = False,
) -> DataFrame:
    """Parts are chunked apart and numbered through the whole file.

    Each part's first number is a running total of the chunk counts before it,
    so only one row per part is ordered, in blocks, and never the chunks.
    """
    parts = df.select(
        file_col, part_col, split_text(F.col(text_col), size, overlap, boundary).alias("_parts")
    ).withColumn("_n", F.size("_parts"))
    placed = running_offset(parts, [file_col], part_col, "_n", "_first")
    return placed.select(
        file_col,
        part_col,
        "_first",
        F.posexplode(overlap_parts(F.col("_parts"), overlap)).alias("_pos", "text_content"),
    ).select(
        file_col,
        part_col,
        (F.col("_first") + F.col("_pos")).cast("int").alias("chunk_index"),
        "text_content",
    )


def chunk_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunks, characters and longest chunk, per `by` or over the run."""
    size = F.length("text_content")
    return chunks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(size).cast("bigint").alias("characters"),
        F.max(size).alias("longest"),
    )
