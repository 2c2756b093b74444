"""Conversations as training text, assembled column by column.

A turn becomes `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside roles and texts a backslash
goes before every backslash and into every control string, after its first byte, and
before line breaks in roles: no control string of any listed template is left in what
a speaker said, and dropping each backslash that goes before a byte gives back the
exact text.

For a batch of turns NumPy finds the bytes to escape, the length of every segment, the
offset of each from running sums, and from these the place of every byte. Markers and
contents are then copied into one buffer, which becomes an Arrow column as it is.

A turn carries its own markers, so a formatted conversation is its parts one after the
other, and a conversation of any length is formatted by many tasks: turns are dealt
out by ranges of conversation and turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import body, prepared, table

OPEN, LINE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Strings that steer a model in this template or in other common ones. None starts
#: within itself or another.
CONTROLS = (
    b"<|im_start|>", b"<|im_end|>", b"<|endoftext|>", b"<|startoftext|>", b"<|system|>", b"<|user|>",
    b"<|assistant|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>",
)
LEARNT = b"assistant"
#: Bytes assembled in one go; a longer turn goes alone.
BLOCK_BYTES = 1 << 26
_ESC = 0x5C

_turn = re.compile(rb"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_escaped = re.compile(rb"\\(.)", re.DOTALL)


def unescape(data: bytes) -> bytes:
    return _escaped.sub(rb"\1", data)


@dataclass
class _Column:
    """Byte strings one after the other, and the bytes that need a backslash before."""

    data: np.ndarray
    start: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, controls: Sequence[bytes], lines: bool) -> _Column:
        column = pa.array(column, pa.binary()) if not pa.types.is_binary(column.type) else column
        _, offsets, data = column.buffers()
        start = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8)[start[0]:start[-1]] if data is not None else np.zeros(0, np.uint8)
        start = start - start[0]
        before = data == _ESC
        if lines:
            before |= data == 0x0A
        for control in controls:
            at = np.flatnonzero(data[:len(data) - len(control) + 1] == control[0])
            for i, byte in enumerate(control[1:], 1):
                at = at[data[at + i] == byte]
            end = start[np.searchsorted(start, at, "right")] if len(at) else at
            before[at[at + len(control) <= end] + 1] = True
        return cls(data, start, before)

    def __post_init__(self):
        self.extra = np.concatenate([[0], np.cumsum(self.before)])

    @property
    def sizes(self) -> np.ndarray:
        """Length of each string with its backslashes."""
        return np.diff(self.start + self.extra[self.start])

    def copy(self, out: np.ndarray, to: np.ndarray) -> None:
        """Scatter the strings to the offsets `to` of `out`."""
        shift = np.repeat(to - self.start[:-1] - self.extra[self.start[:-1]], np.diff(self.start))
        at = shift + np.arange(len(self.data)) + self.extra[1:]
        out[at] = self.data
        out[at[self.before] - 1] = _ESC


def _mark(out: np.ndarray, to: np.ndarray, marker: bytes) -> None:
    out[(to[:, None] + np.arange(len(marker))).ravel()] = np.tile(np.frombuffer(marker, np.uint8), len(to))


def assemble(roles: pa.Array, texts: pa.Array, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, joined between the row numbers `cuts`; and per turn where
    its text begins and ends, in bytes from the begin of its part."""
    role, text = _Column.of(roles, CONTROLS, True), _Column.of(texts, CONTROLS, False)
    sizes = len(OPEN) + role.sizes + len(LINE) + text.sizes + len(CLOSE)
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(start[-1], np.uint8)
    at_role = start[:-1] + len(OPEN)
    at_line = at_role + role.sizes
    at_text = at_line + len(LINE)
    at_close = at_text + text.sizes
    _mark(out, start[:-1], OPEN)
    _mark(out, at_line, LINE)
    _mark(out, at_close, CLOSE)
    role.copy(out, at_role)
    text.copy(out, at_text)
    offsets = start[cuts]
    joined = pa.Array.from_buffers(
        pa.string(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    begin = np.repeat(offsets[:-1], np.diff(cuts))
    return joined, at_text - begin, at_close - begin


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(r.as_buffer()) + 2 * len(t.as_buffer()) for r, t in zip(batch.column(2), batch.column(3))])
    group = np.cumsum(sizes) // BLOCK_BYTES
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-2))
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield batch.slice(lo, hi - lo)


def format_conversations(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, first_turn, part, turns, formatted, loss) for the turns in order.

    A conversation's parts in the order of (first_turn, part) are its formatted text;
    `loss` lists the byte ranges of assistant texts within a part. Turns go by `turn`,
    nulls first, equal ones by role and text, repeated ones all. Null roles and texts
    are empty ones; a null id is a conversation of its own. No turns give no parts.
    """
    prepared(turns.sparkSession)
    given = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        body(F.col(role_col)).alias("role"), body(F.col(text_col)).alias("text"))
    dealt = given.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in (part for whole in batches for part in _slices(whole)):
            ids = batch.column(0).to_pylist()
            cuts = np.array([0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)])
            formatted, begin, end = assemble(batch.column(2), batch.column(3), cuts)
            learnt = [r.as_py() == LEARNT for r in batch.column(2)]
            spans = [[{"begin": int(begin[i]), "end": int(end[i])} for i in range(lo, hi) if learnt[i]]
                     for lo, hi in zip(cuts[:-1], cuts[1:])]
            first, n = pa.array(cuts[:-1]), len(cuts) - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(first), batch.column(1).take(first), pa.array(range(done, done + n), pa.int64()),
                pa.array(np.diff(cuts), pa.int64()), formatted, pa.array(spans, span),
            ], names=["conv_id", "first_turn", "part", "turns", "formatted", "loss"])
            done += n

    schema = T.StructType([T.StructField("conv_id", given.schema["conv_id"].dataType)])
    for name, kind in (("first_turn", "long"), ("part", "long"), ("turns", "long"), ("formatted", "string"),
                       ("loss", "array<struct<begin: long, end: long>>")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return dealt.mapInArrow(run, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """What formatted conversations say: per conversation its turns, digests and sizes.

    A digest is of the whole conversation in order, so its parts, which hold many
    turns each, meet in one task; they stream through it and none is kept.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([T.StructField("conv_id", parts.schema["conv_id"].dataType)])
    for name, kind in zip(names[1:], ("long", "string", "long", "string", "long")):
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def ended() -> list:
            return [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]

        for batch in batches:
            rows = []
            for conv, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(ended())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in _turn.finditer(formatted):
                    now[1] += 1
                    now[2].update(unescape(turn[1]) + b"\n" + unescape(turn[2]) + b"\n")
                for at in loss:
                    text = unescape(formatted[at["begin"]:at["end"]])
                    now[3] += len(text.decode())
                    now[4].update(text)
                now[5] += len(formatted.decode())
            yield _rows(rows, names, batch.column(0).type)
        if now is not None:
            yield _rows([ended()], names, kind)

    kind = _arrow_type(parts.schema["conv_id"].dataType)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "part")
    return ordered.select("conv_id", body(F.col("formatted")).alias("formatted"), "loss").mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _rows(rows: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    prepared(spark)
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    return read_back(format_conversations(given.unionByName(own)))
