"""Byte-level BPE encoding and decoding with a local tiktoken rank file.

Long texts are cut only where the pre-tokeniser must cut as well, between a
character that is not white space and one that is, and the library encodes each
piece, so neither time nor stack grows faster than the text.  White-space runs
long enough to overflow the library's regex engine are
resolved by the pattern's own rule.  Decoding joins raw token bytes, so ids
that split a character still give back the exact bytes.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer texts are cut into pieces of about this many characters.
PIECE_CHARS = 50_000
#: The pattern's white space (Python's also holds U+001C to U+001F).
_WHITE = r"[^\S\x1c-\x1f]"
#: A safe boundary: white space follows something else.
_SAFE = re.compile(rf"(?<=\S)(?={_WHITE})")
#: White-space runs from this length on would overflow the library's regex engine.
_LONG_SPACE = re.compile(_WHITE + r"{2000,}")
OUT_BYTES = 16 << 20
_CODECS: dict[int, Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a tiktoken rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Codec:
    """Encodes ordinary text (no special tokens) to packed little-endian unsigned 32-bit ids, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # The core, without the wrapper's retry for lone surrogates: Spark's strings have none.
        self.core = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _long_run(self, text: str) -> bytes:
        """A text with a very long white-space run.

        By the pattern a run before other text is one match up to its last character; that character joins what
        follows.  A run at the end is one match.
        """
        out, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            out.append(_packed(self.core.encode_ordinary(text[at : run.start()])))
            at = run.end() if run.end() == len(text) else run.end() - 1
            out.append(_packed(self.core.encode_single_piece(text[run.start() : at].encode())))
        return b"".join([*out, _packed(self.core.encode_ordinary(text[at:]))])

    def encode(self, text: str) -> bytes:
        if len(text) <= PIECE_CHARS:
            return _packed(self.core.encode_ordinary(text))
        out, at = [], 0
        while at < len(text):
            cut = _SAFE.search(text, at + PIECE_CHARS)
            end = cut.end() if cut else len(text)
            piece = text[at:end]
            out.append(self._long_run(piece) if _LONG_SPACE.search(piece) else _packed(self.core.encode_ordinary(piece)))
            at = end
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return self.core.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _codec(ranks: bytes, pattern: str) -> Codec:
    key = hash((ranks, pattern))
    if key not in _CODECS:
        table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
        _CODECS[key] = Codec(table, pattern)
    return _CODECS[key]


def _mapped(df: DataFrame, column: str, extra: list[T.StructField], work) -> DataFrame:
    """Appends columns that ``work`` makes from each value, in output batches of bounded bytes."""
    names = {x.name for x in extra}
    keep = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + extra)
    source = column if column in keep else "__source__"  # a text that passes through is sent once
    df = df.select(*[F.col(f"`{c}`") for c in keep], *([] if column in keep else [F.col(f"`{column}`").alias(source)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            kept = batch.select(keep)
            made, begin, size = [], 0, 0
            for i, value in enumerate(batch.column(source)):
                made.append(step(value.as_py()))
                size += sum(len(x) for x in made[-1] if isinstance(x, bytes))
                if size >= OUT_BYTES:
                    yield _joined(kept.slice(begin, i + 1 - begin), made, extra)
                    made, begin, size = [], i + 1, 0
            if made:
                yield _joined(kept.slice(begin), made, extra)

    return df.mapInArrow(run, schema)


def _joined(kept: pa.RecordBatch, made: list[tuple], extra: list[T.StructField]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    columns = [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*made, strict=True), extra, strict=True)]
    return pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*kept.schema.names, *[f.name for f in extra]])


def encode(df: DataFrame, rank_path: str, pattern: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit), and with ``decoded`` the bytes they decode to.

    Null and empty texts give no ids.  Other columns pass through; input columns with the names of added ones are
    replaced.  The rank file, of a fixed size, is read once on the driver and travels with the tasks.
    """
    with open(rank_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    extra += [T.StructField("decoded", T.BinaryType())] if decoded else []

    def work():
        codec = _codec(shipped.value, pattern)

        def step(text: str | None) -> tuple:
            ids = codec.encode(text or "")
            return (len(ids) // 4, ids, codec.decode(ids)) if decoded else (len(ids) // 4, ids)

        return step

    return _mapped(df, column, extra, work)


def decode(df: DataFrame, rank_path: str, pattern: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``, the raw bytes of packed ids; null ids give empty bytes."""
    with open(rank_path, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def work():
        codec = _codec(shipped.value, pattern)
        return lambda ids: (codec.decode(ids or b""),)

    return _mapped(df, column, [T.StructField("decoded", T.BinaryType())], work)
