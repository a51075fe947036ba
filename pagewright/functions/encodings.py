"""Bytes of text files to strings (T1): by byte order mark, else UTF-8, Korean, Latin-1."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte order marks and what they mean, then the encodings that are tried in turn.
MARKS = {codecs.BOM_UTF8: "utf-8", codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"}
TRIED = ("utf-8", "cp949", "euc-kr", "latin-1")


def decode(data: bytes, encoding: str | None = None) -> tuple[str, str]:
    """(text, encoding); an encoding that is given is tried first."""
    for mark, name in MARKS.items():
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    for name in ((encoding,) if encoding else ()) + TRIED:
        try:
            return data.decode(name), name
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("latin-1"), "latin-1"


@F.pandas_udf(T.StringType())
def _other(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else decode(bytes(c))[0])


def text_of(content: Column) -> Column:
    """The text of a binary column; only what is neither marked nor UTF-8 leaves the JVM."""
    whole, head = content.cast("string"), F.hex(F.substring(content, 1, 3))
    marked = F.when(head == "EFBBBF", F.substring(content, 4, 2147483647).cast("string"))
    marked = marked.when(head.startswith("FFFE"), F.decode(F.substring(content, 3, 2147483647), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(F.substring(content, 3, 2147483647), "UTF-16BE"))
    plain = F.is_valid_utf8(whole)
    odd = ~plain & ~head.startswith("FFFE") & ~head.startswith("FEFF")
    return F.coalesce(marked, F.when(plain, whole), _other(F.when(odd, content)))
