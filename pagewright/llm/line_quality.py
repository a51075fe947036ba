"""Line-first cleaning: judge every line, drop those that fail, then reject texts that lost too much.

A line is a ``\\n``-separated span.  All rules go by a line's structure, none by its words, and hold for lines of every
length:

* punctuation: over ``max_symbols`` of ``#*$%&|<>`` a word, or at least half of three or more words end in ``!!``;
* letters: under ``min_letters`` of eight or more characters that are not white space are letters (ASCII letters, or
  any character beyond ASCII);
* shouting: at least ``max_upper`` of twenty or more ASCII letters in upper case;
* navigation: a separator (``|``, ``>``, ``»``, ``›``, ``·``, ``•``) for every fourth word, a link (``://``, ``www.``,
  ``](``) for every third word, or a stub: under four words, without a mark of an ended clause behind them, as one of
  ``menu_lines`` or more such lines in a row, blank lines aside;
* boilerplate: an exact repeat of an earlier line of the text, or a ``©``.

Before that the base rules look at the whole text: too few words, or too many words inside repeated 5-word windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import bytewise as bw

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
#: What separates entries of a menu, what begins a link, what ends a clause.
SEPARATORS = ("|", ">", "»", "›", "·", "•")
LINKS = ("://", "www.", "](")
ENDS = (".", "!", "?", ";", ":", ",", "…", "。", "！", "？", "；", "：", "，")
WINDOW = 5
COLUMNS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "base_failed": "boolean", "n_lines": "bigint", "n_bad_lines": "bigint", "lost_words": "bigint", "kept": "boolean", "clean_text": "string",
}


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols: float = 0.3
    max_upper: float = 0.7
    min_letters: float = 0.5
    menu_lines: int = 3
    max_lost: float = 0.5


def _repeated(w: bw.Words, hashes: np.ndarray) -> np.ndarray:
    """For each word: is it in a 5-word window that its text holds twice or more?"""
    n = len(hashes)
    hit = np.zeros(n + 1, np.int64)
    if n < WINDOW:
        return hit[:n] > 0
    doc = w.doc
    inside = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    key = doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(WINDOW):
        key = bw.mix(key * np.uint64(0x9FB21C651E98DF25) + hashes[inside + k])
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    at = inside[counts[back] > 1]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + WINDOW, -1)
    return np.cumsum(hit[:n]) > 0


def _places(data: np.ndarray, offsets: np.ndarray, marks: tuple[str, ...], ends: bool = False) -> np.ndarray:
    """1 at the first byte (or the last) of every mark that lies in one text."""
    found = np.zeros(len(data), np.int64)
    for mark in marks:
        code = mark.encode()
        last = len(code) - 1
        at = np.flatnonzero(data[: max(len(data) - last, 0)] == code[0])
        for k in range(1, last + 1):
            at = at[data[at + k] == code[k]]
        if last:
            at = at[np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + last, side="right")]
        found[at + (last if ends else 0)] = 1
    return found


def _measure(data: np.ndarray, offsets: np.ndarray, rules: Rules, with_text: bool = True) -> tuple[list, list[bytes]]:
    n = len(offsets) - 1
    w = bw.words(data, offsets)
    n_words = np.diff(w.first)
    in_word = ~bw.SPACE[data]
    word_chars = bw.per_doc(in_word & ((data & 0xC0) != 0x80), offsets)
    symbols = SYMBOLS[data]
    n_symbols = bw.per_doc(symbols, offsets)
    repeated = _repeated(w, w.hashes())
    n_repeat = bw.per_doc(repeated, w.first)
    # Lines: every text has one more than it has line feeds.
    breaks = np.flatnonzero(data == 10)
    in_doc = np.searchsorted(breaks, offsets)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    line_first = in_doc + np.arange(n + 1)
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    words_at = np.searchsorted(w.starts, np.stack([begins, ends]))
    line_words = words_at[1] - words_at[0]

    def of_lines(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[ends] - total[begins]

    some = line_words > 0
    key = bw.mix(w.span_hash(begins, ends) + line_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    repeat = np.zeros(len(begins), bool)
    alive = np.flatnonzero(some)
    repeat[alive] = True
    repeat[alive[np.unique(key[alive], return_index=True)[1]]] = False
    n_dup = bw.per_doc(repeat, line_first)

    upper = of_lines((data >= 65) & (data <= 90))
    letters = upper + of_lines((data >= 97) & (data <= 122))
    ended = np.zeros(len(w.starts) + 1, np.int64)
    last = data[w.ends - 1] == 33
    last &= (w.ends - w.starts > 1) & (data[np.maximum(w.ends - 2, 0)] == 33)
    np.cumsum(last, out=ended[1:])
    loud = ended[words_at[1]] - ended[words_at[0]]
    bad = of_lines(symbols) > rules.max_symbols * line_words
    bad |= (line_words >= 3) & (2 * loud >= line_words)
    bad |= (letters >= 20) & (upper >= rules.max_upper * letters)
    bad &= some
    bad |= repeat
    separators, links, rights = (of_lines(_places(data, offsets, marks)) for marks in (SEPARATORS, LINKS, ("©",)))
    bad |= some & ((4 * separators >= np.maximum(line_words, 1)) | (3 * links >= np.maximum(line_words, 1)) | (rights > 0))
    solid = of_lines(in_word & ((data & 0xC0) != 0x80))
    letters = of_lines(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128) | (data >= 0xC0))
    bad |= (solid >= 8) & (letters < rules.min_letters * solid)
    ended = np.zeros(len(begins), bool)
    closing = _places(data, offsets, ENDS, ends=True)
    ended[some] = closing[w.ends[words_at[1][some] - 1] - 1] > 0
    stub = some & (line_words < 4) & ~ended
    full = np.flatnonzero(some)  # blank lines do not break a run, another text does
    if len(full):
        kind = stub[full]
        new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (line_doc[full][1:] != line_doc[full][:-1])])
        run = np.cumsum(new) - 1
        bad[full] |= kind & (np.bincount(run)[run] >= rules.menu_lines)
    lost = bw.per_doc(np.where(bad, line_words, 0), line_first)
    base = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    kept = ~base & (lost <= rules.max_lost * n_words)
    raw, texts = data.tobytes(), []
    for d in range(n if with_text else 0):
        lines = range(line_first[d], line_first[d + 1])
        texts.append(b"\n".join(raw[begins[i] : ends[i]] for i in lines if not bad[i]))
    numbers = [n_words, word_chars, n_symbols, n_dup, n_repeat, base, np.diff(line_first), bw.per_doc(bad, line_first), lost, kept]
    return numbers, texts


def clean(df: DataFrame, column: str = "text", rules: Rules | None = None, with_text: bool = True) -> DataFrame:
    """Adds the measures, the verdict ``kept`` and, with ``with_text``, the remaining lines as ``clean_text``.

    Null counts as the empty text: no words, base rules failed.  Rows are judged one by one, so repeated rows get the
    same verdict and an empty table gives an empty one.  Input columns with the names of added ones are replaced;
    ``__source__`` is a name of the operator's own.
    """
    rules = rules or Rules()
    made = {k: v for k, v in COLUMNS.items() if with_text or k != "clean_text"}
    keep = [c for c in df.columns if c not in made]
    source = "__source__"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep] + [f"{k} {v}" for k, v in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in bw.blocks(batch.column(source)):
                numbers, texts = _measure(data, offsets, rules, with_text)
                columns = [*batch.select(keep).slice(first, last - first).columns, *[pa.array(x) for x in numbers]]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(source)).mapInArrow(run, schema)
