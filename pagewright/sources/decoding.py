"""The boundary where opaque bytes become rows: Arrow batches filled across files, and an error row for a bad file."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20


def decoded(files: DataFrame, schema: str, rows: Callable[[bytes], Iterable[tuple]], failed: Callable[[str], tuple], columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """Rows of every file after its doc_id; ``failed`` makes the row of a file that cannot be read from the reason.

    ``rows`` gets the values of ``columns``.  Whatever goes wrong in a file stays in its row: rows that were read before
    stand, and the job goes on.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, *values = (batch.column(k)[i].as_py() for k in range(batch.num_columns))
                try:
                    for row in rows(*values):
                        held.append((doc_id, *row))
                        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                except Exception as e:  # a broken file must not end the job
                    held.append((doc_id, *failed(f"{type(e).__name__}: {e}")))
        if held:
            yield batch_of(held)

    return files.select("doc_id", *columns).mapInArrow(run, kind)
