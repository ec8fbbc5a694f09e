"""Shared helpers of the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one slice handled at a time in Python; also bounded by SLICE_BYTES.
SLICE_ROWS = 2000
SLICE_BYTES = 8 << 20
#: The characters `[\x20\x09-\x0D]`, which separate words in the contracts.
SPACES = " \t\n\x0b\x0c\r"


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes empty) and the further columns named."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds more than `rows` or much more than `size` bytes of `column`."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * size / max(1, batch.column(column).nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def settle() -> None:
    """Memos hold many small objects without cycles; collecting them again and
    again for cycles costs more than the work. Reference counts still free."""
    gc.disable()


class Memo(dict):
    """word -> value, computed once and kept while the memo is small.

    A full memo starts anew, so memory is bounded and frequent words are soon
    back whatever order the corpus has.
    """

    def __init__(self, compute: Callable, limit: int = 500_000, longest: int = 48):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over bounded slices; `fn` maps one slice to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, column):
            out = fn(s)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
