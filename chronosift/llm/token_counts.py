"""Exact token counts of every prefix of every text.

A document's table is one signed byte per character: by how much the count
changes when that character joins the prefix (a space changes nothing). Its
running sum answers budget and truncation questions without encoding again.
Cases: null and empty texts have an empty table and count 0; very long texts are
taken whole, word by word; further columns are ignored; repeated rows give
repeated results, and rows without a doc_id theirs; an empty table gives an empty
result; special strings in a text are what the library's default makes of them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronosift.llm.common import Memo, arrow_map, settle, texts_of
from chronosift.llm.tokens import WORD_BPE, PrefixCounts

#: Documents above so many tokens are over the limit.
TOKEN_LIMIT = 2048


@lru_cache(maxsize=2)
def _memo(name: str) -> Memo:
    return Memo(PrefixCounts(name).of_chunk, 400_000)


def table_of(text: str, name: str = WORD_BPE) -> bytes:
    """The prefix table of one text."""
    return b"\0".join(map(_memo(name).__getitem__, text.split(" "))) if text else b""


def counts_at(table: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)


def longest_prefix(table: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    ok = np.flatnonzero(counts_at(table) <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def tokens_between(table: bytes, start: int, end: int) -> int:
    """How many tokens the prefix gains from `start` to `end` characters."""
    return int(np.frombuffer(table, np.int8)[start:end].sum(dtype=np.int64))


def prefix_tables(docs: DataFrame, name: str = WORD_BPE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_deltas (binary, one byte per character)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        settle()
        texts = b.column("text").to_pylist()
        tables = [table_of(t, name) for t in texts]
        return pa.record_batch(
            [
                b.column("doc_id").cast(pa.int64()),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array([int(np.frombuffer(x, np.int8).sum(dtype=np.int64)) for x in tables], pa.int64()),
                pa.array(tables, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "prefix_deltas"],
        )

    return arrow_map(texts_of(docs), run, "doc_id long, n_bytes long, n_tokens long, prefix_deltas binary")


def token_counts(docs: DataFrame, limit: int = TOKEN_LIMIT, name: str = WORD_BPE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count is above `limit`."""
    t = prefix_tables(docs, name)
    return t.select("doc_id", "n_bytes", "n_tokens", (t.n_tokens > limit).alias("over_limit"))
