"""What several operators share: Arrow batches of texts, state of a Python worker, written intermediate tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import new_folder, write_through

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def worker_state(name: str, key: object, build: Callable[[], object]) -> object:
    """An object that a Python worker keeps from one task to the next; a new key replaces the old object."""
    held = sys.modules.setdefault("_pageloom_llm_state", types.ModuleType("_pageloom_llm_state"))
    found = getattr(held, name, None)
    if found is None or found[0] != key:
        found = (key, build())
        setattr(held, name, found)
    return found[1]


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read back."""
    return write_through(df, new_folder(df.sparkSession, f"llm-{name}"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, under fixed names; other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def quoted(columns: list[str]) -> list[str]:
    """Column names as Spark reads them literally, dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python objects exist for a few megabytes of text at a time; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def is_held_out(id_column: Column, modulus: int) -> Column:
    """True for rows whose crc32 of the id, written as text, leaves 2; false for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == 2, F.lit(False))
