"""What the operators of this package share: words, Arrow batches, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are runs of anything but these six characters (fixed values).
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"

#: Characters of text that a Python function works on at a time, whatever an Arrow batch holds.
SLICE_CHARS = 4_000_000


#: Rows that Spark hands to Python at once. Documents are long: ten thousand of them, the usual number, would be
#: some tens of megabytes in both processes.
BATCH_ROWS = 2_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: exactly A-Z and the six characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(key: str | Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % divisor


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_CHARS bytes of text each, a longer text being one part."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes + 1)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, text: str = "text"
) -> DataFrame:
    """``mapInArrow`` over small slices; ``make`` is called once in every task.

    The session's number of rows per batch is lowered to ``BATCH_ROWS`` where it is larger.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                yield work(part)

    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the finaliser of SplitMix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chain(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of all but its last element and the hash of that."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt)


def arrow_type(df: DataFrame, column: str) -> str:
    """The DDL type of a column."""
    return df.schema[column].dataType.simpleString()
