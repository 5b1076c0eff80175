"""File layout: compaction and key clustering. Content is never changed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_BYTES = 128 * 1024 * 1024


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a file-based frame, from its statistics: no row is read."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def target_files(df: DataFrame, target_bytes: int = TARGET_BYTES) -> int:
    return max(1, math.ceil(stored_bytes(df) / target_bytes))


def compact(df: DataFrame, files: int | None = None) -> DataFrame:
    """The same rows in few files of about 128 MB.

    `coalesce` joins neighbouring scan tasks instead of shuffling the table; the
    number of tasks left is the number of full-size files.
    """
    return df.coalesce(files or target_files(df))


def cluster_by(df: DataFrame, keys: Sequence[str], files: int) -> DataFrame:
    """Rows ordered for file and row-group skipping on `keys`, the first key foremost.

    Range partitions, sorted within. A hash of the whole row is the last range column;
    it lets a key holding a large part of all rows spread over several neighbouring files.
    """
    spread = F.xxhash64(*df.columns)
    return df.repartitionByRange(files, *keys, spread).sortWithinPartitions(*keys)
