"""What the vector operators share: checked integer vectors, and exact sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Integer components end here, so that squared distances of 1,000 of them fit a long.
COMPONENT_BOUND = 2**25
LONG_MAX = 2**63 - 1


def integer_vectors(
    rows: DataFrame, scale: int, vector: str = "embedding", key: str = "vec_id", also: tuple[str, ...] = ()
) -> DataFrame:
    """(vec_id, v): components x of `vector` as floor(scale * x), x as double.

    Rows whose vector is NULL, empty or holds a NULL or non-finite component go. Integers
    beyond `COMPONENT_BOUND` are set to it. Further columns are left behind but for `also`.
    """
    x = F.col(f"`{vector}`")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = float(COMPONENT_BOUND)
    return (
        rows.where(x.isNotNull() & (F.size(x) > 0) & F.coalesce(whole, F.lit(False)))
        .select(
            F.col(f"`{key}`").cast("long").alias("vec_id"),
            F.transform(
                x,
                lambda c: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c.cast("double") * scale))).cast("int"),
            ).alias("v"),
            *also,
        )
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column of one length as a matrix of longs."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).reshape(len(column), width)


def exact_sum(column: str) -> Column:
    """Sum of longs, held at the greatest long instead of overflowing."""
    total = F.sum(F.col(column).cast("decimal(20,0)"))
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def joined(values) -> str:
    return ",".join(map(str, values))
