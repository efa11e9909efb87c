"""Arrow columns of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """True for vectors with at least one component, all finite and not all zero."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(~bad & some, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length without NULLs, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1)


def bounded_sample(df: DataFrame, vector: str, id_col: str, total: int, most: int) -> dict[int, np.ndarray]:
    """About `most` rows at most, chosen by the hash of their id, as a matrix for each vector length."""
    share = min(1.0, most / max(total, 1))
    chosen = df.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20)))))
    got = chosen.select(id_col, vector).toArrow().sort_by(id_col)
    lengths = pc.list_value_length(got.column(vector)).to_numpy() if got.num_rows else np.zeros(0, int)
    return {int(d): matrix(got.column(vector).filter(pa.array(lengths == d))) for d in np.unique(lengths)}
