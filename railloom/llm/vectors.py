"""Vectors of a table as matrices: which take part, and blocks of rows that travel as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railloom.workspace import Workspace


def numbered(table: DataFrame, id_col: str, vector_col: str, workspace: Workspace) -> DataFrame:
    """(row, vec_id, vector): every row under a number of its own, whatever its id; written, so that the numbers stay."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    return workspace.table(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"), "vectors")


def pack(m: np.ndarray) -> tuple[str, bytes]:
    """A matrix as the smallest kind of number that holds it exactly, and its bytes."""
    for kind in ("<i2", "<f4"):
        with np.errstate(all="ignore"):
            small = m.astype(kind)
            if (small.astype(np.float64) == m).all():
                return kind, small.tobytes()
    return "<f8", m.astype("<f8").tobytes()


def unpack(kind: str, width: int, cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, kind).reshape(-1, width).astype(np.float64)


def finite(vector: str | Column = "vector") -> Column:
    """Neither null nor empty, nor with a component that is null, infinite or not a number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column in double precision; shorter vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with zero columns added up to the wider one's width."""
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
