"""What the operators on embeddings share: usable rows, and their vectors as integer matrices."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null, NaN nor infinity."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(F.coalesce(vector, F.array().cast("array<double>")), bad)


def usable(df: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """(id, vector, *others) of the rows with a finite vector, in doubles."""
    return df.where(finite(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *others)


def matrix(vectors: pa.ListArray, d: int, scale: float, offset: int = 0) -> np.ndarray:
    """floor(scale * component) + offset in int64, a row per vector; a shorter vector has zeros for what it lacks."""
    flat = np.asarray(vectors.flatten(), np.float64)
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    whole = np.floor(scale * flat)
    if len(whole) and np.abs(whole).max() >= 2.0**62:
        raise OverflowError("a component is too large for a 64-bit integer")
    out = np.full((len(sizes), d), offset, np.int64)
    out[np.arange(d) < sizes[:, None]] = whole.astype(np.int64) + offset
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact: in doubles where these hold every partial sum, otherwise in Python's integers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


