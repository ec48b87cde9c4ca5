"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def whole_text(text: str | Column = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def arrow_map(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """Map Arrow batches: ``work`` turns one batch into dicts of columns, each yielded as a batch of ``schema``."""
    made = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield to_batch(columns, made)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; for the driver, which can parse it."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of ``schema`` from lists, numpy arrays or Arrow arrays by column name."""
    made = []
    for field in schema:
        x = columns[field.name]
        made.append(x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x, type=field.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def text_groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``most`` characters, to bound what is held at once."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


#: Keys that a broadcast join of hot keys takes at most.
HOT_KEYS = 4096


def join_with_hot(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of two written tables by a key that is unique on the right.

    ``weight`` of the right is the number of rows of the key on the left. Keys of more than a
    ``HOT_KEYS``-th of all rows, at most ``HOT_KEYS`` of them, are broadcast, so that no key gathers
    its rows in one task; all others meet by a sort-merge join.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(1000, total // HOT_KEYS)
    common, others = F.broadcast(right.where(hot)), right.where(~hot)
    rest = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(others.hint("merge"), key)
    return left.join(common, key).unionByName(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads every input bit over 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
