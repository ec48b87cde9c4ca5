"""HTML extraction: the main text of whole pages by the recurrent block labeller.

Null and empty pages, and pages without main text, give the empty text. Character references are
decoded; white space within a block becomes one space; main blocks are joined by a space in page
order. Pages of any length are read whole. Repeated rows give repeated results; a column of the input
that clashes with an output name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railloom.llm.block_labeller import Labeller
from railloom.llm.common import arrow_map, text_groups


def extract(pages: DataFrame, labeller: Labeller | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col`` in place of the HTML."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or Labeller())  # about 450 KB of weights
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), f"`{out_col}` string"])

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        raw = [p or "" for p in batch.column(len(keep)).to_pylist()]
        for a, b in text_groups(raw, 2 << 20):
            part = batch.slice(a, b - a)
            yield {c: part.column(i) for i, c in enumerate(keep)} | {out_col: shared.value.main_texts(raw[a:b])}

    return arrow_map(pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").alias("__html")), schema, work)
