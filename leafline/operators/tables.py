"""Tables inside marked-up texts as rows: one for each cell, with its table, row and column."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafline.operators import markup

CELL = T.StructType([T.StructField(n, T.StringType() if n == "cell" else T.IntegerType()) for n in ("table_no", "row_no", "column_no", "cell")])


@F.arrow_udf(T.ArrayType(CELL))
def _cells(texts: pa.Array) -> pa.Array:
    """The cells of each text's tables, a batch of texts at a time: column by column, with the ends of each text."""
    ends, columns = [0], ([], [], [], [])
    for html in texts.to_pylist():
        for table_no, rows in enumerate(markup.tables_of(html) if html else []):
            for row_no, row in enumerate(r for r in rows if r):
                n = len(row)
                for column, values in zip(columns, ([table_no] * n, [row_no] * n, range(n), row), strict=True):
                    column.extend(values)
        ends.append(len(columns[0]))
    made = [pa.array(c, pa.string() if n == "cell" else pa.int32()) for n, c in zip(CELL.names, columns, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, CELL.names))


def cells(df: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """``keys`` with ``table_no``, ``row_no``, ``column_no`` (from 0) and ``cell``; no row moves, and a text without
    tables, or a null one, has no rows.  A cell that is never closed is not read.

    Texts go to Python in batches.  A table function in a lateral join is called, and answers, a text
    at a time."""
    return df.select(*keys, F.inline(_cells(html)))
