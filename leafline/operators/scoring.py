"""Pages scored by a linear model, over measures made relative to the pages like them.

A page is measured against its volume's pages of the same parity, as page numbers and
margins change sides, so that typeface and layout cancel out.  The model is a small file
whose digest is checked before it is sent out; a worker reads it once and scores batches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_MODELS: dict[str, dict] = {}


def relative(pages: DataFrame, volume: Sequence[str], page: str, measures: Sequence[str]) -> DataFrame:
    """``pages`` with ``<measure>_rel``, each measure less the median of its volume's pages of the same
    parity.  Null and NaN count in no median and stay null; without any value the median is null."""
    parity = F.pmod(F.col(page), F.lit(2)).alias("_parity")
    known = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
    middles = pages.groupBy(*volume, parity).agg(*(F.median(known(m)).alias(f"_{m}") for m in measures))
    both = pages.withColumn("_parity", parity).join(middles, [*volume, "_parity"])
    return both.select(*pages.columns, *((known(m) - F.col(f"_{m}")).alias(f"{m}_rel") for m in measures))


def fit(pages: DataFrame, features: Sequence[str], label: str, version: str, ridge: float = 1e-6) -> bytes:
    """A model of ``label`` (0 or 1) by least squares, as the bytes of its file.

    One aggregation sums the products of the features, so only (features + 1) squared numbers
    reach the driver.  Missing features count as 0, rows without a label not at all."""
    x = [F.lit(1.0), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)]
    y = F.col(label).cast("double")
    sums = pages.where(y.isNotNull()).agg(F.array(*(F.coalesce(F.sum(a * b), F.lit(0.0)) for a in x for b in x)).alias("xx"), F.array(*(F.coalesce(F.sum(a * y), F.lit(0.0)) for a in x)).alias("xy")).first()
    square = np.array(sums["xx"]).reshape(len(x), len(x)) + ridge * np.eye(len(x))
    bias, *weights = np.linalg.solve(square, np.array(sums["xy"])).tolist()
    return json.dumps({"version": version, "features": list(features), "weights": weights, "bias": bias}, sort_keys=True).encode()


def digest(model: bytes) -> str:
    return hashlib.sha256(model).hexdigest()


def checked(path: str, expected: str) -> bytes:
    """A model file of the digest that is expected; another one is refused."""
    model = Path(path).read_bytes()
    if digest(model) != expected:
        raise ValueError(f"{path} is not the model that was expected")
    return model


def score(pages: DataFrame, model: bytes, name: str = "score") -> DataFrame:
    """``pages`` with the model's score from 0 to 1.  A feature that a page lacks counts as 0."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    features = json.loads(model)["features"]
    missing = [f for f in features if f not in pages.columns]
    shown = pages.select("*", F.array(*(F.lit(0.0) if f in missing else F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features)).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest(sent.value)
        known = _MODELS.get(key) or _MODELS.setdefault(key, json.loads(sent.value))
        weights = np.array(known["weights"])
        for batch in batches:
            x = np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, len(weights))
            made = np.clip(x @ weights + known["bias"], 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=names)

    names = shown.columns
    schema = type(shown.schema)(shown.schema.fields[:-1]).add(name, DoubleType())
    return shown.mapInArrow(run, schema)
