"""Parquet tables as frames. Filters on axis columns and the choice of columns reach the scan."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_frame(x: Frame, path: str, mode: str = "errorifexists") -> None:
    """Coordinates as Parquet, laid out by the placed axes' shards if there are any; axes and sizes go into the metadata of the first axis."""
    x = x.once()
    note = json.dumps({"axes": x.axes, "sizes": dict(x.sizes), "values": x.values, "partials": x.partials})
    df = x.df.select(*[F.col(c).alias(c, metadata={"frame": note}) if c == x.axes[0] else F.col(c) for c in x.keys], *x.values)
    df.write.mode(mode).parquet(path)


def read_frame(spark: SparkSession, path: str, axes: Iterable[str] | None = None, sizes: Mapping[str, int] | None = None) -> Frame:
    df = spark.read.parquet(path)
    first = next((f for f in df.schema.fields if "frame" in f.metadata), None)
    note = json.loads(first.metadata["frame"]) if first else {"axes": list(axes or ()), "sizes": {}, "values": ["v"], "partials": []}
    return Frame(df, tuple(axes or note["axes"]), {**note["sizes"], **(sizes or {})}, tuple(note["values"]), partials=tuple(note["partials"]))


def arrays(spark: SparkSession, values: np.ndarray, axes: str | Iterable[str]) -> Frame:
    """A frame of a small local array: examples and tests."""
    values = np.asarray(values)
    axes = axes.split() if isinstance(axes, str) else list(axes)
    at = [tuple(map(int, i)) for i in np.ndindex(values.shape)]
    if np.iscomplexobj(values):
        rows, kinds = [(*i, float(values[i].real), float(values[i].imag)) for i in at], ("re", "im")
    else:
        rows, kinds = [(*i, float(values[i])) for i in at], ("v",)
    schema = ", ".join([*(f"`{a}` bigint" for a in axes), *(f"{k} double" for k in kinds)])
    return Frame(spark.createDataFrame(rows, schema), tuple(axes), dict(zip(axes, values.shape, strict=True)), kinds)


def to_array(x: Frame) -> np.ndarray:
    """The whole frame as a local array: for small results."""
    x = x.measured()
    out = np.zeros([x.sizes[a] for a in x.axes], complex if x.complex else float)
    for row in x.df.select(*x.axes, *x.values).collect():
        out[tuple(row[: len(x.axes)])] += row["re"] + 1j * row["im"] if x.complex else row["v"]
    return out
