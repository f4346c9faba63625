"""Contractions of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..frame import Frame
from ..operators.contract import contract


def contracted(formula: str, stream: DataFrame, axes: list[str], static: Frame) -> Frame:
    """A streaming frame of coordinates (`axes`, v) contracted with a static one; Structured Streaming keeps the sums."""
    return contract(formula, Frame(stream.select(*axes, "v"), tuple(axes)), static)


def updated(x: Frame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts the query; after each batch `write` gets the changed coordinates with their new sums, and the batch's number.
    A batch that is run again has the same number and rows, so a writer that merges by coordinates stays right."""
    return x.df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def accumulated(x: Frame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Starts the query; its in-memory table `name` holds the whole frame after each batch, on the driver: for small frames."""
    out = x.df.writeStream.format("memory").queryName(name).outputMode("complete")
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
