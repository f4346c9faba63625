"""Matrix products in dense blocks: for large dense operands, where joined coordinates would be |i| |k| |j| rows.

Rows go to blocks of ROWS x BLOCK; blocks are joined on the contracted axis and multiplied by numpy, and the products of several blocks of that
axis are added up after coordinates have come out again. The pairs of blocks are dealt to SPREAD x SPREAD cells, each operand to the cells of its row or
column, so that a short contracted axis (one block, one key) isn't one task. A row of a product leaves Python as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame

BLOCK, ROWS, SPREAD = 256, 512, 16


def _blocked(df: DataFrame, row: str, inner: str, names: tuple[str, str], cells: tuple[str, str]) -> DataFrame:
    """(row block, inner block, cells): cells of one block, ROWS * BLOCK at most, in each of the SPREAD cells of the grid that need it."""
    at = (F.pmod(F.col(row), F.lit(ROWS)) * BLOCK + F.pmod(F.col(inner), F.lit(BLOCK))).cast("int")
    blocks = df.select((F.col(row) / ROWS).cast("bigint").alias(names[0]), (F.col(inner) / BLOCK).cast("bigint").alias("_k"), at.alias("at"), F.col("v").cast("double").alias("v")).where("v is not null")
    blocks = blocks.groupBy(names[0], "_k").agg(F.collect_list("at").alias(f"{names[1]}_at"), F.collect_list("v").alias(f"{names[1]}_v"))
    return blocks.select("*", F.pmod(F.col(names[0]), F.lit(SPREAD)).cast("int").alias(cells[0]), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias(cells[1]))


def multiplied(x: Frame, y: Frame, kept: list[str], shared: list[str]) -> Frame:
    """`i k, j k -> i j` for frames of one free and one contracted axis each."""
    free = [[a for a in s.axes if a not in shared] for s in (x, y)]
    if len(shared) != 1 or shared[0] in kept or [len(a) for a in free] != [1, 1] or x.complex or y.complex:
        raise ValueError("blocks multiply real matrices: one free axis each and one contracted axis")
    (i,), (j,), (k,) = *free, shared
    left, right = _blocked(x.df, i, k, ("_i", "x"), ("_r", "_c")), _blocked(y.df, j, k, ("_j", "y"), ("_c", "_r"))
    pairs = left.join(right, ["_k", "_r", "_c"]).select("_i", "_j", "x_at", "x_v", "y_at", "y_v")

    def dense(at: np.ndarray, v: np.ndarray, width: int) -> np.ndarray:
        rows = int(at.max()) // BLOCK + 1
        return np.bincount(at, v, rows * BLOCK).reshape(rows, BLOCK)[:, :width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name: b.column(name)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                at, to = get("x_at"), get("y_at")
                width = int(min((at % BLOCK).max(), (to % BLOCK).max())) + 1
                product = dense(at, get("x_v"), width) @ dense(to, get("y_v"), width).T
                row = np.flatnonzero(product.any(1))
                if not len(row):
                    continue
                product = product if len(row) == len(product) else product[row]
                ends = pa.array(np.arange(0, product.size + 1, product.shape[1], dtype=np.int32))
                first = np.full(len(row), b.column("_j")[r].as_py() * ROWS)
                yield pa.record_batch([pa.array(row + b.column("_i")[r].as_py() * ROWS), pa.array(first), pa.ListArray.from_arrays(ends, pa.array(product.ravel()))], names=[i, j, "_v"])

    df = pairs.mapInArrow(run, f"`{i}` bigint, `{j}` bigint, _v array<double>")
    df = df.select(i, j, F.posexplode("_v").alias("_at", "v")).select(i, (F.col(j) + F.col("_at")).alias(j), "v").where("v <> 0")
    sizes = {**x.sizes, **y.sizes}
    once = sizes.get(k, BLOCK + 1) <= BLOCK  # one block along the contracted axis: nothing is left to add up
    return Frame(df, (i, j), {a: sizes[a] for a in (i, j) if a in sizes}, unique=once).once()
