"""Frames: whole named-axis arrays as DataFrames of coordinates.

A frame has one BIGINT column for each axis, 0-based, and a value column `v` (or `re` and `im`); a coordinate without a row
is zero. Placements say along which mesh dimension an axis lies in intervals; they don't move rows until
`to_shards` or `placed` asks for it. A partial dimension `d` is a key column `_p_d`: the value is the sum over it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mesh import Mesh, resolve_sizes, shard_of, start_of

#: Frames of known sizes up to so many bytes are broadcast.
BROADCAST_BYTES = 8 << 20


def partial_column(dim: str) -> str:
    return f"_p_{dim}"


def shard_column(dim: str) -> str:
    return f"_s_{dim}"


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    axes: tuple[str, ...]
    sizes: Mapping[str, int] = field(default_factory=dict)
    values: tuple[str, ...] = ("v",)
    placements: Mapping[str, str] = field(default_factory=dict)
    partials: tuple[str, ...] = ()
    mesh: Mesh | None = None
    splits: Mapping[tuple[str, str], list[int]] = field(default_factory=dict)
    #: Whether each coordinate (with its partials) has one row at most.
    unique: bool = True
    steps: tuple = ()

    @staticmethod
    def of(df: DataFrame, axes: Iterable[str] | Mapping[str, str | Column], value: str | Column = "v", sizes: Mapping[str, int] | None = None, unique: bool = True, imaginary: str | Column | None = None) -> Frame:
        """A frame of table rows: axis names, or axis name -> column. With `unique` False coordinates may repeat and add up:
        linear operators take such rows as they are, and only what must see one row for each coordinate sums first."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        axes = axes if isinstance(axes, Mapping) else {a: a for a in axes}
        values = {"v": value} if imaginary is None else {"re": value, "im": imaginary}
        picked = df.select(*[col(c).cast("bigint").alias(a) for a, c in axes.items()], *[_number(df, col(c), n) for n, c in values.items()])
        return Frame(picked, tuple(axes), dict(sizes or {}), tuple(values), unique=unique)

    @staticmethod
    def of_arrays(df: DataFrame, axes: Iterable[str] | Mapping[str, str | Column], array: str | Column, inner: str, sizes: Mapping[str, int] | None = None) -> Frame:
        """A frame whose innermost axis is packed in an array column. Filters on axes still reach the scan."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        axes = axes if isinstance(axes, Mapping) else {a: a for a in axes}
        rows = df.select(*[col(c).cast("bigint").alias(a) for a, c in axes.items()], F.posexplode(col(array)).alias(inner, "v"))
        return Frame(rows.select(*axes, F.col(inner).cast("bigint").alias(inner), F.col("v").cast("double").alias("v")), (*axes, inner), dict(sizes or {}))

    # --- bookkeeping ------------------------------------------------------------------------------------------

    @property
    def keys(self) -> list[str]:
        return [*self.axes, *map(partial_column, self.partials)]

    @property
    def complex(self) -> bool:
        return len(self.values) == 2

    def small(self) -> bool:
        """Whether its sizes prove that it is cheap to broadcast."""
        return self.unique and not self.partials and all(a in self.sizes for a in self.axes) and prod(self.sizes[a] for a in self.axes) * 8 * (len(self.axes) + len(self.values)) <= BROADCAST_BYTES

    def side(self) -> DataFrame:
        return F.broadcast(self.df) if self.small() else self.df

    def with_df(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def measured(self, *axes: str) -> Frame:
        """With the sizes of `axes` (all by default); unknown ones are counted, in one job."""
        unknown = [a for a in axes or self.axes if a not in self.sizes]
        if not unknown:
            return self
        got = self.df.agg(*[F.coalesce(F.max(a) + 1, F.lit(0)).alias(a) for a in unknown]).first()
        return replace(self, sizes={**self.sizes, **{a: int(got[a]) for a in unknown}})

    def size(self, axis: str) -> int:
        return self.measured(axis).sizes[axis]

    def renamed(self, names: Iterable[str]) -> Frame:
        names = tuple(names)
        if len(names) != len(self.axes):
            raise ValueError(f"{len(names)} names for the {len(self.axes)} axes {' '.join(self.axes)}")
        to = dict(zip(self.axes, names, strict=True))
        df = self.df.select(*[F.col(a).alias(to[a]) for a in self.axes], *self.keys[len(self.axes) :], *self.values)
        return replace(self, df=df, axes=names, sizes={to[a]: n for a, n in self.sizes.items() if a in to}, placements={to[a]: d for a, d in self.placements.items() if a in to}, splits={(d, to[a]): s for (d, a), s in self.splits.items() if a in to})

    def where(self, condition: str | Column) -> Frame:
        return self.with_df(self.df.where(condition))

    # --- values -----------------------------------------------------------------------------------------------

    def once(self) -> Frame:
        """With one row for each coordinate."""
        return self if self.unique else self.summed()

    def summed(self, axes: Iterable[str] | None = None, partials: Iterable[str] | None = None) -> Frame:
        """Sums over all other axes and partial dimensions (none by default: repeated coordinates become one)."""
        axes = self.axes if axes is None else tuple(axes)
        partials = self.partials if partials is None else tuple(partials)
        keys = [*axes, *map(partial_column, partials)]
        df = self.df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in self.values])
        return replace(self, df=df, axes=axes, partials=partials, unique=True, sizes={a: n for a, n in self.sizes.items() if a in axes}, placements={a: d for a, d in self.placements.items() if a in axes})

    def densified(self, fill: float = 0.0) -> Frame:
        """A row for each coordinate within the sizes. Missing ones get `fill`."""
        f = self.measured()
        grid = _grid(f.df, f.axes, f.sizes)
        for p in f.partials:
            grid = grid.crossJoin(F.broadcast(f.df.sparkSession.range(f.mesh.size(p)).select(F.col("id").cast("int").alias(partial_column(p)))))
        df = grid.join(f.once().df, f.keys, "left").select(*f.keys, *[F.coalesce(v, F.lit(float(fill))).alias(v) for v in f.values])
        return replace(f, df=df, unique=True)

    def packed(self, axis: str) -> DataFrame:
        """One row for each coordinate of the other axes, with an array over `axis`: dense, zero where there was no row."""
        n = self.size(axis)
        rest = [a for a in self.axes if a != axis]
        lists = self.once().df.groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct(axis, F.col("v").cast("double").alias("v")))).alias("m"))  # the size of one axis
        zeros = lambda count: F.array_repeat(F.lit(0.0), count.cast("int"))
        before = lambda i: F.coalesce(F.get("m", i - 1)[axis], F.lit(-1))
        filled = F.flatten(F.transform("m", lambda e, i: F.concat(zeros(e[axis] - before(i) - 1), F.array(e["v"]))))
        return lists.select(*rest, F.concat(filled, zeros(n - 1 - F.element_at("m", -1)[axis])).alias("v"))

    # --- layout -----------------------------------------------------------------------------------------------

    def split(self, axis: str) -> list[int]:
        """Interval lengths of a placed axis."""
        dim = self.placements[axis]
        known = self.splits.get((dim, axis))
        return known or resolve_sizes(None, dim, axis, self.size(axis), self.mesh.size(dim))

    def to_shards(self) -> DataFrame:
        """Rows as the ranks see them: `_s_<dim>` for each dimension in use, local coordinates along placed axes."""
        df = self.once().df
        owners = {}
        for axis, dim in self.placements.items():
            sizes = self.split(axis)
            owners.setdefault(dim, []).append(axis)
            df = df.withColumn(f"_o_{axis}", shard_of(F.col(axis), sizes)).withColumn(axis, F.col(axis) - start_of(F.col(f"_o_{axis}"), sizes))
        for dim, axes in owners.items():
            for other in axes[1:]:  # a rank holds the coordinates that all its axes give it
                df = df.where(F.col(f"_o_{axes[0]}") == F.col(f"_o_{other}"))
            if dim in self.partials:
                df = df.where(F.col(f"_o_{axes[0]}") == F.col(partial_column(dim)))
            df = df.withColumn(shard_column(dim), F.col(f"_o_{axes[0]}"))
        return df.select(*[shard_column(d) for d in owners], *self.keys, *self.values)

    def placed(self) -> DataFrame:
        """`to_shards` with the rows of a shard in one partition of its own dimension product."""
        df = self.to_shards()
        dims = list(dict.fromkeys(self.placements.values()))
        return df.repartition(prod(self.mesh.size(d) for d in dims), *[shard_column(d) for d in dims]) if dims else df


def _number(df: DataFrame, c: Column, name: str) -> Column:
    kind = df.select(c.alias("x")).schema["x"].dataType.typeName()
    return (c if kind in ("long", "decimal") else c.cast("double")).alias(name)


def _grid(df: DataFrame, axes: Iterable[str], sizes: Mapping[str, int]) -> DataFrame:
    """All coordinates: the largest axis is a distributed range, the others are exploded beside it."""
    axes = list(axes)
    spark = df.sparkSession
    if any(sizes[a] <= 0 for a in axes):
        return df.select(*axes).limit(0)
    if not axes:
        return spark.range(1).select()
    first = max(axes, key=lambda a: sizes[a])
    out = spark.range(sizes[first]).select(F.col("id").alias(first))
    for a in axes:
        if a != first:
            out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(sizes[a] - 1)).cast("array<bigint>")).alias(a))
    return out.select(*axes)
