"""Roll, halo and window: neighbours along named axes.

A roll is arithmetic. A halo or window sends each row to every place that shows it, by exploding a short computed list: no join
and no shuffle. Places that no row reaches, outside with a fill other than 0, are made from the coordinates
of the other axes that occur. A sparse frame's missing rows are zeros; densify it first if they must be shown.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import Frame, shard_column
from ..lang import Rest, per_axis
from ..mesh import Mesh, resolve_sizes, starts
from .contract import bind, close, contract, prepared

BOUNDARIES = ("constant", "periodic", "replicate")


def roll(formula: str, x: Frame, shifts: Mapping, *, mesh: Mesh | None = None, shapes=None, families=None) -> Frame:
    """Element i goes to (i + shift) mod n along each axis of `shifts`; intervals keep their lengths."""
    f, _ = prepared(formula, families)
    given = per_axis(shifts, families)
    x = _bound(f, x)
    for a in given:
        if a not in x.axes:
            raise ValueError(f"no axis {a!r} to roll in `{formula}`")
    x = x.measured(*given)
    columns = [F.pmod(F.col(a) + int(given[a]), F.lit(x.sizes[a])).alias(a) if a in given and x.sizes[a] else F.col(a) for a in x.axes]
    x = x.with_df(x.df.select(*columns, *x.keys[len(x.axes) :], *x.values))
    return _out(f, x, mesh, shapes)


def roll_shards(x: Frame, dim: str, steps: int) -> DataFrame:
    """Shards of a frame with whole shards moved on by `steps` ranks."""
    return x.to_shards().withColumn(shard_column(dim), F.pmod(F.col(shard_column(dim)) + steps, F.lit(x.mesh.size(dim))).cast("int"))


def widths(value) -> tuple[int, int]:
    left, right = (value, value) if isinstance(value, int) else tuple(value)
    if left < 0 or right < 0:
        raise ValueError("Halo widths must be non-negative")
    return int(left), int(right)


def _bound(f, x: Frame) -> Frame:
    if len(f.inputs) != 1:
        raise ValueError("stencils take one operand")
    if f.inputs[0].partials or f.output.partials:
        raise ValueError("stencils take no partial sums; reduce them first")
    return bind(f.inputs[0], x.once(), {})


def _out(f, x: Frame, mesh: Mesh | None, shapes) -> Frame:
    """`x`, which has the input's names, as the output says."""
    rest = [a for a in x.axes if a.startswith("_e")] if f.output.open else []
    named = [a for i in f.output.items for a in (rest if isinstance(i, Rest) else [i.name])]
    if set(named) != set(x.axes):
        raise ValueError(f"`{f.output}` isn't a permutation of {' '.join(x.axes)}")
    out = close(x, f.output, rest)
    places = {a.name: mesh.normal(a.shard) for a in f.output.axes if a.shard} if mesh else {}
    if not mesh and any(a.shard for s in (*f.inputs, f.output) for a in s.axes):
        raise ValueError("Distributed formulas require a mesh")
    splits = {(d, a): resolve_sizes(shapes, d, a, out.sizes.get(a) or out.size(a), mesh.size(d)) for a, d in places.items()}
    return replace(out, placements=places, splits=splits, mesh=mesh or x.mesh)


def _reach(h: Column, n: int, left: int, right: int, boundary: str) -> Column:
    """Places in [0, n + left + right) that show element h."""
    at = h + left
    total = n + left + right
    if boundary == "periodic":
        first = F.pmod(at, F.lit(n))
        return F.sequence(first, first + F.floor((total - 1 - first) / n) * n, F.lit(n).cast("bigint"))
    if boundary == "replicate":
        first = F.when(h == 0, F.lit(0).cast("bigint")).otherwise(at)
        last = F.when(h == n - 1, F.lit(total - 1).cast("bigint")).otherwise(at)
        return F.sequence(first, last)
    return F.array(at)


def _need(n: int, axis: str, boundary: str) -> None:
    if boundary not in BOUNDARIES:
        raise ValueError(f"Unsupported halo boundary {boundary!r}")
    if boundary != "constant" and n == 0:
        raise ValueError(f"axis {axis!r} is empty: nothing to {boundary.removesuffix('ic') or boundary}")


def _outside(x: Frame, axis: str, places: list[int], fill: float) -> DataFrame:
    """Rows of `fill` at places beyond the ends, for all coordinates of the other axes that occur."""
    rest = [a for a in x.keys if a != axis]
    cells = F.explode(F.array(*[F.lit(p).cast("bigint") for p in places])).alias(axis)
    others = x.df.select(*rest).distinct() if rest else x.df.sparkSession.range(1)
    return others.select(*rest, cells, *[F.lit(float(fill)).alias(v) for v in x.values]).select(*x.keys, *x.values)


def _haloed(x: Frame, axis: str, left: int, right: int, boundary: str, fill: float) -> Frame:
    x = x.measured(axis)
    n = x.sizes[axis]
    _need(n, axis, boundary)
    if not left and not right:
        return x
    df = x.df.select(*[F.explode(_reach(F.col(axis), n, left, right, boundary).cast("array<bigint>")).alias(axis) if a == axis else F.col(a) for a in x.keys], *x.values)
    if boundary == "constant" and fill:
        df = df.union(_outside(x, axis, [*range(left), *range(left + n, left + n + right)], fill))
    return x.with_df(df, sizes={**x.sizes, axis: n + left + right})


def halo(formula: str, x: Frame, halos: Mapping, *, boundary: str = "constant", fill: float = 0.0, mesh: Mesh | None = None, shapes=None, families=None) -> Frame:
    """`x` with ghost cells of the given widths along its axes, corners included. Without placements the result is a frame.

    Along a placed axis every shard gets its own interval with its own ghost cells; `halo_shards` gives those rows.
    """
    f, _ = prepared(formula, families)
    given = {a: widths(w) for a, w in per_axis(halos, families).items()}
    b = _bound(f, x)
    for a in given:
        if a not in b.axes:
            raise ValueError(f"no axis {a!r} for a halo in `{formula}`")
    if any(a.shard and a.name in given for a in f.inputs[0].axes):
        raise ValueError("a placed axis has a halo in each shard: use halo_shards")
    for a in b.axes:
        if a in given:
            b = _haloed(b, a, *given[a], boundary, fill)
    return _out(f, b, mesh, shapes)


def halo_shards(formula: str, x: Frame, halos: Mapping, *, mesh: Mesh, boundary: str = "constant", fill: float = 0.0, shapes=None, families=None) -> DataFrame:
    """Rows (_s_<dim>…, local coordinates, values) of shards whose intervals are wider by their halos; rows repeat
    where intervals overlap. Intervals may be uneven, empty, or narrower than a halo."""
    f, _ = prepared(formula, families)
    given = {a: widths(w) for a, w in per_axis(halos, families).items()}
    b = _bound(f, x)
    for a in b.axes:
        if a in given:
            b = _haloed(b, a, *given[a], boundary, fill)
    b = replace(b, df=b.df)
    df = b.df
    dims = []
    for axis in f.output.axes:
        if not axis.shard:
            continue
        dim = mesh.normal(axis.shard)
        left, right = given.get(axis.name, (0, 0))
        sizes = resolve_sizes(shapes, dim, axis.name, b.size(axis.name) - left - right, mesh.size(dim))
        begin = F.array(*[F.lit(s).cast("bigint") for s in starts(sizes)])
        end = F.array(*[F.lit(s + n + left + right).cast("bigint") for s, n in zip(starts(sizes), sizes, strict=True)])
        at = F.col(axis.name)
        shards = F.filter(F.sequence(F.lit(0), F.lit(len(sizes) - 1)), lambda s: (F.element_at(begin, s + 1) <= at) & (at < F.element_at(end, s + 1)))  # noqa: B023
        df = df.withColumn(shard_column(dim), F.explode(shards)).withColumn(axis.name, at - F.element_at(begin, F.col(shard_column(dim)) + 1))
        dims.append(shard_column(dim))
    named = [a for a in f.output.names]
    return df.select(*dims, *named, *b.values)


def window(formula: str, x: Frame, windows: Mapping, radius: Mapping | int | tuple, *, boundary: str = "constant", fill: float = 0.0, mesh: Mesh | None = None, shapes=None, families=None) -> Frame:
    """Sliding windows (im2col): centre c of axis a and offset k of `windows[a]` show element c - left + k."""
    f, _ = prepared(formula, families)
    names = _window_names(windows, families)
    reach = per_axis(radius, families) if isinstance(radius, Mapping) else dict.fromkeys(names, radius)
    b = _bound(f, x)
    if len(set(names.values())) != len(names) or set(names.values()) & set(b.axes):
        raise ValueError("Window axes must be distinct from each other and from the input's")
    for axis, new in names.items():
        if axis not in b.axes:
            raise ValueError(f"no axis {axis!r} for a window in `{formula}`")
        b = _windowed(b, axis, new, *widths(reach.get(axis, 0)), boundary, fill)
    placed = {a.name for a in f.output.axes if a.shard}
    if placed & set(names.values()):
        raise ValueError("window axes are local")
    return _out(f, b, mesh, shapes)


def _window_names(windows: Mapping, families) -> dict[str, str]:
    out = {}
    for axis, new in windows.items():
        if families and axis in families:
            new = families[new] if isinstance(new, str) and new in families else new
            out |= per_axis({axis: new.split() if isinstance(new, str) else list(new)}, families)
        else:
            out[axis] = new
    return out


def _windowed(x: Frame, axis: str, new: str, left: int, right: int, boundary: str, fill: float) -> Frame:
    n, total = x.size(axis), left + right + 1
    _need(n, axis, boundary)
    h, k = F.col(axis), F.col(new)
    df = x.df.select("*", F.explode(F.sequence(F.lit(0), F.lit(total - 1)).cast("array<bigint>")).alias(new))
    at = h + left - k
    if boundary == "periodic":  # a window wider than the axis shows an element once for each offset
        centres = F.array(F.pmod(at, F.lit(n)))
    elif boundary == "replicate":
        low = F.greatest(F.when(h == 0, F.lit(0).cast("bigint")).otherwise(at), F.lit(0).cast("bigint"))
        high = F.least(F.when(h == n - 1, F.lit(n - 1).cast("bigint")).otherwise(at), F.lit(n - 1).cast("bigint"))
        centres = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))
    else:
        centres = F.when((at >= 0) & (at < n), F.array(at)).otherwise(F.array().cast("array<bigint>"))
    keys = [*x.axes, new, *x.keys[len(x.axes) :]]
    df = df.select(*[F.explode(centres).alias(axis) if a == axis else F.col(a) for a in keys], *x.values)
    if boundary == "constant" and fill:
        pairs = [(c, o) for o in range(total) for c in ([*range(min(n, max(0, left - o)))] + [*range(max(0, n + left - o), n)])]
        if pairs:
            rest = [a for a in keys if a not in (axis, new)]
            cells = F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("c"), F.lit(o).cast("bigint").alias("o")) for c, o in dict.fromkeys(pairs)])).alias("_cell")
            others = x.df.select(*rest).distinct() if rest else x.df.sparkSession.range(1)
            edge = others.select(*rest, cells).select(*rest, F.col("_cell.c").alias(axis), F.col("_cell.o").alias(new), *[F.lit(float(fill)).alias(v) for v in x.values])
            df = df.union(edge.select(*keys, *x.values))
    return replace(x, df=df, axes=(*x.axes, new), sizes={**x.sizes, new: total})


def moving_sum(formula: str, x: Frame, axis: str, radius, weights: Frame, boundary: str = "constant") -> Frame:
    """Windows contracted with weights over the offsets: `formula` is the windowed array's and the weights'."""
    w = window(f"{' '.join(x.axes)} -> {' '.join([*x.axes, '_k'])}", x, {axis: "_k"}, {axis: radius}, boundary=boundary)
    return contract(formula, w, weights)
