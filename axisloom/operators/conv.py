"""Convolution (cross-correlation, as in neural networks) along one, two or three named axes.

Windows are never laid out: each element meets the kernel's rows on the channel and goes to the places it counts for,
o = h + left - k * dilation, where everything is summed once. Circular boundaries take o modulo the length; others than zero go through a halo.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ..frame import Frame
from ..lang import per_axis
from ..mesh import Mesh, resolve_sizes
from .contract import bind, prepared
from .stencil import BOUNDARIES, _haloed, _window_names, widths


@dataclass(frozen=True)
class Layout:
    """What a convolution's formula says: both operands bound, and for each axis its kernel axis, step and margins."""

    x: Frame
    weight: Frame
    out: tuple[str, ...]
    channel: str
    made: str
    kernel: Mapping[str, str]
    step: Mapping[str, int]
    margins: Mapping[str, tuple[int, int]]


def layout_of(f, x: Frame, weight: Frame, windows: Mapping, padding=None, dilation=1, families=None) -> Layout:
    """Checks names and lengths; the kernel's sizes are counted, so that it is broadcast where they prove it small."""
    names = _window_names(windows, families)
    if len(f.inputs) != 2:
        raise ValueError("a convolution takes an array and a kernel")
    if any(s.partials for s in (*f.inputs, f.output)):
        raise ValueError("convolutions take no partial sums; reduce them first")
    if not 1 <= len(names) <= 3:
        raise ValueError("one to three axes have windows")
    if len(set(names.values())) != len(names):
        raise ValueError("Window axes must be distinct")
    if any(a.shard for a in f.inputs[1].axes):
        raise ValueError("kernels are local")
    a, w = bind(f.inputs[0], x, {}), bind(f.inputs[1], weight, {}).measured()
    out = f.output.names
    channel = [c for c in w.axes if c in a.axes]
    made = [c for c in w.axes if c not in a.axes and c not in names.values()]
    if len(channel) != 1 or len(made) != 1 or channel[0] in out or channel[0] in names:
        raise ValueError("a convolution has one channel that goes in and one that comes out")
    if any(k not in w.axes or k in a.axes for k in names.values()):
        raise ValueError("kernel axes belong to the kernel alone")
    if set(out) != (set(a.axes) - set(channel)) | set(made):
        raise ValueError(f"Output dimension set of `{f.output}` doesn't follow from the inputs")
    a = a.measured(*names)
    step, margins = {}, {}
    for axis, k in names.items():
        step[axis] = _one(dilation, axis, names, families)
        span = step[axis] * (w.sizes[k] - 1)
        given = per_axis(padding, families).get(axis) if isinstance(padding, Mapping) else padding[list(names).index(axis)] if isinstance(padding, (list, tuple)) else padding
        if given is None:
            if span % 2:
                raise ValueError(f"an even kernel along {axis!r} needs explicit padding")
            given = span // 2
        margins[axis] = widths(given)
        if sum(margins[axis]) != span:
            raise ValueError(f"Padding for axis {axis!r} must preserve the spatial length: {margins[axis][0]} + {margins[axis][1]} isn't {span}")
    return Layout(a, w, tuple(out), channel[0], made[0], names, step, margins)


def _one(value, axis: str, names: Mapping[str, str], families) -> int:
    return per_axis(value, families).get(axis, 1) if isinstance(value, Mapping) else value[list(names).index(axis)] if isinstance(value, (list, tuple)) else value


def shown(c: Layout, boundary: str, fill: float) -> tuple[Frame, dict]:
    """The array with the ghost cells that need rows of their own, and where an element counts for a kernel place."""
    a, place = c.x, {}
    for axis, k in c.kernel.items():
        n, (left, right) = c.x.sizes[axis], c.margins[axis]
        if boundary == "replicate" or boundary == "constant" and fill:
            a, left = _haloed(a, axis, left, right, boundary, fill), 0
        o = F.col(axis) + left - F.col(k) * c.step[axis]
        place[axis] = F.pmod(o, F.lit(n)) if boundary == "periodic" and n else o
    return a, place


def conv(formula: str, x: Frame, weight: Frame, windows: Mapping, *, bias: Frame | None = None, padding=None, stride=1, dilation=1, groups: int = 1, boundary: str = "constant", fill: float = 0.0, mesh: Mesh | None = None, shapes=None, families=None, checkpoint: str | None = None) -> Frame:
    """`b h w c, o c kh kw -> b h w o` with windows {h: kh, w: kw}. Lengths are kept; `checkpoint` changes nothing here:
    lineage recomputes what isn't kept."""
    f, _ = prepared(formula, families)
    if groups != 1:
        raise NotImplementedError("grouped convolutions")
    if checkpoint not in (None, "full", "conv", "none"):
        raise ValueError(f"Unknown checkpoint mode {checkpoint!r}")
    if boundary not in BOUNDARIES:
        raise ValueError(f"Unsupported halo boundary {boundary!r}")
    windowed = _window_names(windows, families)
    if any(_one(stride, a, windowed, families) != 1 for a in windowed):
        raise NotImplementedError("strides other than 1")
    if mesh is None and not f.local:
        raise ValueError("Distributed formulas require a mesh")
    c = layout_of(f, x, weight, windows, padding, dilation, families)
    a, place = shown(c, boundary, fill)
    out, w, made = c.out, c.weight, [c.made]
    place = {axis: (o, c.x.sizes[axis]) for axis, o in place.items()}
    df = a.df.withColumnRenamed("v", "_x").join(w.side().withColumnRenamed("v", "_w"), [c.channel])
    for axis, (o, n) in place.items():
        df = df.withColumn(f"_at_{axis}", o).where(F.col(f"_at_{axis}").between(0, n - 1))
    df = df.select(*[F.col(f"_at_{n}" if n in place else n).cast("bigint").alias(n) for n in out], (F.col("_x") * F.col("_w")).alias("v"))
    sizes = {**{e: n for e, n in a.sizes.items() if e in out}, **{e: n for e, n in w.sizes.items() if e in out}, **{e: n for e, (_, n) in place.items()}}
    if bias is not None:
        others = [e for e in out if e not in place and e not in made]
        grid = a.df.select(*others).distinct() if others else a.df.sparkSession.range(1)
        for axis, (_, n) in place.items():
            grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias(axis))
        df = df.union(grid.crossJoin(bias.renamed(made).measured().side()).select(*out, "v"))  # a small vector beside the coordinates that must exist
    places = {e.name: mesh.normal(e.shard) for e in f.output.axes if e.shard}
    splits = {(d, e): resolve_sizes(shapes, d, e, sizes.get(e), mesh.size(d)) for e, d in places.items()}
    return replace(Frame(df, tuple(out), sizes, unique=False).summed(), placements=places, splits=splits, mesh=mesh)
