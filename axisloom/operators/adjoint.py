"""Adjoints: every operator here is linear, so its gradient is another query, <A x, y> = <x, A' y> in the global view."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Frame, partial_column
from ..lang import Spec, expand_families, parse
from ..mesh import Mesh
from .contract import contract, prepared
from .conv import layout_of, shown
from .fourier import fft, half_weight
from .stencil import _need, roll, widths


def vjp_contract(formula: str, x: Frame, y: Frame, grad: Frame, families=None) -> tuple[Frame, Frame]:
    """Gradients of both operands of a product of named axes, from that of its result. An axis that one operand
    sums alone is spread over its length."""
    f = parse(expand_families(formula, families))
    specs = [Spec(s.items) for s in f.inputs]
    out = Spec(f.output.items)
    frames = (x, y)

    def of(k: int) -> Frame:
        other, own = specs[1 - k], specs[k]
        have = set(out.names) | set(other.names)
        lost = [n for n in own.names if n not in have]
        inner = [n for n in own.names if n in have]
        plain = lambda names: " ".join(names)
        keep = inner or list(dict.fromkeys((*out.names, *other.names)))  # a formula can't name a number: it is summed after it
        g = contract(f"{plain(out.names)}, {plain(other.names)} -> {plain(keep)}", grad, replace(frames[1 - k], placements={}))
        g = g if inner else g.summed(())
        for n in lost:
            size = frames[k].size(frames[k].axes[own.names.index(n)])
            g = replace(g, df=g.df.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<bigint>")).alias(n)), axes=(*g.axes, n), sizes={**g.sizes, n: size})
        return g.with_df(g.df.select(*own.names, *g.values), axes=own.names)

    return of(0), of(1)


def vjp_reduce(grad: Frame, axes: Mapping[str, int]) -> Frame:
    """Of a sum over `axes` of these sizes: the gradient goes to every element."""
    df = grad.once().df
    for a, n in axes.items():
        df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias(a))
    return replace(grad, df=df, axes=(*grad.axes, *axes), sizes={**grad.sizes, **axes})


def vjp_relayout(formula: str, grad: Frame, mesh: Mesh | None = None, shapes=None) -> Frame:
    """Of a permutation or a change of placements: the way back. A partial input's gradient is the same on every rank, a
    partial output's is summed over its ranks."""
    f = parse(formula)
    return contract(f"{f.output} -> {Spec(f.inputs[0].items, f.inputs[0].partials)}", grad, mesh=mesh, shapes=shapes)


def vjp_roll(formula: str, grad: Frame, shifts: Mapping, **options) -> Frame:
    f = parse(expand_families(formula, options.get("families")))
    return roll(f"{f.output} -> {f.inputs[0]}", grad, {a: [-s for s in v] if isinstance(v, (list, tuple)) else -v for a, v in shifts.items()}, **options)


def _owner(place: Column, n: int, boundary: str) -> Column:
    """The element that a place shows; beyond the ends of a constant boundary, none."""
    shows = F.pmod(place, F.lit(n)) if boundary == "periodic" else F.greatest(F.lit(0), F.least(place, F.lit(n - 1))) if boundary == "replicate" else place
    return shows.cast("bigint")


def vjp_halo(grad: Frame, axis: str, n: int, width, boundary: str = "constant") -> Frame:
    """Of a halo along `axis` of length n: ghost cells add to the elements they show."""
    left, right = widths(width)
    _need(n, axis, boundary)
    df = grad.df.withColumn(axis, _owner(F.col(axis) - left, n, boundary))
    if boundary == "constant":
        df = df.where(F.col(axis).between(0, n - 1))
    return replace(grad, df=df.select(*grad.keys, *grad.values), unique=False, sizes={**grad.sizes, axis: n}).summed()


def vjp_window(grad: Frame, axis: str, offset: str, n: int, width, boundary: str = "constant") -> Frame:
    """Of windows: every place of every window adds to the element it shows."""
    left, right = widths(width)
    flat = replace(grad, df=grad.df.select(*[(F.col(axis) + F.col(offset)).alias(axis) if a == axis else F.col(a) for a in grad.axes if a != offset], *grad.values), axes=tuple(a for a in grad.axes if a != offset), unique=False)
    return vjp_halo(flat.summed(), axis, n, (left, right), boundary)


def vjp_fft(formula: str, grad: Frame, axes: Mapping[str, str], *, inverse: bool = False, norm: str | None = None, real: bool = False, length: int | None = None, **options) -> Frame:
    """Of a transform: the opposite one, with the norm that goes with it.

    With `real` the last axis holds half a spectrum on one side, whose inner coefficients stand for two. `length` is that
    axis's length in the transform's input: the signal's (forward; default 2 (m - 1)) or the half's (inverse; default n // 2 + 1).
    A half that the inverse cut short or filled up gets a gradient for the coefficients it used.
    """
    f = parse(formula)
    back = f"{f.output} -> {f.inputs[0]}"
    other = {None: "forward", "backward": "forward", "forward": "backward", "ortho": "ortho"}[norm]
    turned = {b: a for a, b in axes.items()}
    if not real:
        return fft(back, grad, turned, inverse=not inverse, norm=other, **options)
    source, target = list(axes.items())[-1]
    grad = grad.once().measured(target)
    if inverse:
        n = grad.sizes[target]
        m = n // 2 + 1 if length is None else length
        half = fft(back, grad, turned, real=True, norm=other, **options)
        df = half.df.where(F.col(source) < m).select(*half.axes, *[(F.col(v) * half_weight(F.col(source), n)).alias(v) for v in half.values])
        return replace(half, df=df, sizes={**half.sizes, source: m})
    n = 2 * (grad.sizes[target] - 1) if length is None else length
    halved = grad.with_df(grad.df.select(*grad.keys, *[(F.col(v) / half_weight(F.col(target), n)).alias(v) for v in grad.values]))
    return fft(back, halved, turned, inverse=True, real=True, norm=other, signal_sizes={source: n}, **options)


def vjp_conv(formula: str, x: Frame, weight: Frame, grad: Frame, windows: Mapping, *, padding=None, dilation=1, boundary: str = "constant", fill: float = 0.0, families=None) -> tuple[Frame, Frame, Frame]:
    """Gradients of the array, the kernel and the bias. The array's: each row of `grad` meets the kernel's and adds to the
    element it saw there. The kernel's: each element goes to the places it counts for and meets `grad` there."""
    f, _ = prepared(formula, families)
    c = layout_of(f, x, weight, windows, padding, dilation, families)
    g = replace(grad.renamed(c.out), placements={}, splits={}).once()
    seen = g.df.withColumnRenamed("v", "_g").join(c.weight.side().withColumnRenamed("v", "_w"), [c.made])
    for axis, k in c.kernel.items():
        n = c.x.sizes[axis]
        _need(n, axis, boundary)
        seen = seen.withColumn(axis, _owner(F.col(axis) + F.col(k) * c.step[axis] - c.margins[axis][0], n, boundary)).where(F.col(axis).between(0, n - 1))
    seen = seen.select(*c.x.axes, (F.col("_g") * F.col("_w")).alias("v"))
    sizes = {**{a: n for a, n in g.sizes.items() if a in c.x.axes}, **c.x.sizes}
    to_x = Frame(seen, c.x.axes, sizes, unique=False).summed()

    a, place = shown(c, boundary, fill)
    df = a.once().df.withColumnRenamed("v", "_x")
    for k in c.kernel.values():
        df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(c.weight.sizes[k] - 1)).cast("array<bigint>")).alias(k))
    df = df.select(*[a for a in c.x.axes if a not in place], *c.kernel.values(), *[o.cast("bigint").alias(axis) for axis, o in place.items()], "_x")
    met = df.join(g.df.withColumnRenamed("v", "_g"), [a for a in c.out if a != c.made])
    to_w = Frame(met.select(*c.weight.axes, (F.col("_x") * F.col("_g")).alias("v")), c.weight.axes, c.weight.sizes, unique=False).summed()
    return to_x, to_w, g.summed([c.made])


def vjp_broadcast(grad: Frame, dim: str, source: int = 0) -> Frame:
    """Of copying rank `source`'s values to all ranks of `dim`: their sum on that rank, nothing on the others."""
    df = grad.df.withColumn(partial_column(dim), F.lit(source))
    return replace(grad, df=df.select(*grad.keys, *grad.values), unique=False).summed()


def broadcast(x: Frame, dim: str, source: int = 0) -> Frame:
    """Every rank of partial dimension `dim` gets the values of rank `source`."""
    n = x.mesh.size(dim)
    df = x.df.where(F.col(partial_column(dim)) == source).withColumn(partial_column(dim), F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return x.with_df(df.select(*x.keys, *x.values))
