"""Fourier transforms along named axes: complex and real, forward and inverse, one axis after another.

`method="terms"` writes the transform as a contraction with a table of turns, n terms for each element, all of it SQL.
`"stages"` splits n = P Q into two such contractions with P + Q terms (Cooley-Tukey). `"lines"` gathers each line (one axis
long) and gives it to numpy in Arrow batches. `auto` takes terms up to 32 points, stages for lengths with factors up to 4096, lines beyond.
A line is as long as its axis: the only thing that must fit a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..frame import Frame
from ..lang import per_axis
from ..mesh import Mesh, resolve_sizes
from .contract import bind, prepared

NORMS = (None, "backward", "forward", "ortho")


def scale(n: int, norm: str | None, inverse: bool) -> float:
    if norm not in NORMS:
        raise ValueError(f"Invalid FFT norm {norm!r}")
    if norm == "ortho":
        return 1 / sqrt(n)
    return 1 / n if (norm == "forward") != inverse else 1.0


@dataclass(frozen=True)
class Explanation:
    """How a transform would run."""

    path: str
    fast: bool
    reason: str
    axes: tuple[tuple[str, str], ...]


def _pairs(axes, families) -> list[tuple[str, str]]:
    if isinstance(axes, Mapping):
        return [(k, v) for k, v in axes.items()] if not families else list(_renamed(axes, families).items())
    names = axes.split() if isinstance(axes, str) else list(axes)
    return [(a, a) for n in names for a in (families[n].split() if isinstance(families[n], str) else families[n]) if True] if families and any(n in families for n in names) else [(a, a) for a in names]


def _renamed(axes: Mapping, families) -> dict:
    out = {}
    for k, v in axes.items():
        if k in families:
            of = families.get(v, v) if isinstance(v, str) else v
            out |= per_axis({k: of.split() if isinstance(of, str) else list(of)}, families)
        else:
            out[k] = v
    return out


def _check(f, pairs: list[tuple[str, str]], mesh: Mesh | None) -> None:
    if len(f.inputs) != 1:
        raise ValueError("a transform takes one operand")
    source, out = f.inputs[0], f.output
    for s in (source, out):
        if s.partials:
            raise ValueError("transforms take no partial sums; reduce them first")
        if s.open or s.grouped:
            raise ValueError("transforms take named axes only: no ellipsis, no groups")
        if len(set(s.names)) != len(s.names):
            raise ValueError(f"an axis appears more than once in `{s}`")
    if len({a for a, _ in pairs}) != len(pairs) or len({b for _, b in pairs}) != len(pairs):
        raise ValueError("a transformed axis appears more than once")
    to = dict(pairs)
    if any(a not in source.names for a in to) or {to.get(n, n) for n in source.names} != set(out.names):
        raise ValueError(f"`{f}` doesn't follow from transforming {', '.join(to)}")
    if not f.local and mesh is None:
        raise ValueError("Distributed formulas require a mesh")
    for a in source.axes if to else ():  # without a transform only the order and the places change
        if a.name not in to and a.shard != out.placement(a.name):
            raise ValueError(f"axis {a.name!r} isn't transformed and can't change its placement")
    for s in (source, out):
        dims = [a.shard for a in s.axes if a.shard]
        if len(set(dims)) != len(dims):
            raise ValueError(f"two axes of `{s}` share a mesh dimension")


def method_of(n: int, method: str = "auto") -> str:
    if method != "auto":
        return method
    return "terms" if n <= 32 else "stages" if n <= 4096 and _factor(n) > 1 else "lines"


def explain_fft(formula: str, axes, sizes: Mapping[str, int], *, real: bool = False, inverse: bool = False, mesh: Mesh | None = None, families=None, method: str = "auto", signal_sizes: Mapping[str, int] | None = None) -> Explanation:
    """The path that `fft` would take, without touching data."""
    f, _ = prepared(formula, families)
    pairs = _pairs(axes, families)
    if not pairs:
        same = str(f.inputs[0]) == str(f.output)
        return Explanation("none" if same else "layout", True, "no axis is transformed", ())
    try:
        _check(f, pairs, mesh)
    except ValueError as e:
        return Explanation("unsupported", False, str(e), tuple(pairs))
    given = per_axis(signal_sizes, families)
    lengths = {a: sizes[a] for a, _ in pairs}
    if real and inverse:  # the last axis holds half a spectrum
        a, target = pairs[-1]
        lengths[a] = max(given.get(target, given.get(a, 2 * (sizes[a] - 1))), 1)
    kinds = {method_of(n, method) for n in lengths.values()}
    path = "lines" if "lines" in kinds else "stages" if "stages" in kinds else "terms"
    why = {"terms": "short axes: one contraction each", "stages": "lengths that factor: two contractions each", "lines": "long or prime lengths: whole lines in numpy"}[path]
    return Explanation(f"{'real ' if real else ''}{'inverse ' if inverse else ''}{path}", path != "lines", why, tuple(pairs))


def fft(formula: str, x: Frame, axes, *, inverse: bool = False, norm: str | None = None, real: bool = False, signal_sizes: Mapping[str, int] | None = None, mesh: Mesh | None = None, shapes=None, families=None, method: str = "auto") -> Frame:
    """The transform of `x` along `axes` (source -> target names, or names that stay). `real` keeps half of the last axis
    (forward), or takes half of it (inverse; `signal_sizes` gives its length, else 2 (m - 1))."""
    f, _ = prepared(formula, families)
    pairs = _pairs(axes, families)
    scale(1, norm, inverse)
    _check(f, pairs, mesh)
    b = bind(f.inputs[0], x, {})
    if real and not inverse and b.complex:
        raise ValueError("a real transform takes real values")
    given = per_axis(signal_sizes, families)
    if real and not inverse:
        order = [*pairs[-1:], *pairs[:-1]]
    else:
        order = pairs
    for k, (a, target) in enumerate(order):
        b = b.measured(a)
        n = b.sizes[a]
        last = real and (a, target) == pairs[-1]
        if last and inverse:
            length = given.get(target, given.get(a, 2 * (n - 1)))
            b = _half_inverse(b, a, target, length, norm, method_of(max(length, 1), method))
        else:
            kept = n // 2 + 1 if last else n
            b = _transform(b, a, target, n, kept, inverse, scale(n, norm, inverse), method_of(n, method))
    out = f.output.names
    df = b.df.select(*out, *b.values)
    places = {c.name: mesh.normal(c.shard) for c in f.output.axes if c.shard} if mesh else {}
    splits = {(d, c): resolve_sizes(shapes, d, c, b.sizes.get(c), mesh.size(d)) for c, d in places.items()}
    return replace(b, df=df, axes=tuple(out), placements=places, splits=splits, mesh=mesh)


def _parts(x: Frame) -> tuple[Column, Column]:
    return (F.col("re"), F.col("im")) if x.complex else (F.col("v").cast("double"), F.lit(0.0))


def _turned(re: Column, im: Column, turns: Column, n: int, sign: int) -> tuple[Column, Column]:
    """(re + i im) times e to the sign 2 pi i turns / n; `turns` is small and whole, so that the angle is exact."""
    angle = F.pmod(turns, F.lit(n)) * (sign * 2 * pi / n)
    c, s = F.cos(angle), F.sin(angle)
    return re * c - im * s, re * s + im * c


def _transform(x: Frame, a: str, target: str, n: int, kept: int, inverse: bool, factor: float, method: str) -> Frame:
    rest = [c for c in x.axes if c != a]
    sign = 1 if inverse else -1
    sizes = {**{c: m for c, m in x.sizes.items() if c != a}, target: kept}
    if n == 0:
        raise ValueError(f"axis {a!r} is empty")
    if method == "lines":
        return _lines(x, a, target, n, kept, inverse, factor, sizes)
    if method == "stages" and _factor(n) > 1:
        return _stages(x, a, target, n, kept, sign, factor, sizes)
    re, im = _parts(x)
    rows = x.df.select(*rest, F.col(a).alias("_n"), re.alias("_re"), im.alias("_im"), F.explode(F.sequence(F.lit(0), F.lit(kept - 1)).cast("array<bigint>")).alias(target))
    re, im = _turned(F.col("_re"), F.col("_im"), F.col("_n") * F.col(target), n, sign)
    df = rows.groupBy(*rest, target).agg((F.sum(re) * factor).alias("re"), (F.sum(im) * factor).alias("im"))
    return Frame(df, (*rest, target), sizes, ("re", "im"))


def _factor(n: int) -> int:
    """The divisor of n next to its root from below."""
    return next((p for p in range(int(sqrt(n)), 1, -1) if n % p == 0), 1)


def _stages(x: Frame, a: str, target: str, n: int, kept: int, sign: int, factor: float, sizes: dict[str, int]) -> Frame:
    p = _factor(n)
    q = n // p
    rest = [c for c in x.axes if c != a]
    re, im = _parts(x)
    # Element q s + m, first over s: to each of p places, then turned by its place times m.
    rows = x.df.select(*rest, F.floor(F.col(a) / q).alias("_s"), F.pmod(F.col(a), F.lit(q)).alias("_m"), re.alias("_re"), im.alias("_im"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("_k2"))
    re, im = _turned(F.col("_re"), F.col("_im"), F.col("_s") * F.col("_k2"), p, sign)
    first = rows.groupBy(*rest, "_m", "_k2").agg(F.sum(re).alias("_re"), F.sum(im).alias("_im"))
    re, im = _turned(F.col("_re"), F.col("_im"), F.col("_m") * F.col("_k2"), n, sign)
    rows = first.select(*rest, "_m", "_k2", re.alias("_re"), im.alias("_im"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("_k1"))
    re, im = _turned(F.col("_re"), F.col("_im"), F.col("_m") * F.col("_k1"), q, sign)
    rows = rows.select(*rest, (F.col("_k2") + p * F.col("_k1")).cast("bigint").alias(target), re.alias("_re"), im.alias("_im")).where(F.col(target) < kept)
    df = rows.groupBy(*rest, target).agg((F.sum("_re") * factor).alias("re"), (F.sum("_im") * factor).alias("im"))
    return Frame(df, (*rest, target), sizes, ("re", "im"))


def _lines(x: Frame, a: str, target: str, n: int, kept: int, inverse: bool, factor: float, sizes: dict[str, int]) -> Frame:
    rest = [c for c in x.axes if c != a]
    re, im = _parts(x)
    lines = x.once().df.select(*rest, F.col(a).cast("int").alias("_n"), re.alias("_re"), im.alias("_im")).groupBy(*rest).agg(*[F.collect_list(c).alias(c) for c in ("_n", "_re", "_im")])  # one line

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                at, u, v = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("_n", "_re", "_im"))  # noqa: B023
                line = np.zeros(n, complex)
                np.add.at(line, at, u + 1j * v)
                done = (np.fft.ifft(line) * n if inverse else np.fft.fft(line))[:kept] * factor
                head = [pa.array(np.full(kept, b.column(c)[r].as_py(), np.int64)) for c in rest]
                yield pa.record_batch([*head, pa.array(np.arange(kept, dtype=np.int64)), pa.array(done.real), pa.array(done.imag)], names=[*rest, target, "re", "im"])

    df = lines.mapInArrow(run, ", ".join(f"`{c}` bigint" for c in (*rest, target)) + ", re double, im double")
    return Frame(df, (*rest, target), sizes, ("re", "im"))


def half_weight(k: Column, n: int) -> Column:
    """How often a coefficient of half a spectrum counts: the other half is the mirror image, so inner points count twice."""
    return F.when((k == 0) | (k * 2 == n), 1.0).otherwise(2.0)


def _half_inverse(x: Frame, a: str, target: str, n: int, norm: str | None, method: str) -> Frame:
    """Real values from half a spectrum: the real part of the inverse transform of its weighed half alone."""
    if n < 1:
        raise ValueError("a signal has a point at least")
    rest = [c for c in x.axes if c != a]
    re, im = _parts(x)
    weight = half_weight(F.col(a), n)
    df = x.df.where(F.col(a) <= n // 2).select(*x.axes, (re * weight).alias("re"), (im * weight).alias("im"))
    full = _transform(replace(x, df=df, values=("re", "im")), a, target, n, n, True, scale(n, norm, True), method)
    return Frame(full.df.select(*rest, target, F.col("re").alias("v")), (*rest, target), full.sizes)


def turns(sizes: Sequence[int]) -> list[tuple[int, int, float, float]]:
    """(n, k, cos, sin) of all angles of transforms of these lengths."""
    return [(n, k, np.cos(2 * pi * k / n), np.sin(2 * pi * k / n)) for n in sizes for k in range(n)]
