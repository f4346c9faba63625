"""Contractions, products, reductions, diagonals, permutations, reshapes and relayouts: whatever a formula says.

One input: diagonal, sum of missing axes, reshape, relayout. Two: each operand sums what only it has before the join (eager
aggregation, which Catalyst leaves above it), shared axes are an equi-join, and what neither output nor partial keeps is
summed after it, repeated coordinates as well; without anything to sum there is no aggregate. An operand whose known sizes prove it small is
broadcast, else adaptive execution decides. A reshape is arithmetic on coordinates, never a join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from math import prod

from pyspark.sql import functions as F

from ..frame import Frame, partial_column
from ..lang import Formula, Group, Rest, Spec, expand_families, parse, per_axis
from ..mesh import Mesh, resolve_sizes, shard_of
from ..plans.planner import plan_of


def factor_sizes(parts: list[str], known: Mapping[str, int], total: int | None, what: str) -> dict[str, int]:
    """Sizes of a group's parts; one at most follows from the size of the whole."""
    unknown = [p for p in parts if p not in known]
    have = prod(known[p] for p in parts if p in known)
    if len(unknown) > 1:
        raise ValueError(f"Cannot infer multiple factor sizes of {what}: {', '.join(unknown)}")
    if unknown:
        if total is None:
            raise ValueError(f"the size of {what} is unknown")
        if have == 0 or total % have:
            raise ValueError(f"{what} of size {total} isn't divisible by {have}")
        return {**{p: known[p] for p in parts if p in known}, unknown[0]: total // have}
    if total is not None and have != total:
        raise ValueError(f"Factor sizes multiply to {have}, {what} has size {total}")
    return {p: known[p] for p in parts}


def bind(spec: Spec, frame: Frame, sizes: Mapping[str, int]) -> Frame:
    """`frame` with the names of `spec`: axes by position, groups opened, diagonals taken. Unnamed axes become `_e0`, `_e1`, … from the right."""
    stored = len(frame.axes)
    fixed = sum(not isinstance(i, Rest) for i in spec.items)
    if stored < fixed or stored > fixed and not spec.open:
        raise ValueError(f"`{spec}` has {fixed} axes, its operand has {stored}: {' '.join(frame.axes)}")
    items: list = []
    for i in spec.items:
        items += [f"_e{k}" for k in reversed(range(stored - fixed))] if isinstance(i, Rest) else [i]
    columns, names, found, equal = [], [], {}, []
    placements: dict[str, str] = {}
    for axis, item in zip(frame.axes, items, strict=True):
        c = F.col(axis)
        if isinstance(item, Group):
            parts = [p.name for p in item.parts]
            known = {p: sizes[p] for p in parts if p in sizes}
            total = frame.sizes.get(axis)
            if total is None and len(known) < len(parts) - 0 and len(parts) > 1 and parts[0] in known:
                total = frame.size(axis)
            if total is None and [p for p in parts if p not in known] == parts[:1]:
                of = known  # the first part's size isn't needed to find coordinates
            else:
                of = factor_sizes(parts, known, total, str(item))
            below = 1
            opened = []
            for k, p in reversed(list(enumerate(parts))):
                x = F.floor(c / below) if below > 1 else c
                opened.append((p, (x if k == 0 else F.pmod(x, F.lit(of[p]))).cast("bigint")))
                below *= of.get(p, 1)
            found |= {p: n for p, n in of.items()}
            entries = list(reversed(opened))
        else:
            name = item if isinstance(item, str) else item.name
            if not isinstance(item, str) and item.shard:
                placements[name] = item.shard
            if axis in frame.sizes:
                if found.get(name, frame.sizes[axis]) != frame.sizes[axis]:
                    raise ValueError(f"axis {name!r} has sizes {found[name]} and {frame.sizes[axis]}")
                found[name] = frame.sizes[axis]
            entries = [(name, c)]
        for name, x in entries:
            if name in names:
                equal.append(x == columns[names.index(name)])
            else:
                names.append(name)
                columns.append(x)
    df = frame.df
    for e in equal:
        df = df.where(e)
    df = df.select(*[c.alias(n) for n, c in zip(names, columns, strict=True)], *map(partial_column, frame.partials), *frame.values)
    wrong = {a: d for a, d in frame.placements.items() if a in frame.axes}
    claimed = [i.shard if not isinstance(i, (str, Group)) else None for i in items]
    if wrong and [wrong.get(a) for a in frame.axes] != claimed:
        raise ValueError(f"`{spec}` places axes otherwise than its operand: {wrong}")
    splits = {(d, (items[k] if isinstance(items[k], str) else items[k].name)): s for (d, a), s in frame.splits.items() for k in [frame.axes.index(a)] if a in frame.axes and not isinstance(items[k], Group)}
    return replace(frame, df=df, axes=tuple(names), sizes=found, placements=placements, splits=splits)


def close(frame: Frame, spec: Spec, rest: list[str]) -> Frame:
    """`frame` in the order of an output spec: groups packed, unnamed axes in their place."""
    columns, names, sizes = [], [], {}
    for item in spec.items:
        if isinstance(item, Rest):
            columns += map(F.col, rest)
            names += rest
            sizes |= {a: frame.sizes[a] for a in rest if a in frame.sizes}
        elif isinstance(item, Group):
            parts = [p.name for p in item.parts]
            for p in parts[1:]:
                if p not in frame.sizes:
                    frame = frame.measured(p)
            x = F.col(parts[0])
            for p in parts[1:]:
                x = x * frame.sizes[p] + F.col(p)
            columns.append(x.cast("bigint"))
            names.append("_".join(parts))
            if all(p in frame.sizes for p in parts):
                sizes[names[-1]] = prod(frame.sizes[p] for p in parts)
        else:
            columns.append(F.col(item.name))
            names.append(item.name)
            if item.name in frame.sizes:
                sizes[item.name] = frame.sizes[item.name]
    df = frame.df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], *map(partial_column, frame.partials), *frame.values)
    return replace(frame, df=df, axes=tuple(names), sizes=sizes)


def prepared(formula: str, families=None, sizes=None) -> tuple[Formula, dict[str, int]]:
    return parse(expand_families(formula, families)), per_axis(sizes, families)


def _check(f: Formula, frames: tuple[Frame, ...], mesh: Mesh | None) -> None:
    if len(frames) != len(f.inputs):
        raise ValueError(f"`{f}` takes {len(f.inputs)} operands, not {len(frames)}")
    known = {n for s in f.inputs for n in s.names}
    for name in f.output.names:
        if name not in known:
            raise ValueError(f"Output dimension {name!r} must be present in input")
    if f.output.open and not any(s.open for s in f.inputs):
        raise ValueError("an ellipsis in the output needs one in an input")
    if not f.local:
        if mesh is None:
            raise ValueError("Distributed formulas require a mesh")
        if any(s.grouped for s in (*f.inputs, f.output)):
            raise ValueError("Factored axes are supported only in local formulas")
        for s in (*f.inputs, f.output):
            for d in s.dims:
                mesh.parts(d)


def contract(formula: str, *frames: Frame, mesh: Mesh | None = None, shapes=None, sizes=None, families=None, optimize=None, policy=None, kernel: str = "join") -> Frame:
    """The frame that `formula` makes of one or two frames. Nothing runs until an action, but for sizes that must be counted.

    `sizes` of group parts, `shapes` of intervals (default: the split rule), `families` of axes; `optimize` and `policy`
    rank the plan's alternatives for `explain`. `kernel="blocks"` multiplies matrices in dense blocks.
    """
    f, given = prepared(formula, families, sizes)
    _check(f, frames, mesh)
    plan = plan_of(f, mesh, optimize=optimize, policy=policy)
    bound = [bind(s, x, given) for s, x in zip(f.inputs, frames, strict=True)]
    for name in set(bound[0].sizes) & set(bound[-1].sizes):
        if bound[0].sizes[name] != bound[-1].sizes[name]:
            raise ValueError(f"axis {name!r} has sizes {bound[0].sizes[name]} and {bound[-1].sizes[name]}")
    names = {a for b in bound for a in b.axes}
    rest = sorted((a for a in names if a.startswith("_e")), key=lambda a: -int(a[2:])) if f.output.open else []
    kept = [a for i in f.output.items for a in (rest if isinstance(i, Rest) else [p.name for p in i.parts] if isinstance(i, Group) else [i.name])]
    out = _one(f, bound[0], kept, mesh, shapes) if len(bound) == 1 else _two(f, bound, kept, mesh, shapes, kernel)
    out = replace(out, sizes={**given, **out.sizes})
    out = close(out, f.output, rest)
    placements = {a.name: mesh.normal(a.shard) for a in f.output.axes if a.shard}
    splits = {}
    for a, d in placements.items():
        if shapes is not None or a in out.sizes:
            # An axis that stays where it was keeps its intervals.
            old = next((b.splits.get((d, a)) for b in bound if b.splits.get((d, a))), None)
            splits[d, a] = old if shapes is None and old else resolve_sizes(shapes, d, a, out.sizes.get(a), mesh.size(d))
    return replace(out, placements=placements, splits=splits, mesh=mesh or next((x.mesh for x in frames if x.mesh), None), steps=plan.steps)


def _one(f: Formula, x: Frame, kept: list[str], mesh: Mesh | None, shapes) -> Frame:
    spec = f.inputs[0]
    removed = [p for p in spec.partials if p not in f.output.partials]
    if set(x.partials) != set(spec.partials):
        raise ValueError(f"`{spec}` and its operand differ in partial dimensions: {', '.join(x.partials) or 'none'}")
    if set(kept) != set(x.axes) or removed or not x.unique:
        x = x.summed([a for a in x.axes if a in kept], [p for p in x.partials if p not in removed])
    for p in f.output.partials:
        if p not in spec.partials:  # every rank holds the whole value, so a later sum over p counts it once for each
            n = mesh.size(p)
            x = replace(x, df=x.df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(partial_column(p))), partials=(*x.partials, p))
    return x


def _two(f: Formula, bound: list[Frame], kept: list[str], mesh: Mesh | None, shapes, kernel: str) -> Frame:
    if any(s.partials for s in f.inputs) or any(x.partials for x in bound):
        raise ValueError("operands of a product can't be partial; reduce them first")
    x, y = bound
    shared = [a for a in x.axes if a in y.axes]
    keys = dict.fromkeys(f.output.partials)
    owner: dict[str, tuple[str, str]] = {}  # partial dimension -> (axis, its own placement)
    for k, (a, b, spec) in enumerate(((x, y, f.inputs[0]), (y, x, f.inputs[1]))):
        for ax in spec.axes:
            if not ax.shard or ax.name in kept:
                continue
            if ax.name not in b.axes and ax.shard not in keys:
                raise ValueError(f"axis {ax.name!r} is summed on each rank of {ax.shard!r} alone; the output must be partial over it")
            owner.setdefault(ax.shard, (ax.name, ax.shard))
    for p in keys:
        if p not in owner:
            raise ValueError(f"nothing is summed over {p!r}, so the output isn't partial over it")
    # Eager sums: axes of one operand alone that the output drops, unless a partial key needs them.
    needed = {owner[p][0] for p in keys}
    sides = []
    for a, b in ((x, y), (y, x)):
        stay = [n for n in a.axes if n in kept or n in b.axes or n in needed]
        # Repeated coordinates may wait for the last sum where the join gives each of their rows one partner at most.
        waits = b.unique and set(b.axes) <= set(a.axes)
        sides.append(a.summed(stay) if len(stay) < len(a.axes) or not (a.unique or waits) else a)
    x, y = sides
    sizes = {**x.sizes, **y.sizes}
    if kernel == "blocks":
        from .blocks import multiplied

        if keys:
            raise ValueError("blocks keep no partial sums")
        return multiplied(x, y, kept, shared)
    left, right = x.df, y.df
    for v in x.values:
        left = left.withColumnRenamed(v, f"_x_{v}")
    for v in y.values:
        right = right.withColumnRenamed(v, f"_y_{v}")
    if y.small():
        right = F.broadcast(right)
    elif x.small():
        left = F.broadcast(left)
    joined = left.join(right, shared) if shared else left.crossJoin(right)
    part = lambda n, v, s: F.col(f"_{n}_{v}") if s.complex else F.col(f"_{n}_v") if v == "re" else F.lit(0.0)
    if x.complex or y.complex:
        a, b, c, d = part("x", "re", x), part("x", "im", x), part("y", "re", y), part("y", "im", y)
        values = {"re": a * c - b * d, "im": a * d + b * c}
    else:
        values = {"v": F.col("_x_v") * F.col("_y_v")}
    picked = []
    for p in keys:
        axis, dim = owner[p]
        n = sizes.get(axis) or next(s for s in sides if axis in s.axes).size(axis)
        picked.append(shard_of(F.col(axis), resolve_sizes(shapes, dim, axis, n, mesh.size(p))).alias(partial_column(p)))
    df = joined.select(*kept, *picked, *[e.alias(n) for n, e in values.items()])
    out = Frame(df, tuple(kept), {a: n for a, n in sizes.items() if a in kept}, tuple(values), partials=tuple(keys), unique=True)
    if set(x.axes) | set(y.axes) != set(kept) or not (x.unique and y.unique):
        out = out.summed()
    if keys:
        both = {a.shard: a.name for a in f.output.axes if a.shard in keys}
        for p, axis in both.items():  # a rank keeps its own interval of its own contribution
            n = out.sizes.get(axis) or out.size(axis)
            out = out.where(shard_of(F.col(axis), resolve_sizes(shapes, p, axis, n, mesh.size(p))) == F.col(partial_column(p)))
    return out


def check(formula: str, *shapes_or_frames, mesh: Mesh | None = None, sizes=None, families=None) -> None:
    """Raises what `contract` would raise about the formula, ranks and mesh, without touching data."""
    f, _ = prepared(formula, families, sizes)
    _check(f, shapes_or_frames, mesh)
    for spec, x in zip(f.inputs, shapes_or_frames, strict=True):
        rank = len(x.axes) if isinstance(x, Frame) else len(x)
        fixed = sum(not isinstance(i, Rest) for i in spec.items)
        if rank < fixed or rank > fixed and not spec.open:
            raise ValueError(f"`{spec}` has {fixed} axes, its operand has {rank}")
    if len(f.inputs) == 2 and any(s.partials for s in f.inputs):
        raise ValueError("operands of a product can't be partial; reduce them first")
    plan_of(f, mesh)
