"""Persistent frames: layouts, and duties to synchronise initial values and to sum gradients.

A registry maps names to what a layout such as `o/tp c` and an annotation say. Registering several names happens whole or not at
all. Synchronising takes rank 0's rows along the duty's dimensions; reducing adds up rows over them. All of it is queries on
frames whose ranks are partial dimensions, or plain arithmetic on plans.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

from .frame import Frame, partial_column
from .lang import GradDuty, Note, Spec, parse, parse_spec
from .mesh import Mesh, split_sizes, split_sizes_of_factors, starts
from .operators.adjoint import broadcast


@dataclass(frozen=True)
class InitSync:
    """Over which dimensions initial values are copied: none, external, explicit, or inferred (all that shard nothing)."""

    mode: str = "inferred"
    dims: tuple[str, ...] = ()

    def groups(self, state: State, mesh: Mesh) -> tuple[str, ...]:
        if self.mode == "explicit":
            return self.dims
        return () if self.mode != "inferred" else tuple(d for d in mesh.names if d not in state.shards)


@dataclass(frozen=True)
class State:
    """What is known of one persistent frame."""

    spec: Spec
    init: InitSync = field(default_factory=InitSync)
    grad: GradDuty | None = None

    @property
    def axes(self) -> tuple[str, ...]:
        return self.spec.names

    @property
    def shards(self) -> tuple[str, ...]:
        """Mesh dimensions that cut the frame, factors of products."""
        return tuple(d for a in self.spec.axes if a.shard for d in a.shard.split("-"))

    @property
    def reduce(self) -> tuple[str, ...]:
        """Dimensions over which gradients are summed."""
        return self.grad.dims if self.grad and self.grad.mode in ("explicit", "inferred") else ()

    @property
    def pending(self) -> bool:
        """Whether the duty still waits for a formula to tell its dimensions."""
        return self.grad is None or self.grad.mode == "infer"

    def shared(self, mesh: Mesh) -> tuple[str, ...]:
        return self.init.groups(self, mesh)


def state_of(layout: str | Spec, note: Note | None = None) -> State:
    """From a layout; duties come from its annotation."""
    spec = parse_spec(layout) if isinstance(layout, str) else layout
    note = note or spec.note
    init = InitSync() if note is None or note.init is None else InitSync(*note.init)
    state = State(Spec(spec.items), init, note.grad if note else None)
    _validate(state)
    return state


def _parts(dims: Iterable[str]) -> list[str]:
    return [p for d in dims for p in d.split("-")]


def _validate(s: State) -> None:
    if s.spec.open:
        raise ValueError("a layout names all axes")
    if len(set(s.shards)) != len(s.shards):
        raise ValueError(f"`{s.spec}` cuts two axes along one mesh dimension")
    duties = [("initial values", s.init.dims if s.init.mode == "explicit" else ())]
    if s.grad and s.grad.backend != "external":
        duties.append(("gradients", s.grad.dims))
    for what, dims in duties:
        parts = _parts(dims)
        if len(set(parts)) != len(parts):
            raise ValueError(f"groups for {what} of `{s.spec}` overlap")
        if set(parts) & set(s.shards):
            raise ValueError(f"groups for {what} of `{s.spec}` overlap its shards")


def merge(old: State, new: State) -> State:
    """Both say the same, or one says more; else ValueError."""
    if old.spec != new.spec:
        raise ValueError(f"layouts `{old.spec}` and `{new.spec}` conflict")
    init = old.init if new.init.mode == "inferred" else new.init
    if "inferred" not in (old.init.mode, new.init.mode) and old.init != new.init:
        raise ValueError(f"duties for initial values of `{old.spec}` conflict")
    a, b = old.grad, new.grad
    if a is None or b is None:
        grad = a or b
    elif a.mode == "infer" or b.mode == "infer":
        grad = b if a.mode == "infer" else a
        grad = replace(grad, deferred=a.deferred or b.deferred)
    elif a.mode == b.mode == "inferred":
        grad = replace(a, dims=tuple(dict.fromkeys((*a.dims, *b.dims))))
    elif {a.mode, b.mode} == {"explicit", "inferred"}:
        grad = a if a.mode == "explicit" else b
        if set(_parts((a if grad is b else b).dims)) - set(_parts(grad.dims)):
            raise ValueError(f"a formula needs sums over more than the stated dimensions of `{old.spec}`")
    elif a != b:
        raise ValueError(f"duties for gradients of `{old.spec}` conflict")
    else:
        grad = a
    out = State(old.spec, init, grad)
    _validate(out)
    return out


def inferred(state: State, formula: str, operand: int) -> GradDuty:
    """Dimensions that cut other axes of a formula, or that its output is partial over, but don't cut this operand."""
    f = parse(formula)
    found = []
    for k, s in enumerate((*f.inputs, f.output)):
        if k != operand:
            found += [a.shard for a in s.axes if a.shard and a.name not in state.axes]
    found += f.output.partials
    own = set(state.shards)
    dims = tuple(dict.fromkeys(p for p in _parts(found) if p not in own))
    return GradDuty("inferred", dims, deferred=bool(state.grad and state.grad.deferred))


#: Default layouts of kernels by number of axes.
CONV_LAYOUTS = {3: "o c k", 4: "o c kh kw", 5: "o c kd kh kw"}


@dataclass
class Registry:
    states: dict[str, State] = field(default_factory=dict)

    def get(self, name: str) -> State | None:
        return self.states.get(name)

    def __iter__(self):
        return iter(self.states.items())

    def register(self, layouts: Mapping[str, str | Spec | State], ranks: Mapping[str, int] | None = None) -> None:
        """All or nothing. `ranks`: numbers of axes to hold the layouts against."""
        new = {}
        for name, layout in layouts.items():
            state = layout if isinstance(layout, State) else state_of(layout)
            if ranks and name in ranks and ranks[name] != len(state.axes):
                raise ValueError(f"{name!r} has {ranks[name]} axes, `{state.spec}` has {len(state.axes)}")
            new[name] = merge(self.states[name], state) if name in self.states else state
        self.states |= new

    def register_linear(self, name: str, layout: str = "o c", bias: str | None = None, has_bias: bool = True) -> None:
        """Weight and bias; the bias lies as the weight's first axis."""
        spec = parse_spec(layout)
        wanted = {f"{name}.weight": spec}
        if has_bias:
            wanted[f"{name}.bias"] = parse_spec(bias) if bias else Spec(spec.items[:1], note=spec.note)
        self.register(wanted)

    def register_conv(self, name: str, rank: int = 4, layout: str | None = None, bias: str | None = None, has_bias: bool = True) -> None:
        if layout is None and rank not in CONV_LAYOUTS:
            raise ValueError(f"no default layout for a kernel of {rank} axes")
        self.register_linear(name, layout or CONV_LAYOUTS[rank], bias, has_bias)

    def register_norm(self, name: str, layout: str = "c", has_bias: bool = True) -> None:
        spec = parse_spec(layout)
        self.register({f"{name}.weight": spec, **({f"{name}.bias": spec} if has_bias else {})})

    def register_operand(self, name: str, formula: str, operand: int) -> None:
        """From an annotated operand of a formula; dimensions that it leaves open follow from the formula."""
        spec = parse(formula).inputs[operand]
        if spec.note is None:
            raise ValueError(f"operand {operand} of `{formula}` has no annotation")
        state = state_of(spec)
        if state.pending:
            state = replace(state, grad=inferred(state, formula, operand))
        self.register({name: state})

    def finalize(self, dims: Mapping[str, Sequence[str]] | None = None) -> None:
        """Settles duties that no formula told: to `dims`, or to none. All or nothing."""
        done = {n: replace(s, grad=GradDuty("inferred", tuple((dims or {}).get(n, ())))) for n, s in self.states.items() if s.pending}
        for s in done.values():
            _validate(s)
        self.states |= done

    def validate(self, names: Iterable[str], mesh: Mesh | None = None) -> None:
        """Every name is known and settled, and the mesh has its dimensions."""
        for n in names:
            if n not in self.states:
                raise ValueError(f"{n!r} isn't registered")
            if self.states[n].pending:
                raise ValueError(f"gradient dimensions of {n!r} are pending")
            for d in (*self.states[n].shards, *self.states[n].reduce, *self.states[n].init.dims):
                if mesh:
                    mesh.parts(d)

    def init(self, name: str, x: Frame) -> Frame:
        """Copies of rank 0 along the dimensions of the duty that `x` is spread over."""
        state = self.states[name]
        for d in _parts(state.shared(x.mesh)):
            if d in x.partials:
                x = broadcast(x, d, 0)
        return x

    sync = init

    def reduce_grad(self, name: str, grad: Frame) -> Frame:
        """Gradients summed over the duty's dimensions."""
        state = self.states[name]
        if state.pending:
            raise ValueError(f"gradient dimensions of {name!r} are pending")
        if state.grad.mode in ("none", "external", "ddp") or state.grad.backend != "native":
            return grad
        over = set(_parts(state.reduce))
        return grad.summed(partials=[p for p in grad.partials if not set(p.split("-")) <= over])

    def reduce_mean(self, name: str, grad: Frame, group: str = "dp") -> Frame:
        """As a data-parallel trainer does: the mean over `group`, then sums over the duty's other dimensions; one aggregate."""
        over = {group, *_parts(self.states[name].reduce)} - set(self.states[name].shards)
        n = grad.mesh.size(group)
        out = grad.summed(partials=[p for p in grad.partials if p not in over])
        return out.with_df(out.df.select(*out.keys, *[(F.col(v) / n).alias(v) for v in out.values]))


# --- slices -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Slices:
    """A rank's part of a whole shape."""

    whole: tuple[int, ...]
    part: tuple[int, ...]
    slices: tuple[tuple[int, int], ...]


def shard_dims(layout: str | Spec) -> tuple[str | None, ...]:
    spec = parse_spec(layout) if isinstance(layout, str) else layout
    return tuple(a.shard for a in spec.axes)


def local_slices(layout: str | Spec, shape: Sequence[int], mesh: Mesh, rank: Mapping[str, int], factors: Mapping[str, int] | None = None) -> Slices:
    """Where a rank's part begins and ends along each axis; `factors` keeps blocks of an axis whole."""
    spec = parse_spec(layout) if isinstance(layout, str) else layout
    if len(shape) != len(spec.axes):
        raise ValueError(f"`{spec}` has {len(spec.axes)} axes, the shape {len(shape)}")
    out = []
    for a, n in zip(spec.axes, shape, strict=True):
        if not a.shard:
            out.append((0, n))
            continue
        k = mesh.size(a.shard)
        sizes = split_sizes_of_factors(n, k, factors[a.name]) if factors and a.name in factors else split_sizes(n, k)
        i = mesh.index(a.shard, rank)
        out.append((starts(sizes)[i], starts(sizes)[i] + sizes[i]))
    return Slices(tuple(shape), tuple(b - a for a, b in out), tuple(out))


def slices_table(spark, layout: str | Spec, shape: Sequence[int], mesh: Mesh, factors: Mapping[str, int] | None = None):
    """(rank coordinates…, axis, start, stop) of all ranks: as many rows as the mesh has ranks and the layout axes."""
    spec = parse_spec(layout) if isinstance(layout, str) else layout
    rows = [(*rank.values(), a.name, *s) for rank in mesh.ranks() for a, s in zip(spec.axes, local_slices(spec, shape, mesh, rank, factors).slices, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"`{d}` int" for d in mesh.names) + ", axis string, start bigint, stop bigint")


def spread(x: Frame, dim: str, values: Sequence[float]) -> Frame:
    """`x` on every rank of `dim`, times a factor of its own: test and example data for duties."""
    rank = F.posexplode(F.array(*[F.lit(float(v)) for v in values])).alias("_r", "_f")
    df = x.df.select("*", rank).select(*x.axes, *map(partial_column, x.partials), F.col("_r").alias(partial_column(dim)), *[(F.col(v) * F.col("_f")).alias(v) for v in x.values])
    return replace(x, df=df, partials=(*x.partials, dim))
