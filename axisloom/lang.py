"""The formula language: axes, placements, partial sums, groups, families, ellipsis and annotations.

    a/sp b/dp, b/dp c -> a/sp c // tp

An operand is a row of axes; `a/sp` lies in intervals along mesh dimension `sp`, `(h p)` is one stored axis made of two, `...`
stands for axes without names, `// tp` says that values of different `tp` add up. `[param, grad=…, init_sync=…]` after an
input notes duties of a persistent frame. `*f` stands for the axes of family f, `[*f *g]` for the groups (f1 g1) (f2 g2) ….
Names are letters, digits and underscores; mesh dimensions may be products, `dp-sp`.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache


@dataclass(frozen=True)
class Axis:
    name: str
    shard: str | None = None

    def __str__(self) -> str:
        return f"{self.name}/{self.shard}" if self.shard else self.name


@dataclass(frozen=True)
class Group:
    """One stored axis, the row-major product of its parts."""

    parts: tuple[Axis, ...]

    def __str__(self) -> str:
        return f"({' '.join(map(str, self.parts))})"


@dataclass(frozen=True)
class Rest:
    """`...`: axes that the formula doesn't name."""

    def __str__(self) -> str:
        return "..."


@dataclass(frozen=True)
class GradDuty:
    """How gradients of a persistent frame are summed: over explicit dimensions, or as named by the mode."""

    mode: str = "infer"  # infer, none, external, ddp, explicit
    dims: tuple[str, ...] = ()
    backend: str = "native"  # native, ddp, external
    deferred: bool = False  # `async`


@dataclass(frozen=True)
class Note:
    """[param, grad=…, init_sync=…]"""

    grad: GradDuty | None = None
    init: tuple[str, tuple[str, ...]] | None = None  # (none | external | explicit, dims)


@dataclass(frozen=True)
class Spec:
    items: tuple[Axis | Group | Rest, ...]
    partials: tuple[str, ...] = ()
    note: Note | None = None

    @property
    def axes(self) -> tuple[Axis, ...]:
        """All named axes, groups opened."""
        return tuple(a for i in self.items for a in (i.parts if isinstance(i, Group) else (i,) if isinstance(i, Axis) else ()))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.axes)

    @property
    def open(self) -> bool:
        return any(isinstance(i, Rest) for i in self.items)

    @property
    def grouped(self) -> bool:
        return any(isinstance(i, Group) for i in self.items)

    def placement(self, name: str) -> str | None:
        return next((a.shard for a in self.axes if a.name == name), None)

    @property
    def dims(self) -> tuple[str, ...]:
        """Mesh dimensions in use, parts of products included."""
        found = [d for a in self.axes if a.shard for d in a.shard.split("-")] + [d for p in self.partials for d in p.split("-")]
        return tuple(dict.fromkeys(found))

    def __str__(self) -> str:
        tail = "" if not self.partials else f" // {self.partials[0]}" if len(self.partials) == 1 else f" // ({','.join(self.partials)})"
        return " ".join(map(str, self.items)) + tail


@dataclass(frozen=True)
class Formula:
    inputs: tuple[Spec, ...]
    output: Spec
    text: str = field(default="", compare=False)

    @property
    def local(self) -> bool:
        return not any(s.dims for s in (*self.inputs, self.output))

    def __str__(self) -> str:
        return f"{', '.join(map(str, self.inputs))} -> {self.output}"


_TOKEN = re.compile(r"\s*(->|//|\.\.\.|[A-Za-z0-9_]+|[/(),\[\]=:-])")


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        body = text.rstrip()
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                self.fail(f"unexpected {body[at:].strip()[:1]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def fail(self, why: str):
        raise ValueError(f"Invalid formula {self.text!r}: {why}")

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if t is None or wanted and t not in wanted:
            self.fail(f"expected {' or '.join(wanted) or 'more'}, found {t!r}")
        self.at += 1
        return t

    def maybe(self, token: str) -> bool:
        if self.peek() == token:
            self.at += 1
            return True
        return False

    def name(self) -> str:
        t = self.take()
        if not re.fullmatch(r"\w+", t):
            self.fail(f"{t!r} isn't a name")
        return t

    def dim(self) -> str:
        parts = [self.name()]
        while self.maybe("-"):
            parts.append(self.name())
        return "-".join(parts)

    def axis(self) -> Axis:
        name = self.name()
        return Axis(name, self.dim() if self.maybe("/") else None)

    def dims(self) -> tuple[str, ...]:
        if not self.maybe("("):
            return (self.dim(),)
        found = [self.dim()]
        while self.maybe(","):
            found.append(self.dim())
        self.take(")")
        return tuple(found)

    def spec(self) -> Spec:
        items: list[Axis | Group | Rest] = []
        while (t := self.peek()) is not None and t not in (",", "->", "//", "["):
            if self.maybe("..."):
                if any(isinstance(i, Rest) for i in items):
                    self.fail("one ellipsis at most in an operand")
                items.append(Rest())
            elif self.maybe("("):
                parts = [self.axis()]
                while not self.maybe(")"):
                    if self.peek() == "(":
                        self.fail("groups don't nest")
                    parts.append(self.axis())
                items.append(Group(tuple(parts)))
            else:
                items.append(self.axis())
        if not items:
            self.fail("an operand needs an axis")
        partials = self.dims() if self.maybe("//") else ()
        if len(set(partials)) != len(partials):
            self.fail("a partial dimension appears more than once")
        return Spec(tuple(items), partials, self.note() if self.peek() == "[" else None)

    def note(self) -> Note:
        self.take("[")
        if self.take() != "param":
            self.fail("an annotation begins with param")
        got: dict[str, object] = {}
        while self.maybe(","):
            key = self.take("grad", "init_sync")
            if key in got:
                self.fail(f"{key} appears more than once")
            self.take("=")
            got[key] = self.grad() if key == "grad" else self.init()
        self.take("]")
        return Note(got.get("grad"), got.get("init_sync"))

    def grad(self) -> GradDuty:
        if self.peek() == "(":
            dims = self.dims()
        else:
            word = self.dim()
            if word in ("none", "external"):
                return GradDuty(word, backend="external" if word == "external" else "native")
            if word == "ddp":
                return GradDuty("ddp", backend="ddp")
            if word == "async":
                return GradDuty("infer", deferred=True)
            dims = (word,)
        how = self.take("async", "ddp", "external") if self.maybe(":") else ""
        return GradDuty("explicit", dims, how if how in ("ddp", "external") else "native", how == "async")

    def init(self) -> tuple[str, tuple[str, ...]]:
        dims = self.dims()
        return (dims[0], ()) if dims in (("none",), ("external",)) else ("explicit", dims)


@lru_cache(maxsize=2048)
def parse(text: str) -> Formula:
    """One or two inputs and an output; the parts are immutable, so that the cache can share them."""
    r = _Reader(text)
    inputs = [r.spec()]
    while r.maybe(","):
        inputs.append(r.spec())
    if len(inputs) > 2:
        r.fail("two inputs at most; chain formulas for more")
    r.take("->")
    output = r.spec()
    if r.peek() is not None:
        r.fail(f"unexpected {r.peek()!r}")
    if output.note:
        r.fail("outputs have no annotations")
    if len(set(output.names)) != len(output.names):
        r.fail("an output axis appears more than once")
    return Formula(tuple(inputs), output, text)


@lru_cache(maxsize=1024)
def parse_spec(text: str) -> Spec:
    """A single operand, as in a layout."""
    r = _Reader(text)
    spec = r.spec()
    if r.peek() is not None:
        r.fail(f"unexpected {r.peek()!r}")
    return spec


# --- families ---------------------------------------------------------------------------------------------------

_ZIP = re.compile(r"\[([^\[\]]*)\]")
_MEMBER = re.compile(r"\*(\w+)")
_NOTE_ITEM = re.compile(r"\s*(param|grad\s*=.*|init_sync\s*=.*)\s*")


def _family(families: Mapping[str, Sequence[str]], name: str) -> list[str]:
    if name not in families:
        raise ValueError(f"Unknown axis family {name!r}")
    value = families[name]
    return value.split() if isinstance(value, str) else list(value)


def expand_families(text: str, families: Mapping[str, Sequence[str]] | None) -> str:
    """`text` with `*f` and `[*f *g]` written out; unchanged without families."""
    if not families:
        return text

    def zipped(m: re.Match) -> str:
        body = m[1]
        if all(_NOTE_ITEM.fullmatch(x) for x in re.split(r",(?![^(]*\))", body)):
            return m[0]
        columns = [_family(families, w[1:]) if w.startswith("*") else [w] for w in body.split()]
        if len({len(c) for c in columns}) > 1:
            raise ValueError(f"Zipped axis families need matching lengths: {body!r}")
        return " ".join(f"({' '.join(row)})" for row in zip(*columns, strict=True))

    return _MEMBER.sub(lambda m: " ".join(_family(families, m[1])), _ZIP.sub(zipped, text))


def per_axis(values: Mapping | None, families: Mapping[str, Sequence[str]] | None = None) -> dict:
    """Options by axis: those of a family go to its axes, one to all or, as a sequence, one to each."""
    out: dict = {}

    def put(key: str, value) -> None:
        if key in out and out[key] != value:
            raise ValueError(f"Conflicting values for axis {key!r}")
        out[key] = value

    for key, value in (values or {}).items():
        if families and key in families:
            axes = [a.split("/")[0].strip() for a in _family(families, key)]
            if isinstance(value, (list, tuple)):
                if len(value) != len(axes):
                    raise ValueError(f"Family {key!r} has {len(axes)} axes but {len(value)} values: matching lengths are needed")
                for a, v in zip(axes, value, strict=True):
                    put(a, v)
            else:
                for a in axes:
                    put(a, value)
        else:
            put(key, value)
    return out
