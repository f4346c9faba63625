"""Meshes: named dimensions of ranks, products of them, and how an axis is cut into intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate, product
from math import ceil, prod

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mesh:
    """Sizes of mesh dimensions, in order; `dp-sp` is the product of two, row-major in the order of the mesh."""

    dims: tuple[tuple[str, int], ...]

    @staticmethod
    def of(sizes: Mapping[str, int] | None = None, **more: int) -> Mesh:
        sizes = {**(sizes or {}), **more}
        for name, size in sizes.items():
            if "-" in name:
                raise ValueError(f"{name!r} is the name of a product; a mesh names its factors")
            if size < 1:
                raise ValueError(f"mesh dimension {name!r} needs a size of 1 or more")
        return Mesh(tuple(sizes.items()))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.dims)

    def parts(self, dim: str) -> tuple[str, ...]:
        """Factors of a dimension, in the order of the mesh."""
        found = dim.split("-")
        if len(set(found)) != len(found):
            raise ValueError(f"mesh dimension repeats in {dim!r}")
        for d in found:
            if d not in self.names:
                raise ValueError(f"unknown mesh dimension {d!r}; the mesh has {', '.join(self.names) or 'none'}")
        return tuple(n for n in self.names if n in found)

    def normal(self, dim: str) -> str:
        return "-".join(self.parts(dim))

    def size(self, dim: str) -> int:
        sizes = dict(self.dims)
        return prod(sizes[p] for p in self.parts(dim))

    def ranks(self) -> list[dict[str, int]]:
        return [dict(zip(self.names, c, strict=True)) for c in product(*(range(s) for _, s in self.dims))]

    def index(self, dim: str, rank: Mapping[str, int]) -> int:
        """Place of a rank along a dimension or a product."""
        out, sizes = 0, dict(self.dims)
        for p in self.parts(dim):
            out = out * sizes[p] + rank[p]
        return out


def split_sizes(n: int, k: int) -> list[int]:
    """Lengths of k intervals of n places: equal ones but for the last, which is shorter, or longer if it would be empty."""
    each = ceil(n / k)
    if n - each * (k - 1) <= 0:
        each = n // k
    return [each] * (k - 1) + [n - each * (k - 1)]


def split_sizes_of_factors(n: int, k: int, factor: int) -> list[int]:
    """Intervals of whole blocks: n places are `factor` blocks and a rest, which goes to the last interval."""
    block = n // factor
    counts = split_sizes(factor, k)
    sizes = [c * block for c in counts]
    sizes[-1] += n - block * factor
    return sizes


def resolve_sizes(shapes, dim: str, axis: str, n: int | None, k: int) -> list[int]:
    """Interval lengths for an axis: given ones (flat, by dimension, or by dimension and axis), or the rule's."""
    found = shapes
    if isinstance(found, Mapping):
        if dim not in found:
            raise ValueError(f"Missing split shapes for mesh dimension {dim!r}")
        found = found[dim]
        if isinstance(found, Mapping):
            if axis not in found:
                raise ValueError(f"Missing split shapes for axis {axis!r} on mesh dimension {dim!r}")
            found = found[axis]
    if found is None:
        if n is None:
            raise ValueError(f"the size of axis {axis!r} is unknown")
        return split_sizes(n, k)
    found = [int(x) for x in found]
    if len(found) != k:
        raise ValueError(f"{len(found)} split shapes for axis {axis!r}, not equal to {k}")
    if any(x < 0 for x in found) or n is not None and sum(found) != n:
        raise ValueError(f"split shapes {found} don't add up to {n} for axis {axis!r}")
    return found


def starts(sizes: Sequence[int]) -> list[int]:
    return [0, *accumulate(sizes)][:-1]


def shard_of(index: Column, sizes: Sequence[int]) -> Column:
    """Number of the interval that holds a coordinate: arithmetic for equal ones, else a search in a literal array."""
    if sizes[0] and all(s == sizes[0] for s in sizes[:-1]) and sizes[-1] <= sizes[0]:
        return F.least(F.floor(index / sizes[0]), F.lit(len(sizes) - 1)).cast("int")
    ends = F.array(*[F.lit(e) for e in accumulate(sizes)])
    return F.size(F.filter(ends, lambda e: e <= index)).cast("int")


def start_of(shard: Column, sizes: Sequence[int]) -> Column:
    if all(s == sizes[0] for s in sizes[:-1]):
        return (shard * sizes[0]).cast("bigint")
    return F.element_at(F.array(*[F.lit(s) for s in starts(sizes)]), shard + 1).cast("bigint")
