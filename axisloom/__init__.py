"""Named-axis arrays on Spark: formulas over axis names, compiled to lazy DataFrames."""

from .frame import Frame
from .lang import Axis, Formula, Group, Rest, Spec, expand_families, parse, parse_spec, per_axis
from .mesh import Mesh, split_sizes, split_sizes_of_factors
from .operators.contract import check, contract
from .operators.conv import conv
from .operators.fourier import explain_fft, fft
from .operators.stencil import halo, halo_shards, roll, roll_shards, window
from .plans.cost import get_default_policy, optimize, resolve_policy, set_default_policy
from .plans.planner import explain
from .registry import Registry, local_slices, slices_table, state_of

__all__ = [
    "Axis", "Formula", "Frame", "Group", "Mesh", "Registry", "Rest", "Spec", "check", "contract", "conv", "expand_families", "explain", "explain_fft", "fft", "get_default_policy", "halo", "halo_shards",
    "local_slices", "optimize", "parse", "parse_spec", "per_axis", "resolve_policy", "roll", "roll_shards", "set_default_policy", "slices_table", "split_sizes", "split_sizes_of_factors", "state_of", "window",
]
