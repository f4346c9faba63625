from dataclasses import replace

import numpy as np
import pytest

from axisloom import Mesh, Registry, local_slices, state_of
from axisloom.registry import merge, slices_table, spread
from axisloom.sources.tables import arrays, to_array

M = Mesh.of(dp=2, sp=4)


def test_states_and_conflicts():
    s = state_of("o/tp c [param, grad=dp, init_sync=(dp,sp)]")
    assert s.axes == ("o", "c") and s.shards == ("tp",) and s.reduce == ("dp",) and s.init.dims == ("dp", "sp")
    for bad in ("o/tp c/tp", "o/tp c [param, grad=tp]", "o/dp-sp c [param, init_sync=sp]", "o [param, grad=(dp,dp-sp)]", "... c"):
        with pytest.raises(ValueError):
            state_of(bad)
    assert state_of("o/tp [param, grad=tp:external]").grad.backend == "external"
    assert merge(state_of("o c"), s := state_of("o c [param, grad=dp]")).grad == s.grad
    with pytest.raises(ValueError, match="conflict"):
        merge(state_of("o [param, grad=dp]"), state_of("o [param, grad=none]"))
    with pytest.raises(ValueError, match="conflict"):
        merge(state_of("o c"), state_of("o/tp c"))


def test_registration_is_atomic():
    r = Registry()
    with pytest.raises(ValueError):
        r.register({"good": "o c", "bad": "o/tp c/tp"})
    assert r.states == {}
    with pytest.raises(ValueError, match="axes"):
        r.register({"w": "o c"}, ranks={"w": 3})


def test_layers():
    r = Registry()
    r.register_linear("up", "o/tp c")
    r.register_conv("conv", rank=4)
    r.register_norm("norm")
    assert r.get("up.bias").axes == ("o",) and r.get("up.bias").shards == ("tp",)
    assert r.get("conv.weight").axes == ("o", "c", "kh", "kw") and r.get("norm.bias").axes == ("c",)
    assert r.get("up.weight").shared(Mesh.of(dp=2, tp=4)) == ("dp",)


def test_inference_from_formulas():
    r = Registry()
    r.register_operand("w", "b/dp n c, h/tp c [param] -> b/dp n h/tp", 1)
    assert r.get("w").reduce == ("dp",)
    r.register_operand("w", "b n/sp c, h/tp c [param] -> b n/sp h/tp", 1)
    assert r.get("w").reduce == ("dp", "sp")
    r.register({"u": "a"})
    with pytest.raises(ValueError, match="pending"):
        r.validate(["u"])
    r.finalize()
    r.validate(["u", "w"], Mesh.of(dp=2, sp=2, tp=2))
    with pytest.raises(ValueError, match="isn't registered"):
        r.validate(["x"])


def test_sync_and_reduce(spark):
    r = Registry()
    r.register({"w": "n [param, grad=dp]", "u": "n [param, grad=none, init_sync=none]", "p": "n"})
    x = np.arange(3.0) + 1
    ranks = replace(spread(arrays(spark, x, "n"), "dp", (1, 2)), mesh=M)
    np.testing.assert_allclose(to_array(r.reduce_grad("w", ranks)), 3 * x)
    np.testing.assert_allclose(to_array(r.reduce_mean("w", ranks)), 1.5 * x)
    assert {(row["_p_dp"], row["v"]) for row in r.init("w", ranks).df.collect()} == {(p, v) for p in (0, 1) for v in x}
    assert r.init("u", ranks) is ranks and r.reduce_grad("u", ranks) is ranks
    with pytest.raises(ValueError, match="pending"):
        r.reduce_grad("p", ranks)


def test_slices(spark):
    s = local_slices("o/dp c/sp", (5, 7), M, {"dp": 1, "sp": 3})
    assert s.slices == ((3, 5), (6, 7)) and s.part == (2, 1)
    assert [local_slices("o/dp c", (10, 3), M, {"dp": i, "sp": 0}, {"o": 4}).part[0] for i in (0, 1)] == [4, 6]
    assert slices_table(spark, "o/dp c/sp", (5, 7), M).count() == 16
    with pytest.raises(ValueError):
        local_slices("o c", (1,), M, {})
