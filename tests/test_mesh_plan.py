import pytest

from axisloom import Mesh, explain, optimize, parse_spec, resolve_policy, set_default_policy, split_sizes, split_sizes_of_factors
from axisloom.mesh import resolve_sizes
from axisloom.plans.cost import BROADCAST, Extent, Policy, Step, Work, joined, kernel_of, worked
from axisloom.plans.planner import State, classify_binary, classify_unary

M = Mesh.of(dp=2, sp=4, tp=8)


@pytest.mark.parametrize(("n", "k", "want"), [(7, 1, [7]), (8, 4, [2, 2, 2, 2]), (10, 4, [3, 3, 3, 1]), (3, 4, [0, 0, 0, 3]), (17, 8, [2] * 7 + [3]), (26, 8, [3] * 7 + [5]), (129, 8, [17] * 7 + [10])])
def test_split_rule(n, k, want):
    assert split_sizes(n, k) == want


def test_split_of_factors():
    assert split_sizes_of_factors(721, 4, 4) == [180, 180, 180, 181]
    assert split_sizes_of_factors(10, 2, 4) == [4, 6]


def test_given_shapes():
    assert resolve_sizes({"dp": {"a": [1, 2]}}, "dp", "a", 3, 2) == [1, 2]
    with pytest.raises(ValueError, match="Missing split shapes"):
        resolve_sizes({"dp": {"a": [1, 2]}}, "dp", "b", 3, 2)
    with pytest.raises(ValueError, match="not equal to 2"):
        resolve_sizes([1, 1, 1], "dp", "a", 3, 2)


def test_mesh():
    assert M.size("sp-dp") == 8 and M.normal("sp-dp") == "dp-sp"
    assert M.index("dp-sp", {"dp": 1, "sp": 2, "tp": 0}) == 6
    for bad in ("x", "dp-dp"):
        with pytest.raises(ValueError, match="mesh dimension"):
            M.parts(bad)


def test_states():
    s = State.of(parse_spec("a/dp b c/tp // sp"), M)
    assert dict(s.placements) == {"a": "dp", "b": None, "c": "tp"} and s.partials == ("sp",)
    assert State.of(parse_spec("a/dp b // tp"), M).replicated == ("sp",)
    with pytest.raises(ValueError):
        State.of(parse_spec("a a"))
    with pytest.raises(ValueError, match="must match"):
        classify_unary(State.of(parse_spec("a b")), State.of(parse_spec("a")))
    roles = classify_binary(*(State.of(parse_spec(x)) for x in ("b l e", "b e f", "b l f")))
    assert (roles.free, roles.shared, roles.contracted) == (("l", "f"), ("b",), ("e",))


@pytest.mark.parametrize(
    ("formula", "steps"),
    [
        ("a b -> a/dp b", ["split"]), ("a/dp b -> a b", ["gather"]), ("a/dp b -> a b/dp", ["reshard"]), ("a/dp b -> a/sp b", ["swap"]), ("n h/sp w/dp -> n h/dp w/sp", ["swap"]),
        ("a b // tp -> a b", ["reduce"]), ("a b // tp -> a/tp b", ["scatter"]), ("a b -> a b // tp", ["replicate"]), ("a/tp b -> a b // tp", ["gather_sum"]), ("a // (sp,dp) -> a", ["reduce", "reduce"]),
        ("a b/tp, b c -> a c", ["split", "contract", "reduce"]), ("b n c, h/tp c -> b n h/tp", ["replicate", "contract"]), ("l f/tp, f/tp e -> l/tp e // tp", ["contract", "split"]),
        ("a k/dp m/sp, k/sp m/dp b -> a b", ["swap", "contract", "reduce", "reduce"]),
    ],
)
def test_steps(formula, steps):
    assert explain(formula, M).names() == steps


def test_golden_scores():
    ranked = {a.name: a.score for a in explain("a b/tp, b c -> a/tp c", M).alternatives}
    assert ranked == {"default": 8, "reduce_then_split": 14}
    names = [a.name for a in explain("a/tp b, c d -> a c/tp", M).alternatives]
    assert names == ["reshard", "default"]


def test_policies():
    many, wide = Work(exchanges=4, shuffled=1 << 20), Work(exchanges=1, shuffled=64 << 20)
    assert Policy.of("latency").weigh(many) > Policy.of("latency").weigh(wide)
    assert Policy.of("communication").weigh(many) < Policy.of("communication").weigh(wide)
    assert Policy.of("memory").weigh(Work(broadcast=4 << 20)) > Policy.of("training").weigh(Work(broadcast=4 << 20))
    assert Policy.of(None).weigh(Work()) == 0
    with pytest.raises(ValueError, match="either optimize or policy"):
        resolve_policy("memory", "latency")
    with pytest.raises(ValueError, match="Unknown optimization policy"):
        Policy.of("fast")
    assert resolve_policy().mode == "training"
    set_default_policy("latency")
    with optimize("memory"):
        assert resolve_policy().mode == "memory" and resolve_policy(policy="inference").mode == "inference"
    assert resolve_policy().mode == "latency"
    set_default_policy(None)


def test_work_of_steps():
    e = {None: Extent((("a", 8), ("b", 4)))}
    assert e[None].bytes == 8 * 4 * 24
    for kind, args in (("split", ("a", "dp")), ("gather", ("a", "dp")), ("swap", (("dp",), ("sp",))), ("reshard", ("a", "b", "dp")), ("permute", ("b", "a"))):
        assert worked([Step(kind, args)], e, {"dp": 2}) == Work()  # coordinates don't move
    copied = worked([Step("replicate", ("dp",)), Step("reduce", ("dp",))], e, {"dp": 2})
    assert (copied.exchanges, copied.shuffled) == (1, 2 * e[None].bytes)


def test_products_choose():
    big = 100 * BROADCAST
    assert joined(big, 1000, 5000).exchanges == 1 and joined(big, 1000, 5000).broadcast == 1000
    assert joined(big, big, 5000).exchanges == 2 and joined(big, big, 5000).broadcast == 0
    assert kernel_of(2000, 2000, 2000) == "blocks" and kernel_of(10, 10, 10) == kernel_of(None, 10, 10) == "join"


def test_the_cheaper_plan_is_selected():
    sizes = {"a": 1000, "b": 1000, "c": 1000}
    e = {k: Extent(tuple((n, sizes[n]) for n in axes)) for k, axes in ((0, "ab"), (1, "cd"[:1]), (None, "ac"))}
    plan = explain("a/tp b, c d -> a c/tp", M, extents=e)
    assert plan.alternatives[0].status == "selected" and plan.alternatives[0].score <= plan.alternatives[1].score
    assert all(x.work is not None for x in plan.alternatives)
