import pytest
from hypothesis import given
from hypothesis import strategies as st

from axisloom import Axis, Group, Rest, expand_families, parse, parse_spec, per_axis


def test_axes_shards_and_partials():
    f = parse("a/sp b / dp, b/dp c -> a/sp c // (tp,dp-sp)")
    assert f.inputs[0].items == (Axis("a", "sp"), Axis("b", "dp"))
    assert f.output.partials == ("tp", "dp-sp")
    assert not f.local and parse("a b -> b a").local


def test_groups_and_ellipsis():
    f = parse("... (h p/x) c -> ... h p c")
    assert f.inputs[0].items == (Rest(), Group((Axis("h"), Axis("p", "x"))), Axis("c"))


@pytest.mark.parametrize("text", ["a ->", "a b", "-> a", "a, b, c -> a", "((a b)) -> a", "a -> a [param]", "a [async] -> a", "... ... -> a", "a -> a a", "a // (p,p) -> a", "a [param, grad=x, grad=y] -> a", "a$ -> a"])
def test_invalid(text):
    with pytest.raises(ValueError, match="Invalid formula"):
        parse(text)


def test_annotations():
    n = parse("a b [param, grad=dp:async, init_sync=(dp,sp)], b c -> a c").inputs[0].note
    assert n.grad.dims == ("dp",) and n.grad.deferred and n.init == ("explicit", ("dp", "sp"))
    assert parse_spec("a [param, grad=ddp]").note.grad.backend == "ddp"
    assert parse_spec("a [param, grad=none, init_sync=external]").note.init == ("external", ())
    assert parse_spec("a [param, grad=(dp,sp):external]").note.grad.backend == "external"


def test_families():
    fam = {"spatial": ("h", "w"), "window": ("wh", "ww")}
    assert expand_families("b t [*spatial *window] c -> (b *spatial) t *window c", fam) == "b t (h wh) (w ww) c -> (b h w) t wh ww c"
    assert expand_families("a [param, grad=dp] -> a", fam) == "a [param, grad=dp] -> a"
    with pytest.raises(ValueError, match="Unknown axis family"):
        expand_families("*x -> *x", fam)
    with pytest.raises(ValueError, match="matching lengths"):
        expand_families("[*spatial *z] -> a", {**fam, "z": ("q",)})
    assert per_axis({"spatial": (1, 0)}, fam) == {"h": 1, "w": 0}
    assert per_axis({"spatial": 2, "c": 3}, fam) == {"h": 2, "w": 2, "c": 3}
    with pytest.raises(ValueError, match="Conflicting"):
        per_axis({"spatial": 2, "h": 3}, fam)


@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from([None, "dp", "sp-tp"])), min_size=1, max_size=4, unique_by=lambda x: x[0]))
def test_round_trip(axes):
    text = " ".join(f"{a}/{s}" if s else a for a, s in axes)
    f = parse(f"{text} -> {text}")
    assert parse(str(f)) == f
