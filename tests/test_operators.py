import numpy as np
import pytest

from axisloom import Frame, Mesh, check, contract, conv, explain_fft, fft, halo, halo_shards, roll, window
from axisloom.operators import adjoint
from axisloom.sources.tables import arrays, read_frame, to_array, write_frame

RNG = np.random.default_rng(333)
M = Mesh.of(dp=2, sp=4)


def R(*shape):
    return RNG.standard_normal(shape)


def same(frame, want):
    np.testing.assert_allclose(to_array(frame), want, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize(
    ("formula", "shapes", "numpy"),
    [
        ("a b k c, b c l d -> k l d a", [(3, 4, 5, 2), (4, 2, 3, 2)], "abkc,bcld->klda"), ("i, j -> i j", [(3,), (4,)], "i,j->ij"), ("l e, l e -> l e", [(3, 4), (3, 4)], "le,le->le"),
        ("b a c, b c d -> b a d", [(2, 3, 4), (2, 4, 5)], "bac,bcd->bad"), ("i i -> i", [(5, 5)], "ii->i"), ("i i j -> j", [(3, 3, 4)], "iij->j"), ("... c, c o -> ... o", [(2, 3, 4), (4, 5)], "xyc,co->xyo"),
        ("... c -> c", [(2, 3, 4)], "xyc->c"), ("b ... c -> ... c b", [(2, 3, 4)], "bxc->xcb"), ("a b c, c -> a", [(2, 3, 4), (4,)], "abc,c->a"), ("b c, c -> b c", [(2, 3), (3,)], "bc,c->bc"),
    ],
)
def test_local(spark, formula, shapes, numpy):
    values = [R(*s) for s in shapes]
    frames = [arrays(spark, v, [f"x{i}" for i in range(v.ndim)]) for v in values]
    same(contract(formula, *frames), np.einsum(numpy, *values))


def test_complex(spark):
    x, y = R(3, 4) + 1j * R(3, 4), R(4, 2)
    same(contract("a b, b c -> a c", arrays(spark, x, "a b"), arrays(spark, y, "b c")), x @ y)


def test_groups(spark):
    x = R(2, 12, 5)
    same(contract("b (h p) c -> b c h p", arrays(spark, x, "b q c"), sizes={"h": 3}), x.reshape(2, 3, 4, 5).transpose(0, 3, 1, 2))
    same(contract("b h p c -> b (h p) c", arrays(spark, x.reshape(2, 3, 4, 5), "b h p c")), x)
    same(contract("b (h p) c -> c (p h) b", arrays(spark, x, "b q c"), sizes={"p": 4}), x.reshape(2, 3, 4, 5).transpose(3, 2, 1, 0).reshape(5, 12, 2))
    f = arrays(spark, x, "b q c")
    with pytest.raises(ValueError, match="Cannot infer multiple factor sizes"):
        contract("b (h p q) c -> b h p q c", f, sizes={"h": 3})
    with pytest.raises(ValueError, match="divisible"):
        contract("b (h p) c -> b h p c", f, sizes={"h": 5})
    with pytest.raises(ValueError, match="Factor sizes multiply to"):
        contract("b (h p) c -> b h p c", f, sizes={"h": 3, "p": 3})


def test_errors(spark):
    x = arrays(spark, R(2, 3), "a b")
    with pytest.raises(ValueError, match="must be present in input"):
        contract("a b -> a c", x)
    with pytest.raises(ValueError, match="require a mesh"):
        contract("a b -> a/dp b", x)
    with pytest.raises(ValueError, match="Factored axes"):
        contract("(a c) b -> a/dp c b", x, mesh=M, sizes={"a": 1})
    with pytest.raises(ValueError, match="has sizes"):
        contract("a b, b c -> a c", x, arrays(spark, R(2, 2), "b c"))
    with pytest.raises(ValueError, match="axes, its operand"):
        contract("a b c -> a", x)
    with pytest.raises(ValueError, match="alone"):
        contract("b/dp c, c -> c", x, arrays(spark, R(3), "c"), mesh=M)
    with pytest.raises(ValueError, match="can't be partial"):
        check("a b // dp, b c -> a c", ("a", "b"), ("b", "c"), mesh=M)
    check("a b/dp, b/dp c -> a c", ("a", "b"), ("b", "c"), mesh=M)


def test_lazy_and_pushed_down(spark, tmp_path):
    write_frame(arrays(spark, R(6, 7), "a b"), str(tmp_path / "x"))
    x = read_frame(spark, str(tmp_path / "x"))
    assert x.axes == ("a", "b") and x.sizes == {"a": 6, "b": 7}
    plan = contract("a b -> a", x.where("a = 3")).df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(a), EqualTo(a,3)]" in plan


def test_eager_sum_is_below_the_join(spark):
    x, y = arrays(spark, R(3, 4), "a b"), arrays(spark, R(3, 2), "a c")
    plan = contract("a b, a c -> c", x, y).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")


@pytest.mark.parametrize(("there", "back"), [("a b -> a/dp b", "a/dp b -> a b"), ("... a -> ... a/sp", "... a/sp -> ... a"), ("a b -> a/sp b/dp", "a/sp b/dp -> a b")])
def test_relayout_round_trip(spark, there, back):
    x = R(9, 5)
    same(contract(back, contract(there, arrays(spark, x, "a b"), mesh=M), mesh=M).renamed(("a", "b")), x)


def test_shards(spark):
    x = np.arange(10.0)
    got = contract("a -> a/sp", arrays(spark, x, "a"), mesh=M).to_shards().collect()
    assert sorted((r["_s_sp"], r["a"], r["v"]) for r in got) == [(min(i // 3, 3), i - 3 * min(i // 3, 3), float(i)) for i in range(10)]
    both = contract("a b -> a/dp b/dp", arrays(spark, R(4, 4), "a b"), mesh=M).to_shards()
    assert both.count() == 8  # each rank holds its own quarter


def test_partials(spark):
    x, y = R(9, 17), R(17, 8)
    kept = contract("b n/dp, n/dp h -> b h // dp", arrays(spark, x, "b n"), arrays(spark, y, "n h"), mesh=M)
    assert kept.partials == ("dp",)
    same(contract("b h // dp -> b h", kept, mesh=M), x @ y)
    scattered = contract("b h // dp -> b/dp h", kept, mesh=M)
    assert scattered.placements == {"b": "dp"}
    same(scattered, x @ y)
    full = arrays(spark, x, "b n")
    same(contract("b n // sp -> b n", contract("b n -> b n // sp", full, mesh=M), mesh=M), 4 * x)
    same(contract("b n // sp -> b n", contract("b/sp n -> b n // sp", full, mesh=M), mesh=M), 4 * x)
    with pytest.raises(ValueError, match="partial"):
        contract("b h, h c -> b c", kept, arrays(spark, R(8, 2), "h c"), mesh=M)


@pytest.mark.parametrize("formula", ["l/sp e/dp, e/sp f/dp -> l/sp f/dp", "l/dp e, e f -> l f/dp", "l e/dp, e/dp f -> l/dp f", "l e, e/dp f -> l f", "l/dp e, e/sp f -> l/dp f/sp"])
def test_placed_products(spark, formula):
    x, y = R(5, 9), R(9, 6)
    same(contract(formula, arrays(spark, x, "l e"), arrays(spark, y, "e f"), mesh=M), x @ y)


def test_blocks(spark):
    x, y = R(9, 17), R(6, 17)
    same(contract("i k, j k -> i j", arrays(spark, x, "i k"), arrays(spark, y, "j k"), kernel="blocks"), x @ y.T)


def test_blocks_are_spread(spark):
    """A contracted axis of one block is one key of the join; its product is made by several tasks all the same."""
    from pyspark.sql import functions as F

    x, y = R(1100, 3), R(1030, 3)
    x[5] = 0
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables as small as these would be one task again
    try:
        got = contract("i k, j k -> i j", arrays(spark, x, "i k"), arrays(spark, y, "j k"), kernel="blocks")
        assert got.df.groupBy(F.spark_partition_id()).count().count() > 1
        same(got, x @ y.T)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_nearest(spark):
    """Halves go away from zero, also below and beyond what has digits; no negative zero."""
    from axisloom.functions import nearest

    values = [0.5, 1.5, 2.5, -0.5, -2.5, 0.49999999999999994, -1e-9, 4503599627370497.5, 1e300, float("inf"), float("-inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(nearest("v", 0)).collect()]
    assert str(got) == str([1.0, 2.0, 3.0, -1.0, -3.0, 0.0, 0.0, 4503599627370497.5, 1e300, float("inf"), float("-inf"), float("nan")])
    assert [r[0] for r in spark.createDataFrame([(0.12345,), (-7.00006,), (1e20,)], "v double").select(nearest("v")).collect()] == [0.1235, -7.0001, 1e20]


@pytest.mark.parametrize(("boundary", "fill", "want"), [("constant", -1, [-1, -1, 0, 1, 2, 3, 4, -1]), ("periodic", 0, [3, 4, 0, 1, 2, 3, 4, 0]), ("replicate", 0, [0, 0, 0, 1, 2, 3, 4, 4])])
def test_halo(spark, boundary, fill, want):
    x = np.arange(5.0)
    h = halo("h -> h", arrays(spark, x, "h"), {"h": (2, 1)}, boundary=boundary, fill=fill)
    same(h, want)
    if boundary != "constant":
        back = to_array(adjoint.vjp_halo(h, "h", 5, (2, 1), boundary))
        np.testing.assert_allclose((np.array(want) ** 2).sum(), (back * x).sum())


def test_halo_multi_wrap(spark):
    x = np.arange(3.0)
    same(halo("h -> h", arrays(spark, x, "h"), {"h": (4, 5)}, boundary="periodic"), np.pad(x, (4, 5), mode="wrap"))


def test_placed_halo_wider_than_a_shard(spark):
    x = np.arange(5.0)
    got = halo_shards("a/sp -> a/sp", arrays(spark, x, "a"), {"a": (3, 2)}, mesh=M, fill=-3, shapes={"sp": {"a": [2, 1, 1, 1]}}).collect()
    padded = np.pad(x, (3, 2), constant_values=-3)
    want = {(s, i): padded[a + i] for s, (a, n) in enumerate(((0, 2), (2, 1), (3, 1), (4, 1))) for i in range(n + 5)}
    assert {(r["_s_sp"], r["a"]): r["v"] for r in got} == want and len(got) == len(want)


def test_windows(spark):
    x = np.arange(5.0)
    f = arrays(spark, x, "h")
    same(window("h -> h kh", f, {"h": "kh"}, 1, fill=-1), [[-1, 0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4], [3, 4, -1]])
    for boundary, mode in (("periodic", "wrap"), ("replicate", "edge")):
        want = np.lib.stride_tricks.sliding_window_view(np.pad(x, (2, 1), mode=mode), 4)
        same(window("h -> kh h", f, {"h": "kh"}, {"h": (2, 1)}, boundary=boundary), want.T)
    y = np.arange(12.0).reshape(3, 4)
    w = window("*spatial -> *spatial *window", arrays(spark, y, "h w"), {"spatial": "window"}, {"spatial": (1, 0)}, families={"spatial": ("h", "w"), "window": ("kh", "kw")})
    assert to_array(w).shape == (3, 4, 3, 1)
    with pytest.raises(ValueError, match="distinct"):
        window("h -> h h2", f, {"h": "h"}, 1)
    with pytest.raises(ValueError, match="non-negative"):
        window("h -> h k", f, {"h": "k"}, -1)


def test_stencil_errors(spark):
    f = arrays(spark, np.arange(5.0), "h")
    with pytest.raises(ValueError, match="Unsupported halo boundary"):
        halo("h -> h", f, {"h": 1}, boundary="mirror")
    with pytest.raises(ValueError, match="empty"):
        halo("h -> h", Frame(f.df.limit(0), ("h",), {"h": 0}), {"h": 1}, boundary="periodic")
    with pytest.raises(ValueError, match="no axis"):
        roll("h -> h", f, {"x": 1})


@pytest.mark.parametrize("shift", [2, -2, 13])
def test_roll(spark, shift):
    x = R(7, 3)
    r = roll("a/sp b -> a/sp b", arrays(spark, x, "a b"), {"a": shift}, mesh=M)
    same(r, np.roll(x, shift, 0))
    same(roll("a/sp b -> a/sp b", r, {"a": -shift}, mesh=M), x)


def _conv(x, w, mode, dilation=1):
    pad = dilation * (w.shape[2] - 1) // 2
    p = np.pad(x, ((0, 0), (pad, pad), (0, 0)), mode=mode)
    return sum(np.einsum("bhc,oc->bho", p[:, i * dilation : i * dilation + x.shape[1]], w[:, :, i]) for i in range(w.shape[2]))


@pytest.mark.parametrize(("boundary", "mode"), [("constant", "constant"), ("periodic", "wrap"), ("replicate", "edge")])
@pytest.mark.parametrize("dilation", [1, 2])
def test_conv(spark, boundary, mode, dilation):
    x, w, b = R(2, 7, 3), R(4, 3, 3), R(4)
    got = conv("b h c, o c k -> b o h", arrays(spark, x, "b h c"), arrays(spark, w, "o c k"), {"h": "k"}, bias=arrays(spark, b, "o"), boundary=boundary, dilation=dilation)
    same(got, (_conv(x, w, mode, dilation) + b).transpose(0, 2, 1))


@pytest.mark.parametrize("fill", [0.0, 2.0])
@pytest.mark.parametrize(("boundary", "dilation"), [("constant", 2), ("periodic", 1), ("replicate", 2)])
def test_conv_adjoint(spark, boundary, dilation, fill):
    """By differences: the convolution is linear in the array, the kernel and the bias each."""
    x, w, b, g = R(2, 6, 5, 3), R(4, 3, 3, 2), R(4), R(2, 6, 5, 4)
    how = {"boundary": boundary, "dilation": {"h": dilation, "w": 1}, "padding": {"h": dilation, "w": (1, 0)}, "fill": fill}
    formula, windows = "b h w c, o c kh kw -> b h w o", {"h": "kh", "w": "kw"}
    run = lambda x, w: to_array(conv(formula, arrays(spark, x, "b h w c"), arrays(spark, w, "o c kh kw"), windows, bias=arrays(spark, b, "o"), **how))
    to_x, to_w, to_b = adjoint.vjp_conv(formula, arrays(spark, x, "b h w c"), arrays(spark, w, "o c kh kw"), arrays(spark, g, "b h w o"), windows, **how)
    base, dx, dw = run(x, w), R(*x.shape), R(*w.shape)
    np.testing.assert_allclose(((run(x + dx, w) - base) * g).sum(), (to_array(to_x) * dx).sum(), rtol=1e-6)
    np.testing.assert_allclose(((run(x, w + dw) - base) * g).sum(), (to_array(to_w) * dw).sum(), rtol=1e-6)
    same(to_b, g.sum((0, 1, 2)))


def test_conv_volume(spark):
    x, w = R(3, 4, 5, 2), R(2, 2, 3, 1, 3)
    got = to_array(conv("d h w c, o c kd kh kw -> d h w o", arrays(spark, x, "d h w c"), arrays(spark, w, "o c kd kh kw"), {"d": "kd", "h": "kh", "w": "kw"}))
    wide = np.pad(x, ((1, 1), (0, 0), (1, 1), (0, 0)))
    want = sum(np.einsum("dhwc,oc->dhwo", wide[a : a + 3, :, e : e + 5], w[:, :, a, 0, e]) for a in range(3) for e in range(3))
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_conv_errors(spark):
    x, w = arrays(spark, R(2, 7, 3), "b h c"), arrays(spark, R(4, 3, 3), "o c k")
    go = lambda **o: conv("b h c, o c k -> b h o", x, w, {"h": "k"}, **o)
    for bad in ({"groups": 2}, {"stride": 2}):
        with pytest.raises(NotImplementedError):
            go(**bad)
    with pytest.raises(ValueError, match="preserve the spatial length"):
        go(padding=2)
    with pytest.raises(ValueError, match="explicit padding"):
        conv("b h c, o c k -> b h o", x, arrays(spark, R(4, 3, 2), "o c k"), {"h": "k"})
    same(go(padding={"h": (2, 0)}), to_array(go(padding=[(2, 0)])))


@pytest.mark.parametrize("method", ["terms", "stages", "lines"])
@pytest.mark.parametrize("norm", [None, "ortho", "forward"])
@pytest.mark.parametrize("inverse", [False, True])
def test_fft(spark, method, norm, inverse):
    x = R(2, 12, 2) + 1j * R(2, 12, 2)
    f = np.fft.ifft if inverse else np.fft.fft
    same(fft("b x c -> c b k", arrays(spark, x, "b x c"), {"x": "k"}, norm=norm, inverse=inverse, method=method), f(x, axis=1, norm=norm).transpose(2, 0, 1))


def test_fft_planes_and_halves(spark):
    x = R(2, 6, 7)
    half = fft("b x y -> b kx ky", arrays(spark, x, "b x y"), {"x": "kx", "y": "ky"}, real=True)
    same(half, np.fft.rfftn(x, axes=(1, 2)))
    same(fft("b kx ky -> b x y", half, {"kx": "x", "ky": "y"}, real=True, inverse=True, signal_sizes={"y": 7}), x)
    same(fft("x -> k", arrays(spark, x[0, :, 0], "x"), {"x": "k"}, real=True), np.fft.rfft(x[0, :, 0]))
    same(fft("*s -> *s", arrays(spark, x[0], "a b"), ["s"], families={"s": ("a", "b")}), np.fft.fftn(x[0]))


def test_fft_adjoint(spark):
    x, y = R(8) + 1j * R(8), R(8) + 1j * R(8)
    fx = to_array(fft("x -> k", arrays(spark, x, "x"), {"x": "k"}))
    ay = to_array(adjoint.vjp_fft("x -> k", arrays(spark, y, "k"), {"x": "k"}))
    np.testing.assert_allclose(np.vdot(y, fx), np.vdot(ay, x))


@pytest.mark.parametrize("n", [1, 7, 8])
@pytest.mark.parametrize("method", ["terms", "stages", "lines"])
def test_real_inverse(spark, n, method):
    m = n // 2 + 1
    half = R(2, m) + 1j * R(2, m)
    same(fft("b k -> b x", arrays(spark, half, "b k"), {"k": "x"}, inverse=True, real=True, signal_sizes={"x": n}, method=method), np.fft.irfft(half, n, axis=1) if n > 1 else half.real)


@pytest.mark.parametrize("n", [6, 7])
@pytest.mark.parametrize("norm", [None, "ortho", "forward"])
def test_real_fft_adjoint(spark, n, norm):
    axes = {"a": "ka", "x": "k"}
    x, y = R(3, n), R(3, n // 2 + 1) + 1j * R(3, n // 2 + 1)
    fx = np.fft.rfftn(x, axes=(0, 1), norm=norm)
    ay = to_array(adjoint.vjp_fft("a x -> ka k", arrays(spark, y, "ka k"), axes, norm=norm, real=True, length=n))
    np.testing.assert_allclose((fx.real * y.real + fx.imag * y.imag).sum(), (x * ay).sum(), rtol=1e-6)


@pytest.mark.parametrize(("m", "n"), [(4, 6), (4, 7), (6, 7), (3, 7)])
def test_real_inverse_adjoint(spark, m, n):
    """The half has the right length, is cut short (6 for 4) or filled up (3 for 4)."""
    y, g = R(3, m) + 1j * R(3, m), R(3, n)
    fy = np.fft.irfft(np.fft.ifft(y, axis=0), n, axis=1)
    f = adjoint.vjp_fft("ka k -> a x", arrays(spark, g, "a x"), {"ka": "a", "k": "x"}, inverse=True, real=True, length=m)
    back = to_array(f)
    assert back.shape == y.shape
    np.testing.assert_allclose((fy * g).sum(), (back.real * y.real + back.imag * y.imag).sum(), rtol=1e-6)


def test_fft_errors_and_paths(spark):
    x = arrays(spark, R(2, 6), "b x")
    with pytest.raises(ValueError, match="Invalid FFT norm"):
        fft("b x -> b k", x, {"x": "k"}, norm="other")
    for bad in ("b x // dp -> b k", "... x -> ... k", "b/dp x -> b k"):
        with pytest.raises(ValueError):
            fft(bad, x, {"x": "k"}, mesh=M)
    assert explain_fft("b x -> b k", {"x": "k"}, {"x": 16}).path == "terms"
    assert explain_fft("b x -> b k", {"x": "k"}, {"x": 720}).path == "stages"
    assert explain_fft("b x -> b k", {"x": "k"}, {"x": 104729}, real=True).path == "real lines"
    assert explain_fft("b k -> b x", {"k": "x"}, {"k": 17}, real=True, inverse=True).path == "real inverse terms"
    assert explain_fft("b k -> b x", {"k": "x"}, {"k": 17}, real=True, inverse=True, signal_sizes={"x": 720}).path == "real inverse stages"
    assert explain_fft("b x -> b x", {}, {}).path == "none" and explain_fft("... x -> ... k", {"x": "k"}, {"x": 4}).path == "unsupported"


def test_dot_product_identities(spark):
    x, y, g = R(4, 5), R(5, 3), R(4, 3)
    fx, fy = adjoint.vjp_contract("a b, b c -> a c", arrays(spark, x, "a b"), arrays(spark, y, "b c"), arrays(spark, g, "a c"))
    same(fx, g @ y.T)
    same(fy, x.T @ g)
    dx, _ = adjoint.vjp_contract("a b, c -> c", arrays(spark, x, "a b"), arrays(spark, y[0], "c"), arrays(spark, g[0], "c"))
    same(dx, np.full(x.shape, g[0] @ y[0]))
    w = arrays(spark, R(5, 3), "h k")
    back = to_array(adjoint.vjp_window(w, "h", "k", 5, 1))
    v = R(5)
    np.testing.assert_allclose((to_array(window("h -> h k", arrays(spark, v, "h"), {"h": "k"}, 1)) * to_array(w)).sum(), (back * v).sum())
    same(adjoint.vjp_reduce(arrays(spark, v, "h"), {"z": 2}), np.repeat(v[:, None], 2, 1))
    same(adjoint.vjp_roll("h -> h", arrays(spark, v, "h"), {"h": 2}), np.roll(v, -2))


def test_relayout_adjoint(spark):
    g = arrays(spark, R(4, 5), "b a")
    same(adjoint.vjp_relayout("a b -> b a/dp", contract("b a -> b a/dp", g, mesh=M), mesh=M), to_array(g).T)


def test_densify_and_empty(spark):
    f = Frame(spark.createDataFrame([(1, 2.0)], "a bigint, v double"), ("a",), {"a": 3})
    same(f.densified(1.0), [1, 2, 1])
    empty = Frame(spark.createDataFrame([], "a bigint, v double"), ("a",), {"a": 0})
    assert empty.densified().df.count() == 0 and contract("a, a -> a", empty, empty).df.count() == 0


def test_packed_axis(spark):
    x = R(3, 4)
    rows = {r["a"]: r["v"] for r in arrays(spark, x, "a b").packed("b").collect()}
    np.testing.assert_allclose([rows[i] for i in range(3)], x)
    gaps = Frame(spark.createDataFrame([(0, 1, 2.0), (0, 4, 3.0), (2, 0, 1.0)], "a bigint, b bigint, v double"), ("a", "b"), {"b": 6})
    assert {r["a"]: r["v"] for r in gaps.packed("b").collect()} == {0: [0, 2, 0, 0, 3, 0], 2: [1, 0, 0, 0, 0, 0]}


def test_stream(spark, tmp_path):
    from axisloom.streaming import accumulated, contracted

    write_frame(arrays(spark, x := R(4, 3), "a b"), str(tmp_path / "in"))
    stream = spark.readStream.schema("a bigint, b bigint, v double").parquet(str(tmp_path / "in"))
    q = accumulated(contracted("a b, b c -> a c", stream, ["a", "b"], arrays(spark, y := R(3, 2), "b c")), "grown")
    q.processAllAvailable()
    q.stop()
    same(Frame(spark.table("grown"), ("a", "c"), {"a": 4, "c": 2}), x @ y)


def test_stream_updates(spark, tmp_path):
    from axisloom.streaming import contracted, updated

    write_frame(arrays(spark, x := R(4, 3), "a b"), str(tmp_path / "in"))
    stream = spark.readStream.schema("a bigint, b bigint, v double").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = updated(contracted("a b, b c -> a c", stream, ["a", "b"], arrays(spark, y := R(3, 2), "b c")), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}"), str(tmp_path / "log"))
    q.processAllAvailable()
    q.stop()
    same(Frame(spark.read.parquet(f"{out}/n=0"), ("a", "c"), {"a": 4, "c": 2}), x @ y)
