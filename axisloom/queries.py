"""Queries over the test tables: one or more for each kind of operator, with the SQL that gives the same rows.

Frames: T[p s] quantity by part and supplier, N[s n] a supplier's nation, H[t] hourly sums of event values over 720 hours, G[d h] the
same by day and hour, E[i d] embeddings, C[n m] customers by nation and segment, W[n m] flow between customers' and suppliers' nations.
Every query covers whole tables. Values that come of sums in any order are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Frame, _grid
from .functions import hour_index, nearest, rounded
from .mesh import Mesh
from .operators import adjoint
from .operators.contract import contract
from .operators.conv import conv
from .operators.fourier import fft
from .operators.stencil import halo, halo_shards, roll, roll_shards, window
from .plans.planner import explain
from .registry import Registry, slices_table, spread
from .sources import table

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
HOURS, START = 720, "2024-01-01 00:00:00"
MESH = Mesh.of(dp=3, sp=2, tp=4)


def query(sql: str):
    def put(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items()}


def rows(x: Frame, digits: int | None = 4) -> DataFrame:
    """Coordinates, partials and values of a frame, rounded."""
    return x.once().df.select(*x.keys, *[rounded(v, digits).alias(v) if digits is not None else F.col(v) for v in x.values])


# --- frames of the tables ---------------------------------------------------------------------------------------


def flow(s: SparkSession, d: str) -> Frame:
    return Frame.of(table(s, d, "lineitem"), {"p": "l_partkey", "s": "l_suppkey"}, "l_quantity", unique=False)


def nation_of(s: SparkSession, d: str) -> Frame:
    return Frame.of(table(s, d, "supplier"), {"s": "s_suppkey", "n": "s_nationkey"}, F.lit(1.0), sizes={"n": 25})


def hours(s: SparkSession, d: str) -> Frame:
    return Frame.of(table(s, d, "events"), {"t": hour_index("ts", START)}, "value", sizes={"t": HOURS}, unique=False)


def grid(s: SparkSession, d: str) -> Frame:
    return contract("(d h) -> d h", hours(s, d), sizes={"d": 30, "h": 24})


def embeddings(s: SparkSession, d: str) -> Frame:
    return Frame.of_arrays(table(s, d, "embeddings"), {"i": "vec_id"}, "embedding", "d", sizes={"d": 64}).measured("i")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_FLAGS = ("A", "N", "R")


def _code(column: str, names: tuple[str, ...]):
    return F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1


def segments(s: SparkSession, d: str, value="1") -> Frame:
    c = table(s, d, "customer").where(F.col("c_mktsegment").isin(*_SEGMENTS))
    return Frame.of(c, {"n": "c_nationkey", "m": _code("c_mktsegment", _SEGMENTS)}, F.expr(value), sizes={"n": 25, "m": 5}, unique=False)


def between_nations(s: SparkSession, d: str) -> Frame:
    """W[n m l]: quantity from suppliers of nation m to customers of nation n, by line number."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    o, c, u = (table(s, d, t) for t in ("orders", "customer", "supplier"))
    j = li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == c.c_custkey).join(u.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == u.s_suppkey)
    return Frame.of(j, {"n": "c_nationkey", "m": "s_nationkey", "l": "l_linenumber"}, "l_quantity", sizes={"n": 25, "m": 25, "l": 8}, unique=False)


_T = "T AS (SELECT l_partkey::BIGINT p, l_suppkey::BIGINT s, sum(l_quantity) v FROM lineitem GROUP BY ALL)"
_H = "H0 AS (SELECT floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::BIGINT t, sum(value) v FROM events GROUP BY ALL), H AS (SELECT r.t::BIGINT t, coalesce(v, 0) v FROM range(720) r(t) LEFT JOIN H0 USING (t))"
_G = f"{_H}, G AS (SELECT t // 24 d, t % 24 h, v FROM H)"
_E = "E AS (SELECT vec_id::BIGINT i, d::BIGINT d, embedding[d + 1]::DOUBLE v FROM embeddings, range(64) r(d)), S AS (SELECT max(i) + 1 n FROM E)"
_C = "C AS (SELECT c_nationkey::BIGINT n, list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment)::BIGINT - 1 m, count(*)::DOUBLE v, sum(c_acctbal) b FROM customer WHERE c_mktsegment IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') GROUP BY ALL)"
_W = "W AS (SELECT c_nationkey::BIGINT n, s_nationkey::BIGINT m, l_linenumber::BIGINT l, sum(l_quantity) v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def _each(n: str, k: int) -> str:
    """SQL of the length of the first of k intervals of n places."""
    return f"(CASE WHEN {n} > ceil({n} / {k}.0) * {k - 1} THEN ceil({n} / {k}.0)::BIGINT ELSE {n} // {k} END)"


def _cut(i: str, n: str, k: int) -> str:
    """SQL of the interval number of a coordinate; n is at least k."""
    return f"least({i} // {_each(n, k)}, {k - 1})::INTEGER"


def _start(i: str, n: str, k: int) -> str:
    return f"({_cut(i, n, k)} * {_each(n, k)})::BIGINT"


# --- contractions -----------------------------------------------------------------------------------------------


@query(f"WITH {_T} SELECT p, s_nationkey::BIGINT n, sum(v) v FROM T JOIN supplier ON s = s_suppkey GROUP BY ALL")
def contract_matmul(s, d):
    return rows(contract("p s, s n -> p n", flow(s, d), nation_of(s, d)), None)


@query("SELECT a.vec_id i, b.vec_id j, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) + 0.0 v FROM embeddings a, embeddings b WHERE v <> 0 OR v = 0")
def contract_gram(s, d):
    e = embeddings(s, d)
    x = contract("i d, j d -> i j", e, e.renamed(("j", "d")), kernel="blocks")
    return x.once().df.select(*x.keys, nearest("v").alias("v"))


@query("""WITH X AS (SELECT l_linenumber::BIGINT b, l_suppkey::BIGINT s, l_partkey::BIGINT p, sum(l_quantity) v FROM lineitem GROUP BY ALL),
Y AS (SELECT l_linenumber::BIGINT b, l_partkey::BIGINT p, list_position(['A','N','R'], l_returnflag)::BIGINT - 1 z, count(*)::DOUBLE v FROM lineitem GROUP BY ALL)
SELECT b, s, z, sum(X.v * Y.v) v FROM X JOIN Y USING (b, p) GROUP BY ALL""")
def contract_batched(s, d):
    li = table(s, d, "lineitem")
    x = Frame.of(li, {"b": "l_linenumber", "s": "l_suppkey", "p": "l_partkey"}, "l_quantity", unique=False)
    y = Frame.of(li, {"b": "l_linenumber", "p": "l_partkey", "z": _code("l_returnflag", _FLAGS)}, F.lit(1.0), unique=False)
    return rows(contract("b s p, b p z -> b s z", x, y), None)


@query("WITH R AS (SELECT n_regionkey::BIGINT r, count(*)::DOUBLE v FROM nation GROUP BY ALL) SELECT a.r i, b.r j, a.v * b.v v FROM R a, R b")
def contract_outer(s, d):
    x = Frame.of(table(s, d, "nation"), {"i": "n_regionkey"}, F.lit(1.0), sizes={"i": 5}, unique=False)
    return rows(contract("i, j -> i j", x, x.renamed(("j",))), None)


@query(f"WITH {_C} SELECT n, m, round(v * b, 2) + 0.0 v FROM C")
def contract_hadamard(s, d):
    return rows(contract("n m, n m -> n m", segments(s, d), segments(s, d, "c_acctbal")), 2)


@query(f"WITH {_T} SELECT p, s, round(v * s_acctbal, 2) + 0.0 v FROM T JOIN supplier ON s = s_suppkey")
def contract_scale(s, d):
    return rows(contract("p s, s -> p s", flow(s, d), Frame.of(table(s, d, "supplier"), {"s": "s_suppkey"}, "s_acctbal")), 2)


@query(f"WITH {_T} SELECT p, round(sum(v * s_acctbal), 2) + 0.0 v FROM T JOIN supplier ON s = s_suppkey GROUP BY ALL")
def contract_matvec(s, d):
    return rows(contract("p s, s -> p", flow(s, d), Frame.of(table(s, d, "supplier"), {"s": "s_suppkey"}, "s_acctbal")), 2)


@query(f"WITH {_T} SELECT s_nationkey::BIGINT n, sum(v) v FROM T JOIN supplier ON s = s_suppkey GROUP BY ALL")
def contract_input_sum(s, d):
    return rows(contract("p s, s n -> n", flow(s, d), nation_of(s, d)), None)


@query("SELECT r.n_regionkey::BIGINT r, round(sum(c_acctbal), 2) + 0.0 v FROM customer JOIN nation r ON c_nationkey = n_nationkey GROUP BY ALL")
def contract_chain(s, d):
    c = Frame.of(table(s, d, "customer"), {"c": "c_custkey", "n": "c_nationkey"}, "c_acctbal")
    n = Frame.of(table(s, d, "nation"), {"n": "n_nationkey", "r": "n_regionkey"}, F.lit(1.0), sizes={"n": 25, "r": 5})
    return rows(contract("n, n r -> r", contract("c n -> n", c), n), 2)


@query(f"WITH {_W} SELECT n i, l, v FROM W WHERE n = m")
def contract_diagonal(s, d):
    return rows(contract("i i l -> i l", between_nations(s, d)), None)


@query(f"WITH {_W} SELECT l, sum(v) v FROM W WHERE n = m GROUP BY ALL")
def contract_trace(s, d):
    return rows(contract("i i l -> l", between_nations(s, d)), None)


@query(f"WITH {_W} SELECT l, sum(v) v FROM W GROUP BY ALL")
def reduce_ellipsis(s, d):
    return rows(contract("... l -> l", between_nations(s, d)), None)


@query(f"WITH {_T} SELECT s, sum(v) v FROM T GROUP BY ALL")
def reduce_axis(s, d):
    return rows(contract("p s -> s", flow(s, d)), None)


@query(f"WITH {_W} SELECT l, m, n, v FROM W")
def permute(s, d):
    return rows(contract("n ... l -> l ... n", between_nations(s, d)).renamed(("l", "m", "n")), None)


@query(f"WITH {_E}, P AS (SELECT d, (d % 4)::BIGINT o, (d + 1)::DOUBLE v FROM range(64) r(d)) SELECT i, o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d) GROUP BY ALL")
def contract_ellipsis(s, d):
    w = Frame(s.range(64).select(F.col("id").alias("d"), (F.col("id") % 4).alias("o"), (F.col("id") + 1).cast("double").alias("v")), ("d", "o"), {"d": 64, "o": 4})
    return rows(contract("... d, d o -> ... o", embeddings(s, d), w).renamed(("i", "o")))


# --- reshapes ---------------------------------------------------------------------------------------------------


@query(f"WITH {_G} SELECT d, h, round(v, 4) + 0.0 v FROM G")
def reshape_unpack(s, d):
    return rows(grid(s, d).densified())


@query(f"WITH {_G} SELECT h * 30 + d h_d, round(v, 4) + 0.0 v FROM G")
def reshape_pack(s, d):
    return rows(contract("d h -> (h d)", grid(s, d)).densified())


@query(f"WITH {_G} SELECT (d // 5) * 4 + h // 6 d_h, d % 5 wd, h % 6 wh, round(v, 4) + 0.0 v FROM G")
def reshape_windows(s, d):
    families = {"spatial": ("d", "h"), "window": ("wd", "wh")}
    return rows(contract("[*spatial *window] -> (*spatial) *window", grid(s, d), families=families, sizes={"window": (5, 6)}).densified())


@query(f"WITH {_G} SELECT d, h, round(v, 4) + 0.0 v FROM G")
def reshape_windows_back(s, d):
    families = {"spatial": ("d", "h"), "window": ("wd", "wh")}
    cut = contract("[*spatial *window] -> (*spatial) *window", grid(s, d), families=families, sizes={"window": (5, 6)})
    return rows(contract("(*spatial) *window -> [*spatial *window]", cut, families=families, sizes={"spatial": (6, 4), "window": (5, 6)}).renamed(("d", "h")).densified())


# --- layouts ----------------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT {_cut('i', 'n', 3)} _s_dp, i - {_start('i', 'n', 3)} i, d, v FROM E, S")
def layout_split(s, d):
    return contract("i d -> i/dp d", embeddings(s, d), mesh=MESH).to_shards()


@query(f"WITH {_E} SELECT d, i, v FROM E")
def layout_gather(s, d):
    return rows(contract("i/dp d -> d i", contract("i d -> i/dp d", embeddings(s, d), mesh=MESH), mesh=MESH), None)


@query(f"WITH {_E} SELECT {_cut('d', '64', 3)} _s_dp, i, d - {_start('d', '64', 3)} d, v FROM E")
def layout_reshard(s, d):
    return contract("i/dp d -> i d/dp", contract("i d -> i/dp d", embeddings(s, d), mesh=MESH), mesh=MESH).placed()


@query(f"WITH {_E} SELECT {_cut('i', 'n', 2)} _s_sp, {_cut('d', '64', 3)} _s_dp, i - {_start('i', 'n', 2)} i, d - {_start('d', '64', 3)} d, v FROM E, S")
def layout_swap(s, d):
    first = contract("i d -> i/dp d/sp", embeddings(s, d), mesh=MESH)
    return contract("i/dp d/sp -> i/sp d/dp", first, mesh=MESH).to_shards()


@query(f"WITH {_E} SELECT {_cut('i', 'n', 6)} \"_s_dp-sp\", i - {_start('i', 'n', 6)} i, d, v FROM E, S")
def layout_compound(s, d):
    return contract("i d -> i/sp-dp d", embeddings(s, d), mesh=MESH).to_shards()


@query(f"WITH {_E} SELECT CASE WHEN d < 10 THEN 0 WHEN d < 60 THEN 1 ELSE 2 END::INTEGER _s_dp, i, d - CASE WHEN d < 10 THEN 0 WHEN d < 60 THEN 10 ELSE 60 END d, v FROM E")
def layout_given_shapes(s, d):
    return contract("i d -> i d/dp", embeddings(s, d), mesh=MESH, shapes={"dp": {"d": [10, 50, 4]}}).to_shards()


@query("""SELECT dp::INTEGER dp, sp::INTEGER sp, 0::INTEGER tp, 'o' axis, (CASE dp WHEN 0 THEN 0 WHEN 1 THEN 240 ELSE 480 END)::BIGINT "start", (CASE dp WHEN 0 THEN 240 WHEN 1 THEN 480 ELSE 721 END)::BIGINT stop FROM range(3) a(dp), range(2) b(sp)
UNION ALL SELECT dp::INTEGER, sp::INTEGER, 0::INTEGER, 'c', (sp * 32)::BIGINT, (sp * 32 + 32)::BIGINT FROM range(3) a(dp), range(2) b(sp)""")
def layout_slices(s, d):
    return slices_table(s, "o/dp c/sp", (721, 64), Mesh.of(dp=3, sp=2, tp=1), factors={"o": 3})


# --- partial sums -----------------------------------------------------------------------------------------------


def _kept(s, d) -> Frame:
    return contract("p s/dp, s/dp n -> p n // dp", flow(s, d), replace(nation_of(s, d)), mesh=MESH)


@query(f"WITH {_T}, S AS (SELECT max(s) + 1 n FROM T) SELECT p, s_nationkey::BIGINT n, {_cut('s', 'S.n', 3)} _p_dp, sum(v) v FROM T JOIN supplier ON s = s_suppkey, S GROUP BY ALL")
def partial_keep(s, d):
    return rows(_kept(s, d), None)


@query(f"WITH {_T} SELECT p, s_nationkey::BIGINT n, sum(v) v FROM T JOIN supplier ON s = s_suppkey GROUP BY ALL")
def partial_full(s, d):
    return rows(contract("p n // dp -> p n", _kept(s, d), mesh=MESH), None)


@query(f"WITH {_T}, S AS (SELECT max(p) + 1 n FROM T) SELECT {_cut('p', 'S.n', 3)} _s_dp, p - {_start('p', 'S.n', 3)} p, s_nationkey::BIGINT n, sum(v) v FROM T JOIN supplier ON s = s_suppkey, S GROUP BY ALL")
def partial_scatter(s, d):
    return contract("p n // dp -> p/dp n", _kept(s, d), mesh=MESH).to_shards()


@query("SELECT c_nationkey::BIGINT n, 3.0::DOUBLE * count(*) v FROM customer GROUP BY ALL")
def partial_replicated(s, d):
    x = Frame.of(table(s, d, "customer"), {"n": "c_nationkey"}, F.lit(1.0), sizes={"n": 25}, unique=False)
    return rows(contract("n // dp -> n", contract("n -> n // dp", x, mesh=MESH), mesh=MESH), None)


@query("SELECT c_nationkey::BIGINT n, p::INTEGER _p_dp, count(*)::DOUBLE v FROM customer, range(3) r(p) GROUP BY ALL")
def partial_from_shards(s, d):
    x = Frame.of(table(s, d, "customer"), {"n": "c_nationkey"}, F.lit(1.0), sizes={"n": 25}, unique=False)
    return rows(contract("n/dp -> n // dp", x, mesh=MESH), None)


@query("SELECT 0::BIGINT loss, round(sum(l_quantity * (1 + l_linenumber)), 2) + 0.0 v FROM lineitem")
def partial_scalar(s, d):
    li = table(s, d, "lineitem").select(F.lit(0).cast("bigint").alias("loss"), (F.col("l_linenumber") % 3).cast("int").alias("_p_dp"), (F.col("l_orderkey") % 2).cast("int").alias("_p_sp"), (F.col("l_quantity") * (1 + F.col("l_linenumber"))).alias("v"))
    x = Frame(li, ("loss",), {"loss": 1}, partials=("sp", "dp"), mesh=MESH, unique=False)
    return rows(contract("loss // (sp,dp) -> loss", x, mesh=MESH), 2)


@query(f"WITH {_W}, A AS (SELECT n, m, sum(v) v FROM W GROUP BY ALL), B AS (SELECT n, m, l, v FROM W) SELECT a.n, b.l e, {_cut('a.m', '25', 4)} _p_tp, sum(a.v * b.v) v FROM A a JOIN (SELECT m, l, sum(v) v FROM B GROUP BY ALL) b USING (m) WHERE {_cut('a.n', '25', 4)} = {_cut('a.m', '25', 4)} GROUP BY ALL")
def partial_own_interval(s, d):
    w = between_nations(s, d)
    return rows(contract("n m/tp, m/tp e -> n/tp e // tp", contract("n m l -> n m", w), contract("n m l -> m l", w).renamed(("m", "e")), mesh=MESH).renamed(("n", "e")), None)


# --- products of placed operands --------------------------------------------------------------------------------


def _weights(s: SparkSession) -> Frame:
    """P[o d]: 6 x 64 whole numbers."""
    df = s.range(6 * 64).select(F.floor(F.col("id") / 64).alias("o"), (F.col("id") % 64).alias("d"), ((F.col("id") * 7) % 11 - 5).cast("double").alias("v"))
    return Frame(df, ("o", "d"), {"o": 6, "d": 64})


_P = "P AS (SELECT id // 64 o, id % 64 d, ((id * 7) % 11 - 5)::DOUBLE v FROM range(384) r(id))"


@query(f"WITH {_E}, {_P} SELECT {_cut('o', '6', 4)} _s_tp, i, o - {_start('o', '6', 4)} o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d) GROUP BY i, o")
def product_columns(s, d):
    """A linear map whose outputs lie on several ranks."""
    df = contract("i d, o/tp d -> i o/tp", embeddings(s, d), _weights(s), mesh=MESH).to_shards()
    return df.select("_s_tp", "i", "o", rounded("v").alias("v"))


@query(f"WITH {_E}, {_P} SELECT i, o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d) GROUP BY i, o")
def product_rows(s, d):
    """A linear map whose inputs lie on several ranks: partial sums, then one."""
    return rows(contract("i d/tp, o d/tp -> i o", embeddings(s, d), _weights(s), mesh=MESH))


@query(f"WITH {_E}, {_P} SELECT {_cut('i', 'n', 4)} _s_tp, i - {_start('i', 'n', 4)} i, o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d), S GROUP BY i, o, n")
def product_scatter(s, d):
    df = contract("i d/tp, o d/tp -> i/tp o", embeddings(s, d), _weights(s), mesh=MESH).to_shards()
    return df.select("_s_tp", "i", "o", rounded("v").alias("v"))


@query(f"WITH {_E}, {_P} SELECT {_cut('i', 'n', 2)} _s_sp, {_cut('o', '6', 3)} _s_dp, i - {_start('i', 'n', 2)} i, o - {_start('o', '6', 3)} o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d), S GROUP BY i, o, n")
def product_crossed(s, d):
    df = contract("i/sp d/dp, d/sp o/dp -> i/sp o/dp", embeddings(s, d), contract("o d -> d o", _weights(s)), mesh=MESH).to_shards()
    return df.select("_s_sp", "_s_dp", "i", "o", rounded("v").alias("v"))


@query(f"WITH {_E} SELECT {_cut('i', 'n', 4)} _s_tp, i - {_start('i', 'n', 4)} i, d, round(v * v, 6) + 0.0 v FROM E, S")
def product_elementwise(s, d):
    e = embeddings(s, d)
    df = contract("i/tp d, i d -> i/tp d", e, e, mesh=MESH).to_shards()
    return df.select("_s_tp", "i", "d", rounded("v", 6).alias("v"))


@query(f"WITH {_E}, K AS (SELECT label::BIGINT k, d, sum(E.v) v FROM E JOIN embeddings ON i = vec_id GROUP BY ALL), A AS (SELECT i, k, sum(E.v * K.v) v FROM E JOIN K USING (d) GROUP BY ALL) SELECT i, d, round(sum(A.v * K.v), 3) + 0.0 v FROM A JOIN K USING (k) GROUP BY i, d")
def product_attention(s, d):
    """Scores of queries against keys, then values weighed by them (no softmax: the engine is linear)."""
    e = embeddings(s, d)
    label = Frame.of(table(s, d, "embeddings"), {"i": "vec_id", "k": "label"}, F.lit(1.0), sizes={"k": 10})
    keys = contract("i d, i k -> k d", e, label)
    score = contract("q/tp d, k/tp d -> q/tp k", e, keys, mesh=MESH)
    return rows(contract("q/tp k, k/tp d -> q d", score, keys, mesh=MESH).renamed(("i", "d")), 3)


# --- neighbours -------------------------------------------------------------------------------------------------


@query(f"WITH {_G} SELECT (d + 2) % 30 d, (h + 19) % 24 h, round(v, 4) + 0.0 v FROM G")
def roll_axes(s, d):
    return rows(roll("*f -> *f", grid(s, d), {"f": (2, -5)}, families={"f": ("d", "h")}).densified())


@query(f"WITH {_H}, R AS (SELECT (t + 717) % 720 t, v FROM H) SELECT {_cut('t', '720', 4)} _s_tp, t - {_start('t', '720', 4)} t, round(v, 4) + 0.0 v FROM R")
def roll_placed(s, d):
    df = roll("t/tp -> t/tp", hours(s, d).densified(), {"t": -3}, mesh=MESH).to_shards()
    return df.select("_s_tp", "t", rounded("v").alias("v"))


@query(f"WITH {_H} SELECT (({_cut('t', '720', 4)} + 1) % 4)::INTEGER _s_tp, t - {_start('t', '720', 4)} t, round(v, 4) + 0.0 v FROM H")
def roll_whole_shards(s, d):
    df = roll_shards(contract("t -> t/tp", hours(s, d).densified(), mesh=MESH), "tp", 1)
    return df.select("_s_tp", "t", rounded("v").alias("v"))


@query(f"WITH {_H} SELECT o::BIGINT t, round(coalesce(v, -1), 4) + 0.0 v FROM range(723) r(o) LEFT JOIN H ON t = o - 2")
def halo_constant(s, d):
    return rows(halo("t -> t", hours(s, d).densified(), {"t": (2, 1)}, fill=-1))


@query(f"WITH {_H} SELECT o::BIGINT t, round(v, 4) + 0.0 v FROM range(723) r(o) JOIN H ON t = (o - 2 + 720) % 720")
def halo_periodic(s, d):
    return rows(halo("t -> t", hours(s, d).densified(), {"t": (2, 1)}, boundary="periodic"))


@query(f"WITH {_G} SELECT o::BIGINT d, p::BIGINT h, round(v, 4) + 0.0 v FROM range(33) r(o), range(26) q(p) JOIN G ON G.d = greatest(0, least(29, o - 2)) AND G.h = greatest(0, least(23, p - 1))")
def halo_replicate(s, d):
    return rows(halo("d h -> d h", grid(s, d).densified(), {"d": (2, 1), "h": 1}, boundary="replicate"))


@query(f"WITH {_H}, O AS (SELECT s, o FROM range(4) a(s), range(190) b(o)) SELECT s::INTEGER _s_tp, o::BIGINT t, round(coalesce(v, -3), 4) + 0.0 v FROM O LEFT JOIN H ON t = s * 180 + o - 3 WHERE o < 180 + 3 + 7")
def halo_placed(s, d):
    df = halo_shards("t/tp -> t/tp", hours(s, d).densified(), {"t": (3, 7)}, mesh=MESH, fill=-3)
    return df.select("_s_tp", "t", rounded("v").alias("v"))


@query(f"WITH {_H} SELECT c::BIGINT t, k::BIGINT kt, round(coalesce(v, -1), 4) + 0.0 v FROM range(720) a(c), range(4) b(k) LEFT JOIN H ON t = c - 2 + k")
def window_constant(s, d):
    return rows(window("t -> t kt", hours(s, d).densified(), {"t": "kt"}, {"t": (2, 1)}, fill=-1))


@query(f"WITH {_G} SELECT c::BIGINT d, k::BIGINT kd, e::BIGINT h, l::BIGINT kh, round(v, 4) + 0.0 v FROM range(30) a(c), range(3) b(k), range(24) x(e), range(3) y(l) JOIN G ON G.d = greatest(0, least(29, c - 1 + k)) AND G.h = greatest(0, least(23, e - 1 + l))")
def window_replicate(s, d):
    return rows(window("d h -> d kd h kh", grid(s, d).densified(), {"d": "kd", "h": "kh"}, 1, boundary="replicate"))


@query(f"WITH {_H} SELECT c::BIGINT t, round(sum(v * (k + 1)), 3) + 0.0 v FROM range(720) a(c), range(5) b(k) JOIN H ON t = (c - 2 + k + 720) % 720 GROUP BY c")
def window_average(s, d):
    """Windows contracted with weights: a weighted moving sum around the clock."""
    w = Frame(s.range(5).select(F.col("id").alias("k"), (F.col("id") + 1).cast("double").alias("v")), ("k",), {"k": 5})
    return rows(contract("t k, k -> t", window("t -> t k", hours(s, d), {"t": "k"}, 2, boundary="periodic"), w).densified(), 3)


# --- convolutions -----------------------------------------------------------------------------------------------


def _kernel(s: SparkSession, *sizes: int) -> Frame:
    """w[o c kh kw kz]: whole numbers."""
    names = ("o", "c", "kh", "kw", "kz")[: len(sizes)]
    x = _grid(s.range(1), names, dict(zip(names, sizes, strict=True)))
    value = sum(((k + 2) * F.col(n) for k, n in enumerate(names)), F.lit(1)) % 5 - 1
    return Frame(x.select(*names, value.cast("double").alias("v")), names, dict(zip(names, sizes, strict=True)))


@query(f"WITH {_H} SELECT t.t, o::BIGINT o, round(sum(coalesce(H.v, 0) * ((1 + 2 * o + 4 * k) % 5 - 1)), 3) + 0.0 v FROM H t, range(2) a(o), range(3) b(k) LEFT JOIN H ON H.t = t.t + 2 * (k - 1) GROUP BY t.t, o")
def conv_dilated(s, d):
    x = hours(s, d)
    x = replace(x, df=x.df.select("t", F.lit(0).cast("bigint").alias("c"), "v"), axes=("t", "c"), sizes={**x.sizes, "c": 1})
    return rows(conv("t c, o c kh -> t o", x, _kernel(s, 2, 1, 3), {"t": "kh"}, dilation=2).densified(), 3)


@query(f"""WITH {_G} SELECT e.d, e.h, o::BIGINT o, round(sum(coalesce(G.v, 0) * ((1 + 2 * o + 4 * k + 5 * l) % 5 - 1)) + o + 1, 3) + 0.0 v
FROM G e, range(2) a(o), range(3) b(k), range(3) c(l) LEFT JOIN G ON G.d = e.d + k - 1 AND G.h = e.h + l - 1 GROUP BY e.d, e.h, o""")
def conv_plane(s, d):
    x = grid(s, d)
    x = replace(x, df=x.df.select("d", "h", F.lit(0).cast("bigint").alias("c"), "v"), axes=("d", "h", "c"), sizes={**x.sizes, "c": 1})
    bias = Frame(s.range(2).select(F.col("id").alias("o"), (F.col("id") + 1).cast("double").alias("v")), ("o",), {"o": 2})
    return rows(conv("d h c, o c kh kw -> d h o", x, _kernel(s, 2, 1, 3, 3), {"d": "kh", "h": "kw"}, bias=bias), 3)


@query(f"WITH {_H} SELECT t.t, o::BIGINT o, round(sum(H.v * ((1 + 2 * o + 4 * k) % 5 - 1)), 3) + 0.0 v FROM H t, range(2) a(o), range(3) b(k) JOIN H ON H.t = (t.t + k - 1 + 720) % 720 GROUP BY t.t, o")
def conv_circular(s, d):
    x = hours(s, d)
    x = replace(x, df=x.df.select("t", F.lit(0).cast("bigint").alias("c"), "v"), axes=("t", "c"), sizes={**x.sizes, "c": 1})
    return rows(conv("t/tp c, o c kh -> t/tp o", x, _kernel(s, 2, 1, 3), {"t": "kh"}, boundary="periodic", mesh=MESH).densified(), 3)


# --- Fourier ----------------------------------------------------------------------------------------------------

_SUM = "round(sum({v} * cos(-2 * pi() * ((({a}) % {n})::DOUBLE) / {n})), 4) + 0.0 re, round(sum({v} * sin(-2 * pi() * ((({a}) % {n})::DOUBLE) / {n})), 4) + 0.0 im"


@query(f"WITH {_G} SELECT d, k::BIGINT k, {_SUM.format(v='v', a='k * h', n=24)} FROM G, range(24) r(k) GROUP BY d, k")
def fft_terms(s, d):
    return rows(fft("d h -> d k", grid(s, d).densified(), {"h": "k"}), 4)


@query(f"WITH {_H} SELECT k::BIGINT k, {_SUM.format(v='v', a='k * t', n=720)} FROM H, range(720) r(k) GROUP BY k")
def fft_stages(s, d):
    return rows(fft("t -> k", hours(s, d), {"t": "k"}), 4)


@query(f"WITH {_E} SELECT i, k::BIGINT k, {_SUM.format(v='v', a='k * d', n=64)} FROM E, range(33) r(k) GROUP BY i, k")
def fft_real_lines(s, d):
    return rows(fft("i d -> i k", embeddings(s, d), {"d": "k"}, real=True, method="lines"), 4)


@query(f"WITH {_G} SELECT kd::BIGINT kd, kh::BIGINT kh, {_SUM.format(v='v / sqrt(720)', a='kd * d * 24 + kh * h * 30', n=720)} FROM G, range(30) a(kd), range(24) b(kh) GROUP BY kd, kh")
def fft_plane(s, d):
    return rows(fft("d h -> kd kh", grid(s, d), {"d": "kd", "h": "kh"}, norm="ortho"), 4)


@query(f"WITH {_G} SELECT d, h, round(v, 3) + 0.0 re, 0.0::DOUBLE im FROM G")
def fft_inverse(s, d):
    return rows(fft("d k -> d h", fft("d h -> d k", grid(s, d).densified(), {"h": "k"}), {"k": "h"}, inverse=True), 3)


@query(f"WITH {_G} SELECT d, h, round(v, 3) + 0.0 v FROM G")
def fft_real_inverse(s, d):
    half = fft("d h -> d k", grid(s, d).densified(), {"h": "k"}, real=True)
    return rows(fft("d k -> d h", half, {"k": "h"}, inverse=True, real=True, signal_sizes={"h": 24}), 3)


# --- more layouts -----------------------------------------------------------------------------------------------


@query(f"WITH {_H} SELECT t // 24 d, t % 24 h, round(v, 4) + 0.0 v FROM H")
def reshape_turn(s, d):
    """Unpacked and turned at once, then back in the first order."""
    return rows(contract("(d h) -> h d", hours(s, d), sizes={"d": 30, "h": 24}).densified())


@query(f"WITH {_H}, B AS (SELECT t // 120 a, t // 12 % 10 b, t % 12 c, v FROM H) SELECT (a // 2 * 2 + b // 5) * 4 + c // 3 a_b_c, a % 2 wa, b % 5 wb, c % 3 wc, round(v, 4) + 0.0 v FROM B")
def reshape_volume(s, d):
    """Windows of a volume."""
    families = {"spatial": ("a", "b", "c"), "window": ("wa", "wb", "wc")}
    volume = contract("(a b c) -> a b c", hours(s, d), sizes={"a": 6, "b": 10, "c": 12})
    return rows(contract("[*spatial *window] -> (*spatial) *window", volume, families=families, sizes={"window": (2, 5, 3)}).densified())


@query(f"WITH {_E} SELECT {_cut('d', '64', 3)} _s_dp, d - {_start('d', '64', 3)} d, i, v FROM E")
def layout_split_turned(s, d):
    return contract("i d -> d/dp i", embeddings(s, d), mesh=MESH).to_shards()


@query(f"WITH {_E} SELECT {_cut('d', '64', 4)} _s_tp, i, d - {_start('d', '64', 4)} d, v FROM E")
def layout_ellipsis(s, d):
    return contract("... d -> ... d/tp", embeddings(s, d), mesh=MESH).renamed(("i", "d")).to_shards()


@query(f"WITH {_E} SELECT {_cut('i', 'n', 2)} _s_sp, i - {_start('i', 'n', 2)} i, d, v FROM E, S")
def layout_cross_mesh(s, d):
    return contract("i/dp d -> i/sp d", contract("i d -> i/dp d", embeddings(s, d), mesh=MESH), mesh=MESH).to_shards()


@query(f"WITH {_W} SELECT {_cut('n', '25', 2)} _s_sp, {_cut('m', '25', 4)} _s_tp, {_cut('l', '8', 3)} _s_dp, n - {_start('n', '25', 2)} n, m - {_start('m', '25', 4)} m, l - {_start('l', '8', 3)} l, v FROM W")
def layout_cycle(s, d):
    """Three axes exchange their dimensions in a ring."""
    first = contract("n m l -> n/dp m/sp l/tp", between_nations(s, d), mesh=MESH)
    return contract("n/dp m/sp l/tp -> n/sp m/tp l/dp", first, mesh=MESH).to_shards()


@query(f"WITH {_T}, S AS (SELECT max(s) + 1 n FROM T) SELECT p, s_nationkey::BIGINT n, {_cut('s', 'S.n', 6)} \"_p_dp-sp\", sum(v) v FROM T JOIN supplier ON s = s_suppkey, S GROUP BY ALL")
def partial_compound(s, d):
    return rows(contract("p s/dp-sp, s/dp-sp n -> p n // dp-sp", flow(s, d), nation_of(s, d), mesh=MESH), None)


@query(f"WITH {_T} SELECT p, s_nationkey::BIGINT n, sum(v) v FROM T JOIN supplier ON s = s_suppkey GROUP BY ALL")
def partial_compound_full(s, d):
    kept = contract("p s/dp-sp, s/dp-sp n -> p n // dp-sp", flow(s, d), nation_of(s, d), mesh=MESH)
    return rows(contract("p n // dp-sp -> p n", kept, mesh=MESH), None)


# --- more products of placed operands ---------------------------------------------------------------------------

_A = f"{_W}, A AS (SELECT n, m, sum(v) v FROM W GROUP BY ALL)"


def _square(s, d) -> Frame:
    """A[n m]: quantity between nations."""
    return contract("n m l -> n m", between_nations(s, d))


@query(f"WITH {_W} SELECT a.n, b.n e, sum(a.v * b.v) v FROM W a JOIN W b USING (m, l) GROUP BY ALL")
def product_two_axes(s, d):
    """Two summed axes, each on its own dimension."""
    w = between_nations(s, d)
    return rows(contract("n m/sp l/tp, e m/sp l/tp -> n e", w, w.renamed(("e", "m", "l")), mesh=MESH), None)


@query(f"WITH {_A}, R AS (SELECT a.n, b.m e, sum(a.v * b.v) v FROM A a JOIN A b ON a.m = b.n GROUP BY ALL) SELECT {_cut('n', '25', 3)} _s_dp, {_cut('e', '25', 2)} _s_sp, n - {_start('n', '25', 3)} n, e - {_start('e', '25', 2)} e, v FROM R")
def product_summa(s, d):
    """Both operands and the result cut along both dimensions."""
    a = _square(s, d)
    return contract("n/dp k/sp, k/dp e/sp -> n/dp e/sp", a.renamed(("n", "k")), a.renamed(("k", "e")), mesh=MESH).to_shards()


@query(f"WITH {_A}, R AS (SELECT a.n, b.n e, sum(a.v * b.v) v FROM A a JOIN A b USING (m) GROUP BY ALL) SELECT {_cut('n', '25', 2)} _s_sp, {_cut('e', '25', 3)} _s_dp, n - {_start('n', '25', 2)} n, e - {_start('e', '25', 3)} e, v FROM R")
def product_mirrored(s, d):
    """The summed axis lies along one dimension in one operand and along the other in the other; the result's axes are turned."""
    a = _square(s, d)
    return contract("n/sp k/dp, e/dp k/sp -> e/dp n/sp", a.renamed(("n", "k")), a.renamed(("e", "k")), mesh=MESH).to_shards()


@query(f"WITH {_W}, R AS (SELECT a.l, a.n, b.m e, sum(a.v * b.v) v FROM W a JOIN W b ON a.l = b.l AND a.m = b.n GROUP BY ALL) SELECT {_cut('l', '8', 3)} _s_dp, l - {_start('l', '8', 3)} l, n, e, v FROM R")
def product_batch(s, d):
    """A batch axis that both operands hold in the same intervals."""
    w = between_nations(s, d)
    return contract("n k l/dp, k e l/dp -> l/dp n e", w.renamed(("n", "k", "l")), w.renamed(("k", "e", "l")), mesh=MESH).to_shards()


@query(f"WITH {_E}, {_P} SELECT i, o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d) GROUP BY i, o")
def product_gather_free(s, d):
    return rows(contract("i/tp d, o d -> i o", embeddings(s, d), _weights(s), mesh=MESH))


@query(f"WITH {_E}, {_P} SELECT {_cut('i', 'n', 4)} _s_tp, i - {_start('i', 'n', 4)} i, o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d), S GROUP BY i, o, n")
def product_split_free(s, d):
    df = contract("i d, o d -> i/tp o", embeddings(s, d), _weights(s), mesh=MESH).to_shards()
    return df.select("_s_tp", "i", "o", rounded("v").alias("v"))


@query(f"WITH {_E}, {_P} SELECT i, o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d) GROUP BY i, o")
def product_split_summed(s, d):
    """One operand holds the summed axis whole, the other in intervals."""
    return rows(contract("i d, o d/tp -> i o", embeddings(s, d), _weights(s), mesh=MESH))


@query(f"WITH {_E}, {_P} SELECT {_cut('o', '6', 3)} _s_dp, i, o - {_start('o', '6', 3)} o, round(sum(E.v * P.v), 4) + 0.0 v FROM E JOIN P USING (d) GROUP BY i, o")
def product_moved(s, d):
    """The result lies along another axis than its operand."""
    df = contract("i/dp d, o d -> i o/dp", embeddings(s, d), _weights(s), mesh=MESH).to_shards()
    return df.select("_s_dp", "i", "o", rounded("v").alias("v"))


@query(f"WITH {_E}, K AS (SELECT label::BIGINT k, d, sum(E.v) v FROM E JOIN embeddings ON i = vec_id GROUP BY ALL) SELECT i, (E.d // 16)::BIGINT h, k, round(sum(E.v * K.v), 3) + 0.0 v FROM E JOIN K USING (d) GROUP BY ALL")
def product_heads(s, d):
    """Scores of queries against keys for each of four heads, which lie on their own ranks."""
    e = embeddings(s, d)
    label = Frame.of(table(s, d, "embeddings"), {"i": "vec_id", "k": "label"}, F.lit(1.0), sizes={"k": 10})
    keys = contract("k (h e) -> h k e", contract("i d, i k -> k d", e, label), sizes={"h": 4, "e": 16})
    heads = contract("i (h e) -> h i e", e, sizes={"h": 4, "e": 16})
    return rows(contract("h/tp i e, h/tp k e -> h/tp i k", heads, keys, mesh=MESH), 3)


# --- more neighbours, convolutions and transforms ---------------------------------------------------------------


@query(f"WITH {_H} SELECT c::BIGINT t, k::BIGINT kt, round(v, 4) + 0.0 v FROM range(720) a(c), range(4) b(k) JOIN H ON t = (c - 2 + k + 720) % 720")
def window_periodic(s, d):
    return rows(window("t -> t kt", hours(s, d).densified(), {"t": "kt"}, {"t": (2, 1)}, boundary="periodic"))


@query(f"WITH {_H} SELECT s::INTEGER _s_tp, o::BIGINT t, round(v, 4) + 0.0 v FROM range(4) a(s), range(190) b(o) JOIN H ON t = (s * 180 + o - 3 + 720) % 720")
def halo_placed_periodic(s, d):
    df = halo_shards("t/tp -> t/tp", hours(s, d).densified(), {"t": (3, 7)}, mesh=MESH, boundary="periodic")
    return df.select("_s_tp", "t", rounded("v").alias("v"))


@query(f"WITH {_H} SELECT s::INTEGER _s_tp, o::BIGINT t, round(v, 4) + 0.0 v FROM range(4) a(s), range(190) b(o) JOIN H ON t = greatest(0, least(719, s * 180 + o - 3))")
def halo_placed_replicate(s, d):
    df = halo_shards("t/tp -> t/tp", hours(s, d).densified(), {"t": (3, 7)}, mesh=MESH, boundary="replicate")
    return df.select("_s_tp", "t", rounded("v").alias("v"))


@query(f"""WITH {_H}, X AS (SELECT t // 24 d, t // 6 % 4 q, t // 2 % 3 r, t % 2 c, v FROM H)
SELECT a.d::BIGINT d, b.q::BIGINT q, e.r::BIGINT r, o::BIGINT o, round(sum(X.v * ((1 + 2 * o + 3 * X.c + 4 * k + 5 * l + 6 * z) % 5 - 1)), 3) + 0.0 v
FROM range(30) a(d), range(4) b(q), range(3) e(r), range(2) u(o), range(3) f(k), range(3) g(l), range(3) h(z)
JOIN X ON X.d = greatest(0, least(29, a.d + k - 1)) AND X.q = greatest(0, least(3, b.q + l - 1)) AND X.r = greatest(0, least(2, e.r + z - 1)) GROUP BY ALL""")
def conv_volume(s, d):
    """Three windowed axes, two channels in and out, ends replicated."""
    x = contract("(d q r c) -> d q r c", hours(s, d), sizes={"d": 30, "q": 4, "r": 3, "c": 2})
    return rows(conv("d q r c, o c kh kw kz -> d q r o", x, _kernel(s, 2, 2, 3, 3, 3), {"d": "kh", "q": "kw", "r": "kz"}, boundary="replicate").densified(), 3)


@query(f"""WITH {_H}, X AS (SELECT t // 24 d, t // 2 % 12 h, t % 2 c, v FROM H), C AS (SELECT c::BIGINT c FROM range(2) w(c))
SELECT a.d::BIGINT d, b.h::BIGINT h, o::BIGINT o, round(sum(coalesce(X.v, -1) * ((1 + 2 * o + 3 * C.c + 4 * k + 5 * l) % 5 - 1)), 3) + 0.0 v
FROM range(30) a(d), range(12) b(h), range(2) u(o), range(3) f(k), range(3) g(l), C LEFT JOIN X ON X.d = a.d + k - 2 AND X.h = b.h + l - 1 AND X.c = C.c GROUP BY ALL""")
def conv_filled(s, d):
    """Two channels, a fill beside the ends, and margins that are given."""
    x = contract("(d h c) -> d h c", hours(s, d), sizes={"d": 30, "h": 12, "c": 2}).densified()
    return rows(conv("d h c, o c kh kw -> d h o", x, _kernel(s, 2, 2, 3, 3), {"d": "kh", "h": "kw"}, padding={"d": (2, 0), "h": 1}, fill=-1).densified(), 3)


_BACK = "round(sum({v} * cos(2 * pi() * ((({a}) % {n})::DOUBLE) / {n})), 4) + 0.0 re, round(sum({v} * sin(2 * pi() * ((({a}) % {n})::DOUBLE) / {n})), 4) + 0.0 im"


@query(f"WITH {_G} SELECT d, k::BIGINT k, {_SUM.format(v='v / 24', a='k * h', n=24).replace(', 4)', ', 6)')} FROM G, range(24) r(k) GROUP BY d, k")
def fft_forward_norm(s, d):
    """The factor goes with the forward transform; the result's axes are turned."""
    return rows(fft("d h -> k d", grid(s, d).densified(), {"h": "k"}, norm="forward"), 6)  # at six digits no value lies halfway


@query(f"WITH {_H} SELECT k::BIGINT t, {_BACK.format(v='v', a='k * t', n=720)} FROM H, range(720) r(k) GROUP BY k")
def fft_inverse_norm(s, d):
    return rows(fft("k -> t", hours(s, d).renamed(("k",)), {"k": "t"}, inverse=True, norm="forward"), 4)


@query(f"WITH {_G} SELECT {_cut('d', '30', 3)} _s_dp, d - {_start('d', '30', 3)} d, h, round(v, 4) + 0.0 v FROM G")
def fft_layout(s, d):
    """Without axes to transform, only the order and places change."""
    df = fft("d h -> h d/dp", grid(s, d).densified(), {}, mesh=MESH).to_shards()
    return df.select("_s_dp", "d", "h", rounded("v").alias("v"))


@query(f"WITH {_H} SELECT t, round(v, 3) + 0.0 v FROM H")
def fft_real_inverse_stages(s, d):
    half = fft("t -> k", hours(s, d), {"t": "k"}, real=True)
    return rows(fft("k -> t", half, {"k": "t"}, inverse=True, real=True, signal_sizes={"t": HOURS}), 3)


@query(f"WITH {_E} SELECT i, d, round(v, 3) + 0.0 v FROM E")
def fft_real_inverse_lines(s, d):
    half = fft("i d -> i k", embeddings(s, d), {"d": "k"}, real=True)
    return rows(fft("i k -> i d", half, {"k": "d"}, inverse=True, real=True, method="lines"), 3)


# --- adjoints ---------------------------------------------------------------------------------------------------


@query(f"WITH {_H} SELECT t, round(v * (1 + (t >= 718)::INTEGER + (t < 1)::INTEGER), 4) + 0.0 v FROM H")
def adjoint_halo(s, d):
    """Every ghost cell gives its value back to the element it shows."""
    x = hours(s, d).densified()
    return rows(adjoint.vjp_halo(halo("t -> t", x, {"t": (2, 1)}, boundary="periodic"), "t", HOURS, (2, 1), "periodic"))


@query(f"WITH {_T} SELECT s, n_nationkey::BIGINT n, sum(v * (n_nationkey + 1)) v FROM T, nation GROUP BY ALL")
def adjoint_contract(s, d):
    """The gradient of N in T N, for a gradient that is n + 1 in every row."""
    x, y = flow(s, d), nation_of(s, d)
    g = contract("p, n -> p n", contract("p s -> p", x).with_df(contract("p s -> p", x).df.select("p", F.lit(1.0).alias("v"))), Frame.of(table(s, d, "nation"), {"n": "n_nationkey"}, F.col("n_nationkey") + 1.0, sizes={"n": 25}))
    return rows(adjoint.vjp_contract("p s, s n -> p n", x, y, g)[1], None)


@query(f"WITH {_H} SELECT (t + 720 - 5) % 720 t, round(v, 4) + 0.0 v FROM H")
def adjoint_roll(s, d):
    return rows(adjoint.vjp_roll("t -> t", hours(s, d).densified(), {"t": 5}))


@query(f"WITH {_H} SELECT t, round(v * (3 - (t = 0)::INTEGER - (t = 719)::INTEGER), 4) + 0.0 v FROM H")
def adjoint_window(s, d):
    x = hours(s, d).densified()
    return rows(adjoint.vjp_window(window("t -> t k", x, {"t": "k"}, 1), "t", "k", HOURS, 1))


# --- duties -----------------------------------------------------------------------------------------------------


def _ranked(s, d) -> Frame:
    """Customers by nation, times rank + 1 on each rank of dp."""
    x = Frame.of(table(s, d, "customer"), {"n": "c_nationkey"}, F.lit(1.0), sizes={"n": 25}, unique=False)
    return replace(spread(x, "dp", (1, 2, 3)), mesh=MESH)


def _registry() -> Registry:
    r = Registry()
    r.register({"w": "n [param, grad=dp, init_sync=dp]", "u": "n [param, grad=none, init_sync=none]"})
    return r


@query("SELECT c_nationkey::BIGINT n, p::INTEGER _p_dp, count(*)::DOUBLE v FROM customer, range(3) r(p) GROUP BY ALL")
def duty_init(s, d):
    return rows(_registry().init("w", _ranked(s, d)), None)


@query("SELECT c_nationkey::BIGINT n, 6.0::DOUBLE * count(*) v FROM customer GROUP BY ALL")
def duty_reduce(s, d):
    return rows(_registry().reduce_grad("w", _ranked(s, d)), None)


@query("SELECT c_nationkey::BIGINT n, 2.0::DOUBLE * count(*) v FROM customer GROUP BY ALL")
def duty_mean(s, d):
    return rows(_registry().reduce_mean("w", _ranked(s, d), "dp"), None)


@query("SELECT c_nationkey::BIGINT n, p::INTEGER _p_dp, sum(p + 1)::DOUBLE v FROM customer, range(3) r(p) GROUP BY ALL")
def duty_none(s, d):
    return rows(_registry().reduce_grad("u", _ranked(s, d)), None)


def _ones_by_nation(s, d) -> Frame:
    return Frame.of(table(s, d, "customer"), {"n": "c_nationkey"}, F.lit(1.0), sizes={"n": 25}, unique=False)


@query("SELECT c_nationkey::BIGINT n, p::INTEGER _p_dp, count(*)::DOUBLE v FROM customer, range(3) r(p) GROUP BY ALL")
def adjoint_sum(s, d):
    """Of a sum over ranks: the same gradient on every rank."""
    return rows(adjoint.vjp_relayout("n // dp -> n", _ones_by_nation(s, d), mesh=MESH), None)


@query("SELECT c_nationkey::BIGINT n, 6.0::DOUBLE * count(*) v FROM customer GROUP BY ALL")
def adjoint_copy(s, d):
    """Of a copy to every rank: the sum of the ranks' gradients."""
    return rows(adjoint.vjp_relayout("n -> n // dp", _ranked(s, d), mesh=MESH), None)


@query("SELECT c_nationkey::BIGINT n, 0::INTEGER _p_dp, 6.0::DOUBLE * count(*) v FROM customer GROUP BY ALL")
def adjoint_broadcast(s, d):
    """Of a copy of rank 0's values to every rank: the sum on rank 0."""
    return rows(adjoint.vjp_broadcast(_ranked(s, d), "dp", 0), None)


@query("SELECT c_nationkey::BIGINT n, p::INTEGER _p_dp, count(*)::DOUBLE v FROM customer, range(3) r(p) GROUP BY ALL")
def adjoint_scatter(s, d):
    """Of a sum that leaves each rank an interval: all intervals on every rank."""
    g = contract("n -> n/dp", _ones_by_nation(s, d), mesh=MESH)
    return rows(adjoint.vjp_relayout("n // dp -> n/dp", g, mesh=MESH), None)


@query(f"WITH C AS (SELECT c_nationkey::BIGINT i, 6.0::DOUBLE * count(*) v FROM customer GROUP BY ALL) SELECT {_cut('i', '25', 3)} _s_dp, i - {_start('i', '25', 3)} n, v FROM C")
def adjoint_gather_sum(s, d):
    """Of intervals gathered on ranks that go on apart: summed, each rank keeps its interval."""
    return adjoint.vjp_relayout("n/dp -> n // dp", _ranked(s, d), mesh=MESH).to_shards()


@query(f"WITH {_E} SELECT {_cut('i', 'n', 3)} _s_dp, i - {_start('i', 'n', 3)} i, d, v FROM E, S")
def adjoint_gather(s, d):
    return adjoint.vjp_relayout("i/dp d -> i d", embeddings(s, d), mesh=MESH).to_shards()


@query(f"WITH {_E} SELECT i, d, v FROM E")
def adjoint_split(s, d):
    return rows(adjoint.vjp_relayout("i d -> i/dp d", contract("i d -> i/dp d", embeddings(s, d), mesh=MESH), mesh=MESH), None)


@query(f"WITH {_E} SELECT {_cut('i', 'n', 3)} _s_dp, i - {_start('i', 'n', 3)} i, d, v FROM E, S")
def adjoint_reshard(s, d):
    return adjoint.vjp_relayout("i/dp d -> i d/dp", contract("i d -> i d/dp", embeddings(s, d), mesh=MESH), mesh=MESH).to_shards()


@query(f"WITH {_E} SELECT {_cut('i', 'n', 3)} _s_dp, {_cut('d', '64', 2)} _s_sp, i - {_start('i', 'n', 3)} i, d - {_start('d', '64', 2)} d, v FROM E, S")
def adjoint_swap(s, d):
    g = contract("i d -> i/sp d/dp", embeddings(s, d), mesh=MESH)
    return adjoint.vjp_relayout("i/dp d/sp -> i/sp d/dp", g, mesh=MESH).to_shards()


@query(f"WITH {_H} SELECT k::BIGINT t, {_BACK.format(v='v', a='k * t', n=720)} FROM H, range(720) r(k) GROUP BY k")
def adjoint_fft(s, d):
    return rows(adjoint.vjp_fft("t -> k", hours(s, d).renamed(("k",)), {"t": "k"}), 4)


@query(f"""WITH {_G}, Y AS (SELECT d, k, sum(v * cos(-2 * pi() * (k * h % 24) / 24)) re, sum(v * sin(-2 * pi() * (k * h % 24) / 24)) im FROM G, range(13) r(k) GROUP BY ALL)
SELECT d, h::BIGINT h, round(sum(re * cos(2 * pi() * (k * h % 24) / 24) - im * sin(2 * pi() * (k * h % 24) / 24)), 3) + 0.0 v FROM Y, range(24) q(h) GROUP BY ALL""")
def adjoint_fft_real(s, d):
    """Of the half spectrum of each day, for a gradient that is this spectrum."""
    g = fft("d h -> d k", grid(s, d).densified(), {"h": "k"}, real=True)
    return rows(adjoint.vjp_fft("d h -> d k", g, {"h": "k"}, real=True, length=24), 3)


@query(f"""WITH {_G}, Y AS (SELECT d, k, (CASE WHEN k = 0 THEN 1 ELSE 2 END) / 24.0 f, sum(v * cos(-2 * pi() * (k * h % 24) / 24)) re, sum(v * sin(-2 * pi() * (k * h % 24) / 24)) im FROM G, range(10) r(k) GROUP BY ALL)
SELECT d, k::BIGINT k, round(f * re, 5) + 0.0 re, round(f * im, 5) + 0.0 im FROM Y""")
def adjoint_fft_prefix(s, d):
    """Of real signals of 24 hours from the first 10 coefficients alone."""
    return rows(adjoint.vjp_fft("d k -> d h", grid(s, d).densified(), {"k": "h"}, real=True, inverse=True, length=10), 5)


_X = f"{_H}, X AS (SELECT t // 2 t, t % 2 c, v FROM H)"


def _conv_adjoint(s, d) -> tuple[Frame, Frame, Frame]:
    """Gradients of a circular convolution with three places, two channels in and two out, for a gradient that is the input."""
    x = contract("(t c) -> t c", hours(s, d), sizes={"t": 360, "c": 2}).densified()
    return adjoint.vjp_conv("t c, o c kh -> t o", x, _kernel(s, 2, 2, 3), x.renamed(("t", "o")), {"t": "kh"}, boundary="periodic")


@query(f"WITH {_X} SELECT a.t::BIGINT t, e.c::BIGINT c, round(sum(X.v * ((1 + 2 * X.c + 3 * e.c + 4 * k) % 5 - 1)), 3) + 0.0 v FROM range(360) a(t), range(2) e(c), range(3) b(k) JOIN X ON X.t = (a.t - k + 1 + 360) % 360 GROUP BY ALL")
def adjoint_conv_input(s, d):
    return rows(_conv_adjoint(s, d)[0], 3)


@query(f"WITH {_X} SELECT g.c::BIGINT o, X.c::BIGINT c, k::BIGINT kh, round(sum(g.v * X.v), 2) + 0.0 v FROM X g, range(3) b(k) JOIN X ON X.t = (g.t + k - 1 + 360) % 360 GROUP BY ALL")
def adjoint_conv_kernel(s, d):
    return rows(_conv_adjoint(s, d)[1], 2)


@query(f"WITH {_X} SELECT c::BIGINT o, round(sum(v), 3) + 0.0 v FROM X GROUP BY ALL")
def adjoint_conv_bias(s, d):
    return rows(_conv_adjoint(s, d)[2], 3)


# --- plans and states -------------------------------------------------------------------------------------------

#: Formulas and the kinds of their steps, in order.
_PLANNED = {
    "a b -> a/dp b": "split",
    "a/dp b -> a b": "gather",
    "a/dp b -> a b/dp": "reshard",
    "a/dp b -> a/sp b": "swap",
    "n h/sp w/dp -> n h/dp w/sp": "swap",
    "a b // tp -> a b": "reduce",
    "a b // tp -> a/tp b": "scatter",
    "a b -> a b // tp": "replicate",
    "a/tp b -> a b // tp": "gather_sum",
    "a // (sp,dp) -> a": "reduce reduce",
    "a b/tp, b c -> a c": "split contract reduce",
    "b n c, h/tp c -> b n h/tp": "replicate contract",
    "l f/tp, f/tp e -> l/tp e // tp": "contract split",
    "a k/dp m/sp, k/sp m/dp b -> a b": "swap contract reduce reduce",
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c) for c in r) + ")" for r in rows)


@query(f"SELECT formula, place::BIGINT place, step FROM (VALUES {_values((f, k, n) for f, names in _PLANNED.items() for k, n in enumerate(names.split()))}) t(formula, place, step)")
def plan_steps(s, d):
    """What `explain` says of a list of formulas."""
    return s.createDataFrame([(f, k, n) for f in _PLANNED for k, n in enumerate(explain(f, MESH).names())], "formula string, place bigint, step string")


#: Formulas, and the free, shared and summed axes of their operands.
_ROLES = {"b l e, b e f -> b l f": ("l f", "b", "e"), "i, j -> i j": ("i j", "", ""), "a b, a b -> a b": ("", "a b", ""), "k l, l k -> k": ("", "k", "l")}


@query(f"SELECT * FROM (VALUES {_values((f, *r) for f, r in _ROLES.items())}) t(formula, free, shared, summed)")
def plan_roles(s, d):
    roles = {f: explain(f).roles for f in _ROLES}
    return s.createDataFrame([(f, " ".join(r.free), " ".join(r.shared), " ".join(r.contracted)) for f, r in roles.items()], "formula string, free string, shared string, summed string")


#: Formulas and their alternatives, the best one first.
_CHOICES = {"a b/tp, b c -> a/tp c": ("default", "reduce_then_split"), "a/tp b, c d -> a c/tp": ("reshard", "default")}


@query(f"SELECT formula, place::BIGINT place, name FROM (VALUES {_values((f, k, n) for f, names in _CHOICES.items() for k, n in enumerate(names))}) t(formula, place, name)")
def plan_choices(s, d):
    return s.createDataFrame([(f, k, a.name) for f in _CHOICES for k, a in enumerate(explain(f, MESH).alternatives)], "formula string, place bigint, name string")


@query("""SELECT * FROM (VALUES ('conv.bias', 'o', '', '', 'dp sp tp'), ('conv.weight', 'o c kh kw', '', '', 'dp sp tp'), ('norm.bias', 'c', '', '', 'dp sp tp'), ('norm.weight', 'c', '', '', 'dp sp tp'),
('up.bias', 'o', 'tp', '', 'dp sp'), ('up.weight', 'o c', 'tp', 'dp sp', 'dp sp')) t(name, axes, shards, sums, shared)""")
def registry_states(s, d):
    """States after layers, a formula that tells a gradient's dimensions, and the end of registration."""
    r = Registry()
    r.register_linear("up", "o/tp c")
    r.register_conv("conv")
    r.register_norm("norm")
    r.register_operand("up.weight", "b/dp n/sp c, o/tp c [param] -> b/dp n/sp o/tp", 1)
    r.finalize()
    r.validate([n for n, _ in r], MESH)
    return s.createDataFrame([(n, " ".join(x.axes), " ".join(x.shards), " ".join(x.reduce), " ".join(x.shared(MESH))) for n, x in r], "name string, axes string, shards string, sums string, shared string")
