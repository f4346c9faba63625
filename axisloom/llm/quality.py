"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

`statistics` turns each whole text into a vector of 24 numbers. `fit` gathers counts, sums and sums of products of
the labelled rows for each class (partial sums on the executors, then one row for each class and pair of numbers) and
shrinks each class covariance towards the pooled one and its diagonal. The model keeps each class's Cholesky factor, so
that a score costs one triangular product: the difference of the two Mahalanobis log-densities plus the log prior
odds, through a logistic curve.

Null and empty texts have the statistics of an empty text and get a score like any other. Rows with null ids, repeated
rows and ties are scored row by row; a label row counts once for each document row with its id, and a label that isn't
0 or 1 doesn't count. A table of labels with fewer than MIN_ROWS rows of either class gives no model: every
score is then the share of label 1 (0.5 without labels). Other columns of the input pass by untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, free_name, map_arrow, saved

NAMES = ("log_words", "log_bytes_per_word", "upper", "digit", "other_ascii", "bang", "symbol", "bar", "comma", "stop", "non_ascii", "space", "newline", "distinct", "top_word", "pair_repeat", "line_repeat", "log_line_words", "byte_entropy", "upper_words", "odd_words", "title_words", "short_words", "long_words")
#: Rows of a class that its covariance needs at least.
MIN_ROWS = 8
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)


def _groups() -> np.ndarray:
    """byte -> one-hot of the classes that shares are taken of."""
    out = np.zeros((256, 11))
    for b in range(256):
        kind = 0 if b in _UPPER else 1 if b in _DIGIT else 3 if b == 33 else 4 if chr(b) in "#$%&*@^~=+<>{}[]\\_" else 5 if b == 124 else 6 if chr(b) in ",;:" else 7 if b == 46 or b == 63 else 8 if b > 127 else 9 if b in (32, 9) else 10 if b in (10, 13) else None if b in _LOWER else 2
        if kind is not None:
            out[b, kind] = 1
    return out


_GROUPS = _groups()
_KEEP_UPPER = bytes(b if b in _UPPER or b == 32 else 32 if b in (9, 10, 13) else 0 for b in range(256))
_ODD = bytes(x for x in range(33, 127) if not (x in _UPPER or x in _LOWER or x in _DIGIT or chr(x) in ".,;:?-'\"()"))


def measure(text: bytes) -> np.ndarray:
    """The statistics of one whole text, in the order of NAMES."""
    n = len(text)
    words = text.split()
    m = len(words)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, int)
    share = count @ _GROUPS / max(n, 1)
    p = count[count > 0] / max(n, 1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    upper = sum(map(bytes.isupper, words))
    title = sum(map(bytes.istitle, words))
    clean = len(text.translate(None, _ODD).split()) if m else 0
    bare = text.translate(None, _ODD)
    lengths = np.fromiter(map(len, words), np.int64, m)
    odd = m - sum(map(bytes.isalpha, bare.split())) if m else 0
    r = math.sqrt
    return np.array([
        math.log1p(m), math.log((n + 1) / (m + 1)), r(share[0]), r(share[1]), r(share[2]), r(share[3]), r(share[4]), r(share[5]),
        r(share[6]), r(share[7]), r(share[8]), share[9], r(share[10]), math.log1p(len(seen)) / math.log1p(m) if m else 1.0, r(max(seen.values(), default=0) / max(m, 1)), r(pairs / max(m, 1)),
        r(1 - len(set(lines)) / max(len(lines), 1)), math.log1p(m / max(len(lines), 1)), float(-(p * np.log2(p)).sum()), r(upper / max(m, 1)), r(max(0, odd + m - clean) / max(m, 1)),
        r(title / max(m, 1)), r(int((lengths <= 2).sum()) / max(m, 1)), r(int((lengths >= 12).sum()) / max(m, 1)),
    ])


def _vectors(column: pa.Array) -> pa.Array:
    values = np.array([measure(x) for x in column.to_pylist()], np.float64).reshape(-1, len(NAMES))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(NAMES), pa.int32()), pa.array(values.ravel()))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row of (doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long"), binary("text").alias("text"))
    return map_arrow(plain, lambda b: {"doc_id": b.column(0), "x": _vectors(b.column(1))}, "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id"):
    """Rows that never teach: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """log-density difference + log prior odds: offset + |factor0 (x - mean0)|^2 / 2 - |factor1 (x - mean1)|^2 / 2."""

    means: np.ndarray
    #: Inverses of the Cholesky factors of both covariances, lower triangular.
    factors: np.ndarray
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + math.exp(-self.offset)))
        far = [(((x - m) @ f.T) ** 2).sum(1) / 2 for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.offset + far[0] - far[1], -60, 60)))


def discriminant(n: list[float], s: list[np.ndarray], q: list[np.ndarray], shrink: float = 0.5, ridge: float = 0.05) -> Model:
    """From counts, sums and sums of products of both classes. Covariance: (1 - shrink) of its own, shrink of the pooled
    one; then ridge of it becomes the diagonal. `shrink` grows for a class with few rows."""
    if min(n) < MIN_ROWS:
        share = (n[1] + 1) / (sum(n) + 2)
        return Model(np.zeros((0, 0)), np.zeros((0, 0, 0)), math.log(share / (1 - share)))
    means = np.array([a / k for a, k in zip(s, n, strict=True)])
    own = [b / k - np.outer(m, m) for b, k, m in zip(q, n, means, strict=True)]
    pooled = sum(k * c for k, c in zip(n, own, strict=True)) / sum(n)
    factors, logs = [], []
    for k, c in zip(n, own, strict=True):
        a = max(shrink, len(pooled) / (len(pooled) + k))
        c = (1 - a) * c + a * pooled
        c = (1 - ridge) * c + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logs.append(np.log(np.diag(low)).sum())
    return Model(means, np.array(factors), math.log(n[1] / n[0]) + logs[0] - logs[1])


def fit(vectors: DataFrame, labels: DataFrame) -> Model:
    """From (doc_id, x) and (doc_id, quality). Moments are summed over all labelled rows that teach."""
    taught = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y"))
    rows = vectors.join(taught.where(~held_out()), "doc_id").select("y", "x")
    d = len(NAMES)

    def sums(b: pa.RecordBatch) -> dict:
        y, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, d)
        ones = np.hstack([np.ones((len(x), 1)), x])
        both = np.array([ones[y == k].T @ ones[y == k] for k in (0, 1)]).ravel()
        return {"k": np.arange(len(both), dtype=np.int32), "v": both}

    got = np.zeros(2 * (d + 1) ** 2)
    for k, v in map_arrow(rows, sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[k] = v
    got = got.reshape(2, d + 1, d + 1)
    return discriminant([g[0, 0] for g in got], [g[0, 1:] for g in got], [g[1:, 1:] for g in got])


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, x); the higher the likelier is label 1."""
    d = len(NAMES)
    return map_arrow(vectors, lambda b: {"doc_id": b.column(0), "score": model.scores(b.column(1).flatten().to_numpy().reshape(-1, d))}, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: fitted on the labelled rows that aren't held out."""
    vectors = saved(statistics(docs))
    scored = score(vectors, fit(vectors, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs` that reach the threshold, with all their columns. Statistics are taken once to teach and
    once, beside the row itself, to judge: no text is shuffled."""
    from pyspark.sql.types import StructType

    model = fit(statistics(docs), labels)
    mark = free_name(docs, "bytes")

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([measure(t or b"") for t in b.column(mark).cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(NAMES))
        return b.filter(pa.array(model.scores(x) >= threshold)).drop_columns([mark])

    return map_arrow(docs.withColumn(mark, binary("text")), scored, StructType(docs.schema.fields))
