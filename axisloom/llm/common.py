"""What the operators of this subpackage share: tables, shared folders, words, graph components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes that one Arrow batch holds at most, so that a worker's memory stays bounded.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a local one is made, on a local master only."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(folder)
        return folder.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="axisloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `saved` has written; nothing may read it any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:  # none of an empty table
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: it does so once their plans are collected as garbage."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()


def binary(column: str | Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("binary"), F.lit(b""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like `name` that `df` doesn't use."""
    name = f"__{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: they may not have it installed."""
    if (name := spark.sparkContext.applicationId) not in _shipped:
        _shipped.add(name)
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="axisloom-")  # of the driver, which serves the file as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/axisloom-{name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in (root / "axisloom").rglob("*.py"):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(path)


def bounded_batches(spark: SparkSession) -> None:
    """What every Python stage needs: the package on the executors, and small batches."""
    _ship(spark)
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


def trim() -> None:
    """Gives a worker's memory back to the system as a task ends; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str | StructType) -> DataFrame:
    """mapInArrow by small batches; `f` returns a batch, or its columns by name."""
    bounded_batches(df.sparkSession)
    fields = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                if isinstance(out, dict):
                    out = pa.record_batch([pa.array(out[x.name], x.type) if not isinstance(out[x.name], pa.Array) else out[x.name] for x in fields], schema=fields)
                yield out
        del batches
        trim()

    return df.mapInArrow(run, schema)




#: Every byte but a-z, 0-9 and those over 0x7F becomes a blank; A-Z becomes a-z.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def plain_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(PLAIN).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.lower().split()


def lookup(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of rows with a table of one row for each key, however many rows a key has.

    Keys of over a thousandth of the rows (and over 1000) are 1000 at most; their rows stay where they are and meet a
    broadcast of those few. All others are an ordinary join. `counts` is (key, n), where the rows of each key are known already.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    least = max(1000, left.count() // 1000)
    hot = saved(counts.where(F.col("n") >= least).select(key))
    if hot.isEmpty():
        return left.join(right, key)
    few = F.broadcast(hot)
    return left.join(F.broadcast(right.join(few, key, "left_semi")), key).unionByName(left.join(few, key, "left_anti").join(right, key))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): a row (node, component) for each node; component is its smallest node.

    Alternating large and small stars: each round is a few shuffles of the edges, and the number of rounds grows
    with the logarithm of the longest path. Rounds end in a written table. Loops and repeated edges don't matter.
    Hubs are looked up where their edges are, so that no task gets all neighbours of one.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = saved(edges.distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = saved(both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
        large = lookup(both, low.drop("n"), "a", low.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b"))
        large = saved(large.where("a <> b").distinct())
        down = saved(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
        small = lookup(large, down.drop("n"), "a", down.select("a", "n")).where("b <> low").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        old, edges = edges, saved(small.union(down.select("a", F.col("low").alias("b"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for t in (old, low, large, down):
            dropped(t)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
