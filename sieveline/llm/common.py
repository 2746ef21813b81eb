"""What the corpus operators share: shared storage, Arrow batch sizes, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch that Python workers take in hand at once. Texts can be long, so it is far below Spark's default of 10,000.
ARROW_ROWS = 512
#: Paths written within each of the blocks of `intermediates` that are open.
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which all executors reach. Where it is unset, a temporary one, but only on a local master."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not where and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="sieveline-"))
        held = context._jsc.sc().getCheckpointDir()
    return where or held.get()


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. It is deleted when the block of `intermediates` around it ends, or else the driver."""
    path = f"{shared_dir(spark)}/sieveline/{label}-{uuid.uuid4().hex}"
    files, at = _filesystem(spark, path)
    files.deleteOnExit(at)
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end: nothing that is read later may depend on them."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            files, at = _filesystem(spark, path)
            files.delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_ROWS) -> Iterator[None]:
    """Within, a plan that is run sends at most `most` rows in an Arrow batch; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch], most: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most `most` rows, whatever size they come in (Spark bounds their bytes); nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage is cut, and a lost executor costs no recomputation."""
    path = path or shared_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What `make` returns, written; whatever tables it wrote on the way are deleted then."""
    path = shared_path(spark, label)
    with intermediates(spark), small_batches(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


#: Rows of some 50 bytes up to which the short side of a join is broadcast.
BROADCAST_ROWS = 200_000
SALTS = 16


def join_spread(many: DataFrame, few: DataFrame, key: str, spread: list[str], rows: int | None = None) -> DataFrame:
    """`many` left join `few` (one row per key) by `key`, which may be that of most rows of `many`.

    A short `few` is broadcast, after its rows are counted. Else `many` is dealt over salts hashed from the columns
    `spread`, and `few` is repeated for each salt, so that no key's rows meet in one task.
    """
    if few.count() <= (BROADCAST_ROWS if rows is None else rows):
        return many.join(F.broadcast(few), key, "left")
    repeated = few.withColumn("join_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = many.withColumn("join_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return salted.join(repeated, [key, "join_salt"], "left").drop("join_salt")
