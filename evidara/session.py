"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_WRITTEN: list[str] = []
#: Steps written between two collections of the driver's garbage.
GC_EVERY = 4


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and bench.py; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidara")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A local session that names none (tests, a laptop) gets a temporary folder; on a
    cluster that would be another folder on each machine, so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="evidara-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return "file://" + _OWN_DIR[0]


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate results that ``cut`` wrote after the first ``since`` ones; what reads them must be done."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it, ``cut`` writes for a while only: its folders go when the block ends, so write the result inside."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        sweep(spark, since)


def _sweep_at_exit(spark: SparkSession) -> None:
    try:
        sweep(spark)
    except Exception:  # the session has ended; a local folder goes with the process, a shared one with the job's folder
        pass


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    This ends the lineage like ``checkpoint()`` but computes the plan once, keeps
    the result columnar and gives the optimizer its true size. Losing an executor
    loses nothing: the files are not on it. They are deleted when the program ends,
    or at the end of a ``scratch`` block.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/evidara-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_sweep_at_exit, spark)
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    if len(_WRITTEN) % GC_EVERY == 0:
        # executors keep a shuffle's files until the driver has collected what stands for it
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Keys with copies that ``records`` may broadcast; beyond it all rows are grouped.
COPIES = 1_000_000
#: Columns too wide to shuffle for the sake of a few copies, besides arrays of numbers.
WIDE = ("text", "embedding")


def _is_wide(df: DataFrame) -> bool:
    return any(f.name in WIDE or f.dataType.simpleString() in ("array<float>", "array<double>") for f in df.schema)


def records(df: DataFrame, key: str, arrival: str = "loaded_at", few: bool = False) -> DataFrame:
    """One row per record: copies of a key collapse, arrival is the earliest.

    Copies differ at most in the arrival, so any of them may give the other
    columns. Rows without a key are no records and are dropped. Tables of texts or
    vectors are not shuffled for it: the keys that have copies are counted first, and
    if they are few (``COPIES``) only their rows are grouped. ``few`` says that ``df`` is
    a small rest of its table, for which counting first would cost more than it saves.
    """
    df = df.where(F.col(key).isNotNull())
    if few or not _is_wide(df):
        return _grouped(df, key, arrival)
    copies = cut(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "copies")
    n = copies.count()
    if n == 0:
        return df
    if n > COPIES:
        return _grouped(df, key, arrival)
    few = F.broadcast(copies)
    return df.join(few, key, "left_anti").unionByName(_grouped(df.join(few, key, "left_semi"), key, arrival)).select(*df.columns)


def _grouped(df: DataFrame, key: str, arrival: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, arrival)]
    aggs = [F.min(arrival).alias(arrival)] if arrival in df.columns else []
    if rest:
        aggs.append(F.any_value(F.struct(*[F.col(c) for c in rest])).alias("_rest"))
    if not aggs:
        return df.distinct()
    out = df.groupBy(key).agg(*aggs)
    return out.select(*[F.col(c) if c in (key, arrival) else F.col(f"_rest.{c}").alias(c) for c in df.columns])
