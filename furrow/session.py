"""A local session with the settings the library is tested under, and tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a file of a written table holds at least, where the table's size is known.
FILE_BYTES = 8_000_000

#: The tables of the innermost ``scratch``, with whether they are kept.
_scope: ContextVar[list[tuple[str, bool]] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where the
    session leaves it unset (tests on one machine) a fresh temporary folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="furrow-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which ``clear`` removes."""
    return f"{shared_dir(spark)}/furrow/{spark.sparkContext.applicationId}"


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any file system that Spark reads; whether it was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application's operators have left. Results read them, so
    only call this when none is needed any more; it is called at the end of the program."""
    removed(spark, own_dir(spark))


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and spark.conf.get("spark.checkpoint.dir", ""):
        with contextlib.suppress(Exception):  # the JVM may be gone
            clear(spark)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end. Those stored with ``keep`` go with the scope
    around this one, or where there is none with ``clear``; after a failure they go at once."""
    outer, own = _scope.get(), []
    token, whole = _scope.set(own), False
    try:
        yield
        whole = True
    finally:
        _scope.reset(token)
        for path, keep in own:
            if not (whole and keep):
                removed(spark, path)
            elif outer is not None:
                outer.append((path, False))


def sized(df: DataFrame, size: int) -> DataFrame:
    """``df`` of about ``size`` bytes in partitions that aren't too small: many tiny files cost
    more than they hold. The number of partitions follows the bytes, and is never raised."""
    return df.coalesce(max(1, -(-size // FILE_BYTES)))


def stored(df: DataFrame, name: str, size: int | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back: this cuts the
    lineage, and losing an executor costs no recomputation of what lies before. ``size``: its
    bytes, if known; ``keep``: what an operator returns reads it, see ``scratch``."""
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append((path, keep))
    (df if size is None else sized(df, size)).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(name: str = "furrow", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
