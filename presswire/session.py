"""Session settings every job of this package relies on."""

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. The UTC zone is needed for right results; the rest are
# what a large cluster wants and are harmless on a small one.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a batch sent to Python is bounded by its bytes too: 10,000 long texts are much
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_LOCAL_DIRS: dict[str, str] = {}  # scratch folders of local sessions that name none
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)  # scratch folders of the scope
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    # functions of this package travel with the tasks that use them
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: int = 8, name: str = "presswire") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        # no search of the Python stack for each expression: plans here have thousands
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and scratch tables.

    A cluster names it in ``spark.checkpoint.dir``; a temporary folder is only
    made where that is unset, as in local tests.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="presswire-")
    return _LOCAL_DIRS[app]


def cut_lineage(df):
    """Materialise a frame reliably, so a lost executor costs no recompute chain."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder in the cluster's shared place, removed when the session ends."""
    path = f"{shared_dir(spark)}/presswire-{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return path


def remove_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Folders of `scratch_path` that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """For work that leaves no frame behind: scratch tables made inside, told in the list,
    are removed at its end, and shuffle files at the end of each action."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        with shuffles_removed(spark):
            yield made
    finally:
        _MADE.reset(token)
        remove_scratch(spark, made)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of the action that made them, not when the driver happens
    to collect its garbage."""
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)


def written(df: DataFrame, kind: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Cut lineage with a table in the shared folder. Other than on a checkpoint, later
    reads take only the columns and rows they ask for, and of the folders of `by` only theirs."""
    path = scratch_path(df.sparkSession, kind)
    df.write.option("compression", compression).partitionBy(*([by] if by else [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
