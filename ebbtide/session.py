"""Session settings and the shared folder for checkpoints and stage tables."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ARROW_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to Python at once: a batch is in memory up to four times, and a row may be a whole block.
ARROW_BYTES = 1 << 23

_local_roots: dict[str, str] = {}
_stage_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_watched: list[list[DataFrame]] = []


def build_session(app: str = "ebbtide", master: str | None = None, partitions: int | None = None):
    """A session with the settings the jobs rely on; cluster settings stay with spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Event times are UTC; day boundaries must not follow the machine's zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of `ARROW_BYTES`, or of less where the session says so."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > ARROW_BYTES:
        spark.conf.set(ARROW_BYTES_CONF, str(ARROW_BYTES))


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set: stage tables need a folder all executors can reach"
        )
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="ebbtide-")
    return _local_roots[app]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared checkpoint folder. Only local mode may fall back to /tmp."""
    root = _checkpoint_root(spark)
    return f"{root}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let `checkpoint()` work where the cluster has not set its folder already."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_checkpoint_root(spark))


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage by writing a stage table; survives the loss of executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    _stage_paths[stored] = path
    for made in _watched:
        made.append(stored)
    return stored


def release(stored: DataFrame) -> None:
    """Delete a stage table that nothing reads any more; `stored` is what `materialize` returned."""
    path = _stage_paths.pop(stored, None)
    if path:
        spark = stored.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(build: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """Materialize what `build` returns, and delete the stage tables that it made on the way: the result
    is stored and reads them no more."""
    made: list[DataFrame] = []
    _watched.append(made)
    try:
        result = build()
    finally:
        _watched[:] = [other for other in _watched if other is not made]
    stored = materialize(result, purpose)
    for table in made:
        release(table)
    return stored
