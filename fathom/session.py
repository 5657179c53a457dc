"""Session helpers: a tuned SparkSession, the shared checkpoint folder and scratch paths."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every fathom job relies on. AQE re-plans joins and coalesces small shuffle
# partitions at run time and splits skewed join partitions; UTC keeps timestamp
# arithmetic identical on every executor.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "fathom", shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a SparkSession with the defaults above; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in settings.items():
        if not key.startswith("spark.driver") and not key.startswith("spark.executor"):
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf of an already running session
                pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``. Where nothing is
    configured a private folder is created for a local session only: executors of a cluster would each write
    their part to their own disk, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured and not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="fathom-ckpt-"))
    return sc.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    """The configured shared folder itself (``spark.checkpoint.dir``), stable across restarts.

    ``checkpoint_dir`` adds a per-application sub-folder; state that must survive a restart
    (a streaming query's progress) belongs directly under this root.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    return configured or checkpoint_dir(spark)


def reliable_checkpoint(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder; return it re-read.

    Used where later steps must see exactly the same rows as earlier ones (for example a slice
    id assigned after a sampled range partitioning). Like ``checkpoint()`` it cuts the lineage
    and survives executor loss, but the table is columnar and compressed, so each of the
    several readers that follow scans only the columns it needs. ``compression`` names another codec than the session's.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the table that ``reliable_checkpoint`` returned, before its scope ends; nothing may read it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/fathom-scratch/" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside the block the shuffle files of a query go when it ends, not when the driver collects its garbage.

    For chains of saved tables: each is read from its files, never from the shuffles that made it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for round-trip writes."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/fathom-scratch/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete on exit the scratch tables written inside the block (only those: every path is unique).

    Operators that need a written table return frames that read it, so use their results inside the block;
    without a scope the tables stay until the checkpoint folder is cleared.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
