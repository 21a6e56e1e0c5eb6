"""SparkSession helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library depends on for correctness (UTC wall clock) and for
# scale (AQE re-plans joins and partition counts from runtime sizes; an Arrow batch is
# bounded by its bytes, whatever the length of a row; a task scans a bounded part of a
# file, so that what it sorts does not grow with the input; the driver describes a plan
# anew after each stage, briefly, as that of a join of joins is long).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.ui.explainMode": "simple",
}


def get_spark(app: str = "shopstream", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (e.g. the driver's)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Where the setting is absent, a scratch folder is made only for a session
    whose driver and executors share one machine (``local[...]``, as in tests);
    on a cluster a machine-local folder would be invisible to the other
    executors, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shopstream-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (survives executor loss).

    Never ``localCheckpoint``: executor-local blocks die with the executor.
    """
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=eager)


# Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_table(df, name: str = "table"):
    """Write ``df`` as Parquet into the shared folder and read it back.

    Like ``cut_lineage`` but compressed and columnar, so that later branches read
    only the columns they use.  Column order and types are kept.  What was shuffled
    for the table leaves the disk once it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/shopstream-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


_STORED: dict[tuple, str] = {}  # tables of this application that were stored once, by their sources and the state of these


def source_state(spark, paths: list[str]) -> tuple:
    """(path, bytes, newest change, files) of tables: another load gives another state."""
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for path in paths:
        p = Path(path)
        fs = p.getFileSystem(conf)
        files = fs.listStatus(p)
        out.append((path, fs.getContentSummary(p).getLength(), max([f.getModificationTime() for f in files], default=0), len(files)))
    return tuple(out)


def stored_path(spark, name: str, sources: list[str], write) -> str:
    """Folder of a table derived from ``sources``, made by ``write(folder)`` once an application and state of the sources."""
    folder = checkpoint_dir(spark).rstrip("/")
    key = (spark.sparkContext.applicationId, folder, name, source_state(spark, sources))
    if key not in _STORED:
        path = f"{folder}/shopstream-{name}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored_once(spark, name: str, sources: list[str], build):
    """``build()`` as Parquet, written once an application and state of its sources, then only read."""
    path = stored_path(spark, name, sources, lambda folder: build().write.parquet(folder))
    return spark.read.parquet(path)
