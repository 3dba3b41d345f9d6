"""Session helpers.

On a cluster the session is created by the platform and every setting below is
left alone (``getOrCreate`` returns the running session).  The defaults only
apply to a session this module creates itself, as in tests and the bench.
"""

from __future__ import annotations

import itertools
import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = "*", app: str = "trendlens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks, Spark UI off."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Lineage cuts and sink outputs of the registered queries go below it.  A
    folder of our own is made only when the setting is unset *and* the master
    is local (tests); on a cluster an unset setting is an error, because a
    machine-local folder is not visible to the other executors.
    """
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    ctx_dir = spark.sparkContext.getCheckpointDir()
    found = conf_dir or ctx_dir
    if found:
        if not ctx_dir:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. an object-store path)")
    own = tempfile.mkdtemp(prefix="trendlens-ckpt-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate writes:
    ``<spark.checkpoint.dir>/trendlens/<applicationId>``.  Everything the
    library writes on its own (report summaries, broadcast candidates, sink
    outputs of the registered queries) goes below it, so one folder can be
    dropped when the application is done."""
    return f"{shared_dir(spark)}/trendlens/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote on its own.  Frames that still
    read it (reports, sink outputs of the registered queries) end with it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{name}-{os.getpid()}-{next(_counter)}-{os.urandom(4).hex()}"


_counter = itertools.count(1)  # safe to share between threads, unlike a generator
