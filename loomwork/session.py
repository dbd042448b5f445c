"""Session defaults and the shared scratch folder.

Long lineages are cut with tables written to the folder that every executor can
reach (``spark.checkpoint.dir``).  A written table survives the loss of any
executor, is columnar and compressed, and its size is known to the optimizer.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def build_session(app: str = "loomwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution is on (coalescing, skew-join splitting, runtime
    broadcast), time zone is UTC and Arrow batches are kept small enough for
    long texts.  Anything in ``conf`` wins.
    """
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=base).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Only where that is unset and the
    master is local (tests, a laptop) a temporary folder of this machine is
    used; on a cluster an unset folder is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="loomwork-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return "file://" + _local_dirs[app]


def written(df: DataFrame, label: str, max_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back; ``max_rows`` bounds the rows of a file (0: no bound)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", max_rows).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwork_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again."""
    path = getattr(df, "_loomwork_path", None)
    if path:
        _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete every table this application wrote; earlier results become unreadable."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).delete(target, True)


def shipped(spark: SparkSession, value) -> Broadcast:
    """A broadcast of ``value`` as bytes that carry the classes of this package along, so that workers need no copy
    of it; read with ``pickle.loads(b.value)``.  Meant for values of a stated bound."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same schema."""
    return df.filter(F.lit(False))
