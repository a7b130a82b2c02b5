"""Session helper and the shared scratch folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_given: set[str] = set()


def get_session(app: str = "gridweft", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings this library relies on.

    Only semantic settings are fixed here (time zone, adaptive execution).  The number of shuffle
    partitions and all memory sizes belong to the cluster and are passed through ``conf``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only when the setting is absent and Spark runs in local mode (tests);
    on a cluster a missing setting is an error, because executors do not share local disks.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            root = sc._jsc.sc().getCheckpointDir().get()
        elif sc.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="gridweft-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Delete folders of ``scratch_path``, or of frames that ``materialize`` gave, once nothing reads them any more.

    Folders that this process was not given are refused.  Lost executors do no harm: what was made from the folder has been written before.
    """
    for one in written:
        path = one if isinstance(one, str) else one._scratch
        if path not in _given:
            raise ValueError(f"not a scratch folder: {path}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        _given.discard(path)
