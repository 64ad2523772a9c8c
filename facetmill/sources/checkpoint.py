"""Results that are read more than once, kept where every executor can read them again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, list[str]] = {}


def directory(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir`` (or has set as its checkpoint directory).

    Only where none is set, in a session of this machine alone, as in tests, a temporary folder, removed at the end.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import shutil
        import tempfile

        shared = tempfile.mkdtemp(prefix="facetmill-")
        atexit.register(shutil.rmtree, shared, True)
    context.setCheckpointDir(shared)
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder as a table, its lineage cut; a lost executor loses nothing.

    The table stays until ``release``: whoever reads the result may read it again.
    """
    spark = df.sparkSession
    path = f"{directory(spark)}/facetmill-{uuid.uuid4().hex}"
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that ``settled`` has written in this session; results built on them must not be read after it."""
    paths = _kept.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)
