"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent a single machine (``local[...]``) gets a temporary folder; on a cluster that is an error, as each
    executor would write to its own disk.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when Python ends
        pass


_roots: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder. The application's scratch folder goes when Python ends."""
    root = f"{shared_dir(spark)}/threadloom-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes the partitions of later steps."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0
