"""Reading the parquet tables of an input folder, and the shared folder for cut lineage."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application, as a zip in the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    jvm, where = spark.sparkContext._jvm, f"{shared_dir(spark).rstrip('/')}/{root.name}-{uuid.uuid4().hex}.zip"
    path = jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(where)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` in ``folder``; columns are pruned by what the query selects."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one set here where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = os.path.join(os.getcwd(), "spark-warehouse", "shared")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        found = spark.sparkContext.getCheckpointDir() or found
    return found


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, factor: int = 3) -> DataFrame:
    """``df`` over enough tasks for costly work on each row: a table of few files or row groups is dealt out again.

    A large input has partitions enough and is left as it is, without a shuffle."""
    wanted = factor * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
