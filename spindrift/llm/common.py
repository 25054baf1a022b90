"""Shared helpers of the training-data operators.

Nothing here collects rows of a corpus.  ``materialize`` writes a table under
the folder named by ``spark.checkpoint.dir`` so that iterative operators cut
their lineage in storage every executor shares.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: U+0020 and U+0009..U+000D.
ASCII_SPACE = "\x09\x0a\x0b\x0c\x0d\x20"
SPLIT_WORDS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors; a private one only when none is configured."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spindrift-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and return (the table read back, its path)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables written by ``materialize``."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
