"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where none is set, and only if all run on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/parley-{uuid.uuid4().hex}"


def stage(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, outlives executors and has known sizes."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from; a null id counts as learnt from never."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
