"""Cutting lineage through storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    ``spark.checkpoint.dir`` names a folder all executors share. Only where it is unset, as in local tests,
    a temporary folder is made.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here:
        return here
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wavemill-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared folder and read back: later plans start from its files.

    Unlike ``checkpoint()`` the result carries no constraints of its former plan; in loops of joins these
    grow with every round until planning stands still. The files go when the session ends, or with ``drop_cut``.
    """
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``cut``, and the folder of its files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/wavemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path), path


def drop_cut(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``cut_at`` that nothing reads any more, so that a loop keeps no more than its last ones."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)
