"""Intermediate tables that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir`` or, where the session names none, below its warehouse:
    both are shared by all executors."""
    above = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{above.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def exact_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of sides that are dealt alike as dealt, while its adaptive planner may still deal one side
    otherwise: aggregates and windows above then see part of a key's rows and give wrong results, from run to run. Without
    that assumption the rows are shuffled once more."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back, so that what comes after neither repeats nor depends on what
    came before. It stays until :func:`cleared`, as results are read lazily."""
    exact_unions(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete one table of :func:`materialised` that nothing will read again."""
    held = table.inputFiles()
    if held:
        files, where = file_system(table.sparkSession, held[0].rsplit("/", 1)[0])
        files.delete(where, True)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that holds a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def cleared(spark: SparkSession) -> None:
    """Delete the tables of this application, once no result that reads them is needed any more."""
    files, where = file_system(spark, shared_folder(spark))
    files.delete(where, True)
