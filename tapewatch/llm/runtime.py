"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.session import configure, shared_folder

#: Words are separated by the six ASCII white-space characters only.
SPACE = r"[\x20\x09-\x0D]+"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, the shared folder, and this package on the Python path of the workers."""
    configure(spark)
    shared_folder(spark)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])
    # batches for Python end at either bound: one text may be as long as thousands of others
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str) -> Column:
    """The text, a null one as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def file_system(folder: str):
    """The file system of a shared folder and the path in it, for files that are not Spark's own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Tasks that merge the best rows of one group before the last step.
SPREAD = 32


def best_of_tasks(best: DataFrame, keys: list[str], order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each group with their ``rank``: first among the rows of some tasks, then among what those leave."""
    step = best.withColumn("_spread", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    for by in ([*keys, "_spread"], keys):
        step = step.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return step.drop("_spread")
