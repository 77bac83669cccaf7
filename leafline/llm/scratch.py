"""Tables that cut lineage, in the folder which the cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []
_ATEXIT: list[bool] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    if not _ATEXIT:
        _ATEXIT.append(True)
        atexit.register(_remove_all, spark)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_all(spark: SparkSession) -> None:
    for path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before the interpreter  # noqa: BLE001
            continue


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
