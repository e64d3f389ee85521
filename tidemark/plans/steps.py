"""Steps of iterated plans, written where driver and executors both see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.streaming.calibrators import shared_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again. The plan starts
    anew from the files, so a lost executor costs a re-read, and loops don't grow
    it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """The states of a loop: each is written, and the one two before it removed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_path(self.spark, self.name))
        df.write.parquet(self.paths[-1])
        if len(self.paths) > 2:
            self._remove(self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
