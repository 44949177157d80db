"""Intermediate tables in the shared folder (``spark.checkpoint.dir``), dropped when no longer read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.session import new_output_path


class Scratch:
    """Written tables of one operator run.

    ``write`` stores a frame as Parquet under the shared folder and reads it
    back, so later plans start from committed files: a lost executor never
    recomputes what stands before, and values such as generated ids are fixed.
    On a clean exit the tables not marked ``keep`` are removed; those that the
    returned frame reads stay.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: list[str] = []
        self._path_of: dict[int, str] = {}

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        path = new_output_path(self.spark, name)
        df.write.parquet(path)
        if not keep:
            self._paths.append(path)
        frame = self.spark.read.schema(df.schema).parquet(path)
        self._path_of[id(frame)] = path
        return frame

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables, as ``write`` returned them, that nothing reads any more."""
        for frame in frames:
            path = self._path_of.pop(id(frame))
            self._paths.remove(path)
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            return
        for path in self._paths:
            self._delete(path)
