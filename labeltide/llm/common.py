"""Helpers shared by the training-data operators.

Intermediates that are read more than once are written as Parquet below the
folder that the session names in ``spark.checkpoint.dir`` (:class:`Stage`), so
they survive the loss of an executor; those that no result depends on are
removed again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltide.session import ensure_checkpoint_dir

#: What separates words in every operator here: space and the controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """A run's own folder of intermediate tables in the shared checkpoint folder."""

    #: All folders of this process, in the order of their making.
    made: list[Stage] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Stage.made.append(self)

    @classmethod
    def clear(cls, first: int) -> None:
        """Remove the folders made since there were ``first``: what was read from them must have been written elsewhere."""
        while len(cls.made) > first:
            cls.made.pop().drop("")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back, under the schema it had."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.base)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda that names a column expression evaluates it again for every
    element; binding it as the variable of a one-element ``transform`` does not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def open_store(uri: str):
    """(pyarrow file system, path) of a folder that the session names: a URI or a plain path.

    Hadoop writes local URIs with one slash; the driver and all executors must see the folder.
    """
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
