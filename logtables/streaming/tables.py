"""Tables that grow by one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Micro-batches between two compactions of a state table.
EVERY = 10


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write the rows of one micro-batch; writing it again replaces them."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class StateTable:
    """What micro-batches have left behind, read at a cost that doesn't grow with their number.

    Each batch writes its changes. Every ``EVERY`` batches the newest rows of each key become
    a base, so a batch reads one base and fewer than ``EVERY`` changes. Which base that is
    follows from the batch's number, so nothing is listed. A batch that is repeated reads what
    it read before and replaces what it wrote. What no batch can ask for any more is deleted.

    ``keys`` are the columns of which only the latest batch's rows count; without them all
    rows count.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ()) -> None:
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.schema = f"{schema}, batch bigint"

    def _folder(self, kind: str, batch: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{batch}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, kind: str, batch: int) -> bool:
        path, files = self._folder(kind, batch)
        return files.exists(path)

    def folders(self, before: int) -> list[str]:
        """The folders that hold the state before a batch: a base at most, and few changes."""
        return self._since(before // EVERY * EVERY - 1, before)

    def _since(self, base: int, before: int) -> list[str]:
        wanted = [("base", base)] if base >= 0 else []
        wanted += [("changes", n) for n in range(base + 1, before)]
        return [f"{self.path}/{kind}/{n}" for kind, n in wanted if self._there(kind, n)]

    def read(self, before: int) -> DataFrame:
        """The rows that count before a batch, with the number ``batch`` of the one they are from."""
        return self._latest(self.folders(before))

    def _latest(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        if not self.keys:
            return rows
        newest = F.max("batch").over(Window.partitionBy(*self.keys))
        return rows.withColumn("_newest", newest).filter("batch = _newest").drop("_newest")

    def write(self, rows: DataFrame, batch: int) -> None:
        """The changes of a batch; every ``EVERY`` batches also the base for the next ones."""
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns if c != "batch"]
        changed = rows.select(*columns, F.lit(batch).cast("bigint").alias("batch"))
        changed.write.mode("overwrite").parquet(f"{self.path}/changes/{batch}")
        if (batch + 1) % EVERY:
            return
        # few large files, rows of a key together
        state = self._latest(self._since(batch - EVERY, batch + 1))
        state = state.repartition(*(self.keys or columns[:1]))
        state.write.mode("overwrite").parquet(f"{self.path}/base/{batch}")
        # The batch before this one may be asked for again, so the base before stays.
        gone = [("base", batch - 2 * EVERY)]
        gone += [("changes", n) for n in range(batch + 1 - 2 * EVERY, batch + 1 - EVERY)]
        for kind, n in gone:
            if n >= 0:
                path, files = self._folder(kind, n)
                files.delete(path, True)


def schema_of(df: DataFrame, *columns: str) -> str:
    """DDL of some columns."""
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)
