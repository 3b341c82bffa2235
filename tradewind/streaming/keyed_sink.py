"""A table that a stream updates by key, written in proportion to what changes.

A batch writes its own rows beside the table and nothing else. Reading takes the newest row of each key: rows of the base that no
update replaces, and the last update of each updated key. When the updates have grown to a share of the base, base and updates
are folded into a new base; its files are sized by adaptive execution, so they grow in number with the table. Each row
is rewritten once for every such growth of the table, not once per batch.

A batch that runs again replaces its own files. A base counts once its success mark is there; a fold that fails leaves the base
before it in force. What a fold replaced is deleted by the fold after it, so a reader that had begun is not cut off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLD_SHARE = 0.25  # updates are folded once their bytes are this share of the base's
BATCH = "_batch"


class KeyedSink:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], fold_share: float = FOLD_SHARE):
        self.spark, self.path, self.keys, self.fold_share = spark, path.rstrip("/"), list(keys), fold_share
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished folders of one kind, ascending."""
        root = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(root):
            return []
        found = []
        for status in self._fs.listStatus(root):
            if self._fs.exists(self._path(status.getPath(), "_SUCCESS")):
                found.append(int(status.getPath().getName().split("=")[1]))
        return sorted(found)

    def _bytes(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def _base(self, number: int) -> str:
        return f"{self.path}/base/upto={number}"

    def _update(self, number: int) -> str:
        return f"{self.path}/updates/{BATCH}={number}"

    def state(self) -> tuple[int | None, list[int]]:
        """The base in force and the updates after it."""
        base = max(self._numbers("base"), default=None)
        return base, [n for n in self._numbers("updates") if base is None or n > base]

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Put the rows of a batch beside the table; fold if the updates have grown enough."""
        base, _ = self.state()
        if base is not None and batch_id <= base:
            return  # folded already; the batch ran again after that
        batch.write.mode("overwrite").parquet(self._update(batch_id))
        base, updates = self.state()
        waiting = sum(self._bytes(self._update(n)) for n in updates)
        if waiting >= self.fold_share * (self._bytes(self._base(base)) if base is not None else 0):
            self.fold(batch.schema)

    def read(self, schema: T.StructType) -> DataFrame:
        """The newest row of each key."""
        base, updates = self.state()
        columns = schema.names
        reader = self.spark.read.schema(schema)
        old = reader.parquet(self._base(base)) if base is not None else self.spark.createDataFrame([], schema)
        if not updates:
            return old
        dated = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())]))
        rows = dated.option("basePath", f"{self.path}/updates").parquet(*map(self._update, updates))
        rest = [c for c in columns if c not in self.keys]
        last = Window.partitionBy(*self.keys).orderBy(F.desc(BATCH), F.xxhash64(*rest) if rest else F.lit(0))
        new = rows.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").select(*columns)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        kept = old.alias("o").join(new.select(*self.keys).alias("n"), same, "left_anti")
        return kept.select(*columns).unionByName(new)

    def fold(self, schema: T.StructType) -> None:
        """One base of the base and all updates; what the last fold replaced is deleted."""
        base, updates = self.state()
        if not updates:
            return
        self.read(schema).hint("rebalance", *self.keys).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(self._base(updates[-1]))
        for number in self._numbers("base"):
            if base is not None and number < base:
                self._fs.delete(self._path(self._base(number)), True)
        for number in self._numbers("updates"):
            if base is not None and number <= base:
                self._fs.delete(self._path(self._update(number)), True)
