"""Where a stored table keeps its keys, so that a load opens only the partitions that may hold them.

Beside a date-partitioned table lies an index with one narrow row (key, date) per place in which a key was ever stored. Rows are
cut into buckets by blocks of neighbouring keys: keys given out in order, as a pull mostly brings, lie in few buckets, and scattered
keys still in no more than BUCKETS. A pull reads the buckets of its own keys, never the keys of the table.

The index only ever grows: a place is added before the table is written and stays after the key has moved on. So a run that
fails between the two leaves places too many, which cost a look, and never one too few, which would store a key twice.
`rebuild` forgets places that are no longer true.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.session import run_path
from tradewind.sources.tables import DATE_PARTITION

BUCKETS = 4096
BLOCK = 1 << 20  # whole-numbered keys of one block share a bucket


class KeyIndex:
    """The index of the table at `path`, keyed by `pk`; it lies beside the table, not inside it."""

    def __init__(self, spark: SparkSession, path: str, pk: Sequence[str]):
        self.spark, self.path, self.pk = spark, f"{path.rstrip('/')}-keys", list(pk)

    def bucket(self, like: DataFrame) -> Column:
        whole = [isinstance(like.schema[c].dataType, T.IntegralType) for c in self.pk]
        blocks = [F.floor(F.col(c) / BLOCK) if w else F.col(c) for c, w in zip(self.pk, whole, strict=True)]
        return F.pmod(F.xxhash64(*blocks), F.lit(BUCKETS)).cast("int").alias("bucket")

    def places(self, rows: DataFrame) -> DataFrame:
        """bucket, key and date of every row; `rows` has its date column."""
        return rows.select(*self.pk, DATE_PARTITION, self.bucket(rows))

    def stored(self, like: DataFrame) -> DataFrame | None:
        """The index as it is now, or None if there is none."""
        schema = T.StructType([like.schema[c] for c in self.pk] + [T.StructField(DATE_PARTITION, T.DateType()), T.StructField("bucket", T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def near(self, pull: DataFrame) -> DataFrame | None:
        """Places of the pull's keys: only the buckets of these keys are opened."""
        index = self.stored(pull)
        if index is None:
            return None
        buckets = [r[0] for r in pull.select(self.bucket(pull)).distinct().collect()]  # BUCKETS at most
        same = [F.col(f"i.{c}").eqNullSafe(F.col(f"p.{c}")) for c in self.pk]
        keys = pull.select(*self.pk).distinct().alias("p")
        return index.filter(F.col("bucket").isin(buckets)).alias("i").join(keys, same, "left_semi")

    def add(self, rows: DataFrame) -> None:
        """Note the places of `rows` that the index does not have yet."""
        new = self.places(rows).distinct()
        known = self.near(rows)
        if known is not None:
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*self.pk, DATE_PARTITION)]
            new = new.alias("n").join(known.alias("k"), same, "left_anti")
            if new.isEmpty():
                return
        self._write(new, self.path)

    def _write(self, places: DataFrame, path: str) -> None:
        places.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.pk).write.mode("append").partitionBy("bucket").parquet(path)

    def rebuild(self, table: DataFrame) -> None:
        """The index from the keys of the whole table: for a table that has none, or after many moves."""
        fresh = run_path(self.spark, "keys")
        self._write(self.places(table).distinct(), fresh)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(fs_path(self.path), True)
        schema = self.spark.read.parquet(fresh).schema
        self._write(self.spark.read.schema(schema).parquet(fresh), self.path)
