"""Helpers shared by the text operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradewind import session
from tradewind.session import run_path

BATCH_ROWS = 256  # rows of one Arrow batch, so that a batch of long texts stays small


def by_value(module: str) -> None:
    """Ship the functions of `module` to executors by value, so that they need no copy of this package."""
    register_pickle_by_value(sys.modules[module])


by_value(__name__)


def worker_memory(name: str) -> dict:
    """A dictionary that lives as long as the Python process, also for functions that were shipped by value."""
    module = sys.modules.setdefault("_tradewind_worker_memory", types.ModuleType("_tradewind_worker_memory"))
    return vars(module).setdefault(name, {})


def tune(spark: SparkSession) -> SparkSession:
    session.tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps do not depend on any executor's memory."""
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column | str = "text") -> Column:
    """Digest of a text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(c, F.lit("")), 256))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that stand for (doc_id, text). Rows that repeat both share the key, and so their results."""
    doc = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(doc, F.lit("\n"), F.coalesce(F.col(text), F.lit("")))))


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def map_arrow(
    df: DataFrame, schema: str | T.StructType, fn: Callable[[dict[str, list]], dict[str, list]]
) -> DataFrame:
    """`fn` turns the columns of a batch into the columns of `schema`; Spark deals out the batches."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            columns = [c.cast(f.type) if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def numbers(column: pa.Array):
    return column.to_numpy(zero_copy_only=False)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
