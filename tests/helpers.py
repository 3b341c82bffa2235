"""Small frames from plain rows. Money as text, timestamps as text; the schema casts them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F


def frame(spark, ddl: str, rows):
    """`ddl` uses the final types; every cell is given as text, number, bool or None."""
    names, kinds = zip(*[p.split(" ", 1) for p in ddl.replace(", ", ",").split(",")], strict=True)
    kinds = [k.replace("|", ",") for k in kinds]
    raw = spark.createDataFrame(
        [tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in rows],
        ", ".join(f"{n} string" for n in names),
    )
    return raw.select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


MONEY = "decimal(12|2)"


def rows(df, *keys):
    """Collected rows as tuples, decimals as floats, sorted by `keys` or by text."""
    out = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in df.collect()]
    if keys:
        at = [df.columns.index(k) for k in keys]
        return sorted(out, key=lambda r: [(r[i] is not None, r[i]) for i in at])
    return sorted(out, key=repr)
