"""Numbers of rows within a key that many rows may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "n", bucket: Column | None = None) -> DataFrame:
    """df with numbers from 1 within the keys, by the order.

    bucket splits a key's rows: a value that grows with the order (a range of ids, an hour). Rows are then numbered within
    (keys, bucket) and the buckets' counts added up, so that no task sorts all rows of a hot key. Without it, one task does.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__m"))
    behind = F.sum("__m").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b"), F.coalesce(behind, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__bucket").eqNullSafe(F.col("__b"))]
    on = same[0]
    for more in same[1:]:
        on = on & more
    return rows.withColumn("__inner", inner).join(sizes, on).withColumn(name, (F.col("__before") + F.col("__inner")).cast("int")).select(*df.columns, name)
