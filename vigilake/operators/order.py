"""Places and running sums in an order, by a scan in two passes over ranges of a composite key.

Rows are dealt into ranges by (group, order, ties, digest of the row): Spark samples that key for its cuts, so there are
as many ranges as the session's shuffle partitions, a hot group or a constant order is cut like any other, and only rows equal in
every column stay together. Each range is sorted and summed up as it streams through its task, and written. The second pass
adds to a range what earlier ranges hold of the group that it begins with; that is one row for each range at most, which is
broadcast. The written table fixes the ranges: no task that runs again can cut them differently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, MapType, StructField, StructType

from .tables import settle


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range, sorted by group: _n, the place in the range and group, and _before, the sum of the values before it there."""
    last, n, total = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, value = (np.asarray(batch.column(c)) for c in ("_g1", "_g2", "_value"))
        fresh = np.ones(batch.num_rows, bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        fresh[0] = (one[0], two[0]) != last
        begins = np.maximum.accumulate(np.where(fresh, np.arange(batch.num_rows), -1))  # where the row's group begins, -1: in an earlier batch
        run = np.cumsum(value)
        earlier = np.where(begins >= 0, run[np.maximum(begins, 0)] - value[np.maximum(begins, 0)], 0)
        place = np.arange(batch.num_rows) - np.maximum(begins, 0) + 1 + np.where(begins < 0, n, 0)
        before = run - value - earlier + np.where(begins < 0, total, 0)
        last, n, total = (one[-1], two[-1]), int(place[-1]), before[-1] + value[-1]
        yield pa.record_batch([*batch.columns, pa.array(place, pa.int64()), pa.array(before.astype(value.dtype))], [*batch.schema.names, "_n", "_before"])


def scanned(rows: DataFrame, order: list[str], group: list[str], ties: list[str], value: Column | None = None) -> DataFrame:
    """rows with _place (from 1) and _sum, the sum of the values of the rows before, in each group. Nulls come last; null values count 0."""
    plain = [F.col(f.name) for f in rows.schema.fields if not isinstance(f.dataType, MapType)]
    kind = "double" if value is not None and rows.select(value.alias("v")).schema["v"].dataType.typeName() in ("double", "float", "decimal") else "long"
    parts = [F.struct(*group)] if group else [F.lit(0)]
    marked = rows.withColumns({"_g1": F.xxhash64(*parts), "_g2": F.xxhash64(F.lit(7), *parts), "_value": F.coalesce((F.lit(1) if value is None else value).cast(kind), F.lit(0).cast(kind)), "_digest": F.xxhash64(*plain)})
    keys = [F.col(c).asc_nulls_last() for c in [*group, "_g1", "_g2", *order, *ties, "_digest"]]
    kept = StructType([*marked.schema.fields, StructField("_n", LongType()), StructField("_before", DoubleType() if kind == "double" else LongType())])
    ranges = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_prefix, kept).withColumn("_range", F.spark_partition_id())
    whole = settle(ranges, "ranges")
    spot = ["_g1", "_g2", "_range"]
    tally = whole.groupBy(*spot).agg(F.count("*").alias("_rows"), F.sum("_value").alias("_total"))
    earlier = Window.partitionBy("_g1", "_g2").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select(*spot, F.sum("_rows").over(earlier).alias("_rows"), F.sum("_total").over(earlier).alias("_total")).where("_rows is not null")  # of a range only the group that it begins with
    met = whole.join(F.broadcast(bases), spot, "left")
    out = met.withColumns({"_place": F.col("_n") + F.coalesce("_rows", F.lit(0)), "_sum": F.col("_before") + F.coalesce("_total", F.lit(0).cast(kind))})
    return out.select(*rows.columns, "_place", "_sum")


def _list(x: str | list[str] | None) -> list[str]:
    return [x] if isinstance(x, str) else list(x or [])


def numbered(rows: DataFrame, order: str | list[str], name: str = "place", group: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """rows with their place (from 1) by one or more columns, in each group; rows with equal values by the columns in ties, then by a digest of the row."""
    return scanned(rows, _list(order), _list(group), _list(ties)).withColumn(name, F.col("_place")).drop(*{"_place", "_sum"} - {name})


def running_sum(rows: DataFrame, order: str | list[str], value: Column, name: str, group: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """rows with the sum of the values of the rows before each, in each group. Null values count 0."""
    return scanned(rows, _list(order), _list(group), _list(ties), value).withColumn(name, F.col("_sum")).drop("_place", "_sum")
