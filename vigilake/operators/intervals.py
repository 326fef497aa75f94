"""Which of nested intervals is innermost around a point: a sweep along each file, cut into slabs.

Rows that begin an interval and rows that are points go along one axis for each key. The axis is cut into slabs; an interval
stands in every slab that it reaches into, which is once more for each border that it crosses, so a file of any length is swept
by many tasks. Within a slab rows come sorted and a stack holds the open intervals: what is over is dropped, the top is the
innermost. A task holds no more than the stack, as deep as intervals nest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLAB = 20_000


def innermost(rows: DataFrame, key: str, told: list[str], slab: int = SLAB) -> DataFrame:
    """rows (key, at, last, ...): the points, where last is null, with `around`: the columns told of the interval at <= point <= last that begins last.

    Of intervals that begin together the one that ends first is innermost. Points outside of all, or without place or key, have null. Equal
    points stay rows of their own; an interval without key or place, or that ends before it begins, holds nothing.
    """
    kind, names = StructType([rows.schema[c] for c in told]), rows.columns
    point = F.col("last").isNull()
    sound = point | (F.col(key).isNotNull() & (F.col("at") <= F.col("last")))
    number = lambda c: F.floor(c / slab)
    reach = F.when(point, F.array(F.coalesce(number(F.col("at")), F.lit(-1)))).otherwise(F.sequence(number(F.col("at")), number(F.col("last"))))
    parts = rows.where(F.coalesce(sound, F.lit(False))).withColumn("_slab", F.explode(reach))
    parts = parts.withColumns({"_from": F.when(point, F.col("at")).otherwise(F.greatest("at", F.col("_slab") * slab)), "_told": F.struct(*told)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, open_ = None, []
        for batch in batches:
            points, around = [], []
            here = zip(*(batch.column(c).to_pylist() for c in (key, "_slab", "at", "last", "_told")))
            for i, (name, slab_, at, last, what) in enumerate(here):
                if (name, slab_) != spot:
                    spot, open_ = (name, slab_), []
                while open_ and at is not None and open_[-1][0] < at:
                    open_.pop()
                if last is not None:
                    open_.append((last, what))
                else:
                    points.append(i)
                    around.append(open_[-1][1] if open_ and at is not None and name is not None else None)
            kept = batch.select(names).take(pa.array(points, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array(around, batch.schema.field("_told").type)], [*names, "around"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = parts.repartition(n, key, "_slab").sortWithinPartitions(key, "_slab", "_from", point, "at", F.desc("last"))
    return swept.mapInArrow(run, StructType([*rows.schema.fields, StructField("around", kind)]))
