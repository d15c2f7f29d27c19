"""Numbers within groups of any size: no task ever sorts a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralith.shared import written

#: Bits of a place within its partition, as monotonically_increasing_id has them.
PLACE_BITS = 33


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """``rows`` with their number from 1 within ``group`` by ``order``; both have no nulls, and rows alike in both are numbered either way.

    Rows are sorted by ranges of (group, order), so a large group spreads over many tasks, and
    written with their places. A group's rows in one range are counted; a running sum over those counts,
    one for each range that has the group, tells where each range's numbers begin.
    """
    ordered = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = written(ordered.withColumn("row_place", F.monotonically_increasing_id()), "numbered")
    return _shifted(placed, group, name).select(*rows.columns, name)


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "nth", own: str = "own") -> DataFrame:
    """``rows`` with the number from 1 of their values of ``order`` among those of their ``group``: rows alike in both share it, and ``own`` marks one of them.

    As ``numbered``, but places count different values. Rows alike are in one range, so
    numbers need neither the distinct values by themselves nor a join with them.
    """
    keys = [*group, *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = rows.schema.add("row_place", "long").add(own, "boolean")

    def place(batches):
        at, last = (TaskContext.get().partitionId() << PLACE_BITS) - 1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                values = batch.column(k)
                new[1:] |= _unlike(values[1:], values[:-1])
            new[0] = last is None or any(_unlike(batch.column(k)[:1], last.column(k))[0] for k in keys)
            places = at + np.cumsum(new)
            at, last = int(places[-1]), batch.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(new)], names=schema.names)

    return _shifted(written(ordered.mapInArrow(place, schema), "ranked"), group, name).select(*rows.columns, name, own)


def _unlike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where values differ; nulls are alike, and so are NaNs."""
    found = pc.not_equal(a, b)
    if pa.types.is_floating(a.type):
        found = pc.and_not(found, pc.and_(pc.is_nan(a), pc.is_nan(b)))
    if a.null_count or b.null_count:
        found = pc.coalesce(found, pc.xor(pc.is_null(a), pc.is_null(b)))
    return found.to_numpy(zero_copy_only=False)


def _shifted(placed: DataFrame, group: list[str], name: str) -> DataFrame:
    """Numbers within groups from places in sorted ranges. Shifts are written, so that they go to the tasks where they are few instead of all rows being shuffled."""
    placed = placed.withColumn("row_range", F.shiftright("row_place", PLACE_BITS))
    begins = placed.groupBy(*group, "row_range").agg(F.min("row_place").alias("first"), (F.max("row_place") - F.min("row_place") + 1).alias("n"))
    before = Window.partitionBy(*group).orderBy("row_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = begins.select(*group, "row_range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("row_shift"))
    return placed.join(written(shifts, "shifts"), [*group, "row_range"]).withColumn(name, F.col("row_place") + F.col("row_shift"))
