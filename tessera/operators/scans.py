"""Running values over the rows of a key, however many rows it has: inside ranges of rows first, then over the ranges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

PART = "__part"
#: Rows of a range, which one task orders.
RANGE_ROWS = 1_000_000


@dataclass
class Running:
    """A running value: kind (sum, max or min) of expr over the rows up to the row's own (`own`: included), or from it on."""

    kind: str
    expr: Column
    own: bool = True
    backward: bool = False


def in_ranges(rows: DataFrame, scratch: Scratch, keys: list[str], order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows, written in ranges of about range_rows by keys and order; the number of a row's range is in PART.

    Rows of equal order may stand in two ranges, so `order` has to tell the rows of a key apart.
    """
    parts = max(1, -(-rows.count() // range_rows))
    return scratch.keep(rows.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()), name)


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Whether columns are equal, nulls too."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in columns))


def with_running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Running]) -> DataFrame:
    """rows of `in_ranges` with running values by their names (null: no row there yet).

    Each range is ordered by a task of its own, and a row for each range and key meets those of the key's other ranges.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    local, totals = {}, []
    for name, v in values.items():
        by = Window.partitionBy(*keys, PART).orderBy(*[F.desc(c) if v.backward else F.asc(c) for c in order])
        local[name] = fold[v.kind](v.expr).over(by.rowsBetween(Window.unboundedPreceding, 0 if v.own else -1))
        totals.append(fold[v.kind](v.expr).alias(f"__all_{name}"))
    bases = rows.groupBy(*keys, PART).agg(*totals)
    before = []
    for name, v in values.items():
        by = Window.partitionBy(*keys).orderBy(F.desc(PART) if v.backward else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)
        before.append(fold[v.kind](f"__all_{name}").over(by).alias(f"__base_{name}"))
    bases = bases.select(*keys, PART, *before)
    found = rows.withColumns(local)
    joined = found.join(bases, same(found, bases, [*keys, PART])).drop(*[bases[c] for c in [*keys, PART]])
    merge = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest, "min": F.least}
    whole = {name: merge[v.kind](F.col(name), F.col(f"__base_{name}")) for name, v in values.items()}
    return joined.withColumns(whole).drop(*[f"__base_{n}" for n in values])


def rank_of(rows: DataFrame, probes: DataFrame, scratch: Scratch, keys: list[str], at: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """probes (keys, at, ...) with `rank`: how many rows (keys, at) of their key lie before `at`. A sorted search by ranges."""
    extra = [c for c in probes.columns if c not in (*keys, at)]
    told = probes.select(*keys, at, F.lit(0).alias("__kind"), F.struct(*extra).alias("__probe"))
    marks = rows.select(*keys, at, F.lit(1).alias("__kind"), F.lit(None).cast(told.schema["__probe"].dataType).alias("__probe"))
    # A probe stands before rows of its own time.
    both = told.union(marks).withColumn("__n", F.monotonically_increasing_id())
    order = [at, "__kind", "__n"]
    ranged = in_ranges(both, scratch, keys, order, name, range_rows)
    found = with_running(ranged, keys, order, {"rank": Running("sum", F.col("__kind"))})
    return found.where("__kind = 0").select(*keys, at, *[F.col(f"__probe.{c}").alias(c) for c in extra], F.col("rank").cast("long").alias("rank"))
