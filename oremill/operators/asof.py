"""As-of join: each row meets the value that was in force at its time, the last one of its key that is not later.

Both sides come down to one row a key and time first, by map-side aggregation, so that rows of one moment, however many, are
one row in what is sorted.  Times are cut into cells of a key; inside a cell a window carries the last value on, and a cell
whose first rows have none takes it from the cells before, of which only the last value of each is looked at.  Cells are
made narrower until none holds more than CELL_ROWS moments, so that a key with a third of all rows is sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 1 << 18
#: How much narrower the cells are made at a time.
NARROWER = 64
WIDEST = 1 << 62


def _cells(moments: DataFrame) -> int:
    """The width of cells, in microseconds, at which no cell holds more than CELL_ROWS moments."""
    span = moments.agg(F.max("__at") - F.min("__at")).first()[0] or 0
    width = min(WIDEST, span + 1)
    while width > 1:
        most = moments.groupBy("__key", F.floor(F.col("__at") / width)).count().agg(F.max("count")).first()[0] or 0
        if most <= CELL_ROWS:
            break
        width = max(1, width // NARROWER)
    return width


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str], keep, order: list[Column] | None = None, within: str | None = None) -> DataFrame:
    """`left` with `values` of the last row of `right` with equal `keys` and `since` <= `at`, and that row's `since`; null where there is none.

    Of right rows of one key and time the last by `order` counts (by their values, where none is given).  `within` is a
    number of days after which a value is no longer in force.  Null keys and times meet nothing.  `keep` writes a table and
    reads it back.  Columns of `left` that are named like a value are refused.
    """
    if clash := {since, *values} & set(left.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    key = F.struct(*[F.col(k) for k in keys])
    whole = lambda cols: " AND ".join(f"`{c}` IS NOT NULL" for c in cols)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    value = F.struct(F.col(since).alias("since"), *[F.col(c) for c in values])
    last = F.max_by(value, F.struct(*(order or [F.col(c) for c in values])))
    changes = right.filter(whole([*keys, since])).groupBy(key.alias("__key"), micros(since).alias("__at")).agg(last.alias("__value"))
    asked = left.filter(whole([*keys, at])).groupBy(key.alias("__key"), micros(at).alias("__at")).agg(F.lit(True).alias("__asked"))
    moments = keep(changes.withColumn("__asked", F.lit(None).cast("boolean")).unionByName(asked.withColumn("__value", F.lit(None).cast(changes.schema["__value"].dataType))).groupBy("__key", "__at").agg(F.first("__value", True).alias("__value"), F.bool_or("__asked").alias("__asked")))
    cell = F.floor(F.col("__at") / F.lit(_cells(moments)))
    dealt = moments.withColumn("__cell", cell)
    upto = Window.partitionBy("__key", "__cell").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.withColumn("__in", F.last("__value", True).over(upto)).filter("__asked")
    before = Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("__key", "__cell").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__at"))).alias("__end"))
    carried = ends.select("__key", "__cell", F.last("__end", True).over(before).alias("__carried"))
    found = inner.join(carried, ["__key", "__cell"]).withColumn("__met", F.coalesce("__in", "__carried"))
    if within is not None:
        limit = F.col("__at") - micros_of_days(within)
        found = found.withColumn("__met", F.when(F.unix_micros(F.col("__met.since").cast("timestamp")) >= limit, F.col("__met")))
    table = found.select(F.col("__key").alias("__k"), F.col("__at").alias("__t"), "__met")
    met = left.join(table, (key == F.col("__k")) & (micros(at) == F.col("__t")), "left")
    return met.select(*left.columns, F.col("__met.since").alias(since), *[F.col(f"__met.{c}").alias(c) for c in values])


def micros_of_days(days: str) -> Column:
    return F.lit(int(float(days) * 86_400_000_000))
