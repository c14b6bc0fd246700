"""Places and ranks over all rows, in which no task holds a group.

Rows are dealt by ranges of (group, value) and sorted inside their range. A row's place in the whole order is the number
of rows of earlier ranges plus its place in its own; its place in its group is that minus the place of the group's first
row. A group may span any number of ranges and a value any number of rows: a last sort key tells equal rows apart.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.session import written

#: Lookups of at most so many rows are broadcast; larger ones are joined by their key.
SMALL = 200_000

#: Rows of a block: what one window task holds of a group at most.
BLOCK = 1 << 16

#: Spark numbers the rows of a partition in the low 33 bits of monotonically_increasing_id().
LOCAL_BITS = 33


def by_key(rows: DataFrame, lookup: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """rows with the columns of lookup, at most one row a key, nulls equal; n: lookup's rows, counted when not given."""
    n = lookup.count() if n is None else n
    named = lookup.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in lookup.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    side = F.broadcast(named) if n <= SMALL else named
    joined = rows.join(side, on, "left") if keys else rows.crossJoin(side)  # without keys lookup has one row
    return joined.drop(*[f"__k{i}" for i in range(len(keys))])


def in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows as a written table with __place, their place from 0 in the whole order; equal rows keep the order of the input.

    The driver reads one count a range, no row.
    """
    tied = written(rows, "unsorted").withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie")]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    found = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", LOCAL_BITS)
    counts = sorted((r.part, r.n) for r in found.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = itertools.accumulate((n for _, n in counts), initial=0)
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "__part long, __before long")
    placed = by_key(found.withColumn("__part", part), offsets, ["__part"], len(counts))
    return placed.withColumn("__place", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))).drop("__part", "__before", "__at")


def ascending(*names: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names]


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`: the place from 1 in the group of columns `by` (nulls are one group), in the given order."""
    placed = in_order(rows, [*ascending(*by), *order])
    starts = written(placed.groupBy(*by).agg(F.min("__place").alias("__start")), "starts")
    return by_key(placed, starts, by).withColumn(name, F.col("__place") - F.col("__start") + 1).drop("__place", "__start")


def running(rows: DataFrame, by: list[str], order: list[Column], value: Column, fold, name: str) -> DataFrame:
    """rows with `name`: fold (F.sum or F.max) of value over the rows of their group up to and with them.

    Windows cover blocks of BLOCK places; what a block carries to the next is the same fold over one row a block.
    """
    placed = in_order(rows.withColumn("__v", value), [*ascending(*by), *order])
    placed = written(placed.withColumn("__block", F.floor(F.col("__place") / BLOCK)), "placed")
    upto = lambda at: Window.partitionBy(*by, *at[:-1]).orderBy(at[-1]).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("__in", fold("__v").over(upto(["__block", "__place"])))
    blocks = written(placed.groupBy(*by, "__block").agg(fold("__v").alias("__b")), "blocks")
    n = blocks.count()
    if n <= BLOCK:
        whole = blocks.withColumn("__carry", fold("__b").over(upto(["__block"])))
    else:
        whole = running(blocks.withColumnRenamed("__block", "__of"), by, ascending("__of"), F.col("__b"), fold, "__upto_of")
        whole = whole.select(*by, F.col("__of").alias("__block"), F.col("__upto_of").alias("__carry"))
    after = whole.select(*by, (F.col("__block") + 1).alias("__block"), "__carry")
    both = F.coalesce("__in", F.lit(0)) + F.coalesce("__carry", F.lit(0)) if fold is F.sum else F.greatest("__in", "__carry")
    return by_key(inside, after, [*by, "__block"], n).withColumn(name, both).drop("__v", "__in", "__carry", "__block", "__place")


def mean_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with `name`: the mean of the places that rows of the same group and value take.

    Equal rows are counted before they are shuffled, so ties cost one row a task and value.
    """
    counts = written(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c")), "tied")
    upto = running(counts, by, ascending(value), F.col("__c"), F.sum, "__upto")
    ranks = written(upto.select(*by, value, (F.col("__upto") - (F.col("__c") - 1) / 2).alias(name)), "ranks")
    return by_key(rows, ranks, [*by, value])
