"""The learning fold: rows whose crc32(doc_id as text) mod 5 is not 0. doc_id decides the fold and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where the row is held out; a null doc_id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def smallest_hashes(rows: DataFrame, by: str, sizes: dict, most: int) -> DataFrame:
    """The `most` rows of each value of column `by` with the smallest hash of doc_id; sizes: the rows of each value.

    Hashes are evenly spread, so a bound on the hash leaves about 1.2 * most + 200 rows of a value, whatever its size, and
    `most` of them at least (short of chances below 1e-20); only these are sorted. Values not in sizes are left out.
    """
    h = F.xxhash64("doc_id")
    bounds = [(v, min(2**63 - 1, int(-(2**63) + (1.2 * most + 200) / n * 2**64))) for v, n in sizes.items() if n]
    kind = rows.schema[by].dataType.simpleString()
    small = rows.sparkSession.createDataFrame(bounds, f"`{by}` {kind}, __most long")  # a row a value, from the driver
    some = rows.join(F.broadcast(small), by).filter(h <= F.col("__most")).select(*rows.columns)
    order = Window.partitionBy(by).orderBy(h, "doc_id")
    return some.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most).drop("__r")
