"""Steps over all rows of a key, in as many tasks as the tables ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, tasks: int | None, *key: str) -> DataFrame:
    """df dealt out by key over so many tasks, which Spark does not merge again; without a number, df as it is.

    What is grouped or joined by the key afterwards stays in place. Left to
    itself Spark merges small parts until there are about as many as cores, and
    each of their tables in memory then grows with the input.
    """
    return df.repartition(tasks, *key) if tasks else df


def sides(tasks: int | None, key: list[str], *frames: DataFrame) -> DataFrame:
    """key and side, the sum of a bit for each of frames that has the key: 1 for the first, 2, 4 and so on. Nulls are equal.

    One number, and not a column a frame: steps that ask for different bits can
    share the exchange.
    """
    rows = reduce(DataFrame.unionByName, [f.select(*key, F.lit(1 << k).alias("side")) for k, f in enumerate(frames)])
    return by_key(rows, tasks, *key).groupBy(*key).agg(F.bit_or("side").alias("side"))
