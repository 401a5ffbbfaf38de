"""Joins that bring values to rows.

Sizes are left to Spark: its broadcast threshold and adaptive execution decide from measured sizes,
and split what a frequent key makes large. Where a key is known to hold so many rows that this is not
enough, ``frequent_keys`` lists such keys once and the joins deal their rows out by a salt.
``broadcast`` appears only where the number of rows is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.dates import lit_date

#: A key is frequent if it holds more than this part of an even share of a shuffle partition's rows.
HOT_SHARE = 0.25


def attach(base: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join frames that are unique on the keys onto a base that is unique on them."""
    return reduce(lambda left, part: left.join(part, list(keys), "left"), parts, base)


def frequent_keys(rows: DataFrame, keys: Sequence[str], hot_share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``hot_share`` of an even partition's rows, and the parts to deal them into.

    With P shuffle partitions no more than P / hot_share keys can be that frequent whatever the data,
    and the parts of all together are no more than twice that, so the list is collected: later uses
    read it and not the rows again. Rows with a missing key match nothing and are not counted.
    """
    spark, keys = rows.sparkSession, list(keys)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    counts = rows.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    heavy = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * partitions > F.col("_all") * hot_share)
    parts = F.ceil(F.col("_n") * partitions / F.col("_all")).cast("int")
    listed = heavy.select(*keys, parts.alias("_parts"))
    return spark.createDataFrame(listed.collect(), listed.schema)


def attach_one(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """Join ``side`` (unique on the keys) onto rows, which are planned once.

    Without ``hot`` this is the engine's join. ``hot`` are the keys of ``frequent_keys``: their rows
    are dealt out by a digest of the row over as many parts as an even share needs, and their side is
    repeated for each part; rows with a missing key are dealt out as well. All others have part 0.
    """
    keys = list(keys)
    if hot is None:
        return rows.join(side, keys, how)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.broadcast(hot)
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    parts = F.when(missing, partitions).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = rows.join(known, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = side.join(known, keys, "left").withColumn("_part", F.explode(every))
    added = [c for c in side.columns if c not in keys]
    return dealt.drop("_parts").join(repeated.drop("_parts"), [*keys, "_part"], how).select(*rows.columns, *added)


def with_group_value(df: DataFrame, keys: Sequence[str], value: Column, out: str, hot: DataFrame | None = None) -> DataFrame:
    """Every row with an aggregate of its key; rows with a missing key are dropped."""
    return attach_one(df, df.groupBy(*keys).agg(value.alias(out)), keys, "inner", hot)


def expand_validity(
    df: DataFrame, start: str, end: str, lo: str, hi: str, out: str
) -> DataFrame:
    """One row per day on which a half-open interval ``[start, end)`` is valid, within lo..hi."""
    first = F.greatest(F.col(start), lit_date(lo))
    last = F.least(F.date_sub(F.col(end), 1), lit_date(hi))
    # sequence counts downwards when last < first, so empty intervals go first.
    return df.where(first <= last).withColumn(out, F.explode(F.sequence(first, last)))


def tag_in_list(
    df: DataFrame, key: str, items: Sequence[str] | DataFrame, out: str, hot: DataFrame | None = None
) -> DataFrame:
    """1 where the key is listed, else 0.

    A Python list becomes a set test inside the scan stage. A frame (its first column holds the
    items) is made distinct and joined.
    """
    if isinstance(items, DataFrame):
        listed = items.select(F.col(items.columns[0]).alias(key)).distinct().withColumn(out, F.lit(1))
        return attach_one(df, listed, [key], hot=hot).withColumn(out, F.coalesce(F.col(out), F.lit(0)))
    return df.withColumn(out, F.when(F.col(key).isin(list(items)), 1).otherwise(0))


def lookup(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], cols: Sequence[str], hot: DataFrame | None = None
) -> DataFrame:
    """Columns of a dimension that is unique on the keys; rows with a missing key get nulls."""
    return attach_one(df, dim.select(*keys, *cols), keys, hot=hot)


def attach_last_entity(clients: DataFrame, last: DataFrame, features: DataFrame, key: str, entity: str) -> DataFrame:
    """Key -> its last entity -> features of that entity; the entity id is dropped."""
    base = clients.select(key).join(last.select(key, entity), key, "left")
    return attach_one(base, features, [entity]).drop(entity)


def onto_population(population: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """All keys of the population, with their features where they exist."""
    return population.select(key).join(features, key, "left")


def attach_labels(
    df: DataFrame, labels: DataFrame, key: str, default: int = 0, hot: DataFrame | None = None
) -> DataFrame:
    """Labels by name, ``default`` where a name has none."""
    names = [c for c in labels.columns if c != key]
    joined = attach_one(df, labels, [key], hot=hot)
    return joined.select(*df.columns, *[F.coalesce(F.col(n), F.lit(default)).alias(n) for n in names])


def attach_month_value(
    df: DataFrame, monthly: DataFrame, key: str, day: str, month: str, month_offset: int = 0
) -> DataFrame:
    """Value of the month end ``month_offset`` months from the row's own month."""
    rows = df.withColumn("_month", F.last_day(F.add_months(F.col(day), month_offset)))
    side = monthly.withColumnRenamed(month, "_month")
    return attach_one(rows, side, [key, "_month"]).drop("_month")
