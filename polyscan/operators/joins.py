"""Joins that need more than a plain equality: by interval, as-of, with skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, seconds: float) -> DataFrame:
    """Pairs of equal keys whose times differ by at most `seconds`.

    Times fall into bins of that width; a left row meets three bins, so the shuffle is on (keys, bin) and a hot
    key is spread over its bins.
    """
    us = max(1, int(seconds * 1_000_000))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bin_of = lambda c: F.floor(micros(c) / us)
    a = left.withColumn("__bin", F.explode(F.array(*[bin_of(left_at) + k for k in (-1, 0, 1)])))
    b = right.withColumn("__bin", bin_of(right_at))
    joined = a.alias("l").join(b.alias("r"), [*[F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys], F.col("l.__bin") == F.col("r.__bin")])
    near = F.abs(F.unix_micros(F.col(f"l.{left_at}").cast("timestamp")) - F.unix_micros(F.col(f"r.{right_at}").cast("timestamp"))) <= us
    drop = {"__bin"}
    return joined.where(near).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}").alias(c if c not in left.columns else f"{c}_right") for c in right.columns if c not in drop and c not in keys])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: list[str]) -> DataFrame:
    """Each left row with `columns` of the latest right row of its keys that is not later; NULLs if there is none.

    One union, one shuffle, one pass in order: no pairs are made.
    """
    rest = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rest).alias("__row"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in columns], F.lit(None).cast("boolean").alias("__has"))
    kind = a.schema["__row"].dataType
    b = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(kind).alias("__row"), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__has"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("__has"), F.struct(*[F.col(f"__{c}").alias(c) for c in columns])), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("__seen", seen).where("__side = 1").select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest], *[F.col(f"__seen.{c}").alias(c) for c in columns])


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16) -> DataFrame:
    """An inner join whose hot keys of `left` are spread over `salts` tasks; right rows are repeated that often."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return a.join(b, [on, "__salt"]).drop("__salt")


def sized_broadcast(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if Spark's own estimate of its size is below the bound, else as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most_bytes else df


def keys_filter(small: DataFrame, key: str, most: int = 10_000) -> list | None:
    """The distinct keys of a small side for an IN filter on the other, or None if there are more than `most`."""
    found = [r[0] for r in small.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def deviation(value: Column, keys: list[str]) -> Column:
    """value minus the average of its group."""
    return value - F.avg(value).over(Window.partitionBy(*keys))
