"""Series of the tables at hand, resampled to a regular period, and a synthetic series with one event."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_values(events: DataFrame, min_events: int = 2) -> DataFrame:
    """(event_type, time, value, n, quality): mean value of each hour, good where at least ``min_events`` events are."""
    hours = events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n"))
    return hours.withColumn("quality", F.when(F.col("n") >= min_events, "good").otherwise("bad"))


def daily_quantity(lineitem: DataFrame) -> DataFrame:
    """(time, value): quantity shipped per day."""
    return lineitem.groupBy(F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("time")).agg(F.sum("l_quantity").alias("value"))


def daily_price(orders: DataFrame) -> DataFrame:
    """(time, value): total price ordered per day, to the cent."""
    return orders.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time")).agg(F.sum(F.col("o_totalprice").cast("decimal(18, 2)")).cast("double").alias("value"))


def ringing(spark: SparkSession, samples: int = 6000, strike: int = 2450, seed: int = 3) -> DataFrame:
    """(time, value, quality, ord): two hums with noise, a fading ring after a ``strike``, and what sensors do wrong.

    Every 997th value is lost and every 1009th is flagged as poor; the sample 31 is not there, and the sample 50 comes twice.
    Noise is a hash of place and seed, so rows are the same however they are made.
    """
    i = F.col("id")
    since = i - strike
    noise = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2001)) - 1000) / 10_000
    hum = F.sin(i * (2 * pi / 40)) + 0.3 * F.sin(i * (2 * pi / 11))
    ring = F.when(since.between(0, 399), 6 * F.exp(-since / 60) * F.sin(since * (2 * pi / 7))).otherwise(0)
    rows = spark.range(samples).filter("id <> 31").withColumn("ord", i)
    rows = rows.union(spark.range(50, 51).withColumn("ord", F.lit(samples).cast("long")))
    value = F.when(i % 997 != 996, F.when(F.col("ord") == samples, -77.0).otherwise(hum + ring + noise))
    at = F.expr("timestamp_ntz'2025-03-01 06:00:00' + make_dt_interval(0, 0, 0, id)")
    return rows.select(at.alias("time"), value.alias("value"), F.when(i % 1009 == 1008, "poor").otherwise("good").alias("quality"), "ord")
