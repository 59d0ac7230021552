"""The event catalogue as a view of the ``events`` table, and what every plan over it shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.functions import kernels
from tremora.functions.moments import epoch_day

FIRST_DAY = 19723.0  # 2024-01-01
STUDY_X, STUDY_Y, BUFFER = 600.0, 400.0, 300.0
AREA = 4 * STUDY_X * STUDY_Y


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_study(x: Column, y: Column) -> Column:
    return (F.abs(x) <= STUDY_X) & (F.abs(y) <= STUDY_Y)


def in_buffer(x: Column, y: Column) -> Column:
    dx, dy = F.greatest(F.abs(x) - STUDY_X, F.lit(0.0)), F.greatest(F.abs(y) - STUDY_Y, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy) <= BUFFER


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, origin_day, available_day, magnitude, x_km, y_km, the two domain flags and source. A narrow
    projection: Spark prunes what a plan does not use and pushes what it can to the scan."""
    e = table(spark, sf_dir, "events")
    origin = epoch_day(F.col("ts"))
    rows = e.select(
        "event_id", origin.alias("origin_day"),
        (origin + F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("available_day"),
        kernels.magnitude_bin(F.lit(2.95) + F.col("value") / 100).cast("double").alias("magnitude"),
        ((F.col("user_id") % 15) * 100 + F.pmod(F.col("event_id") * 37, F.lit(100)) - 750).cast("double").alias("x_km"),
        (F.floor(F.col("user_id") / 15.0) * 100 + F.pmod(F.col("event_id") * 53, F.lit(100)) - 500).cast("double").alias("y_km"),
        F.when(F.col("event_type").isin("error", "signup"), "m5").otherwise("m3").alias("source"),
    )
    return rows.withColumns({"inside_study_area": in_study(F.col("x_km"), F.col("y_km")), "inside_external_buffer": in_buffer(F.col("x_km"), F.col("y_km"))})


#: The same view for the SQL of the oracles.
CATALOG_SQL = """placed AS (
  SELECT event_id, epoch_us(ts) / 8.64e10 AS origin_day,
    epoch_us(ts) / 8.64e10 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS available_day,
    CAST(round(CAST(CAST(2.95 AS DOUBLE) + value / 100 AS DECIMAL(12,4)), 1) AS DOUBLE) AS magnitude,
    CAST((user_id % 15) * 100 + (event_id * 37 % 100) - 750 AS DOUBLE) AS x_km,
    CAST(floor(user_id / 15.0) * 100 + (event_id * 53 % 100) - 500 AS DOUBLE) AS y_km,
    CASE WHEN event_type IN ('error', 'signup') THEN 'm5' ELSE 'm3' END AS source
  FROM events),
catalog AS (
  SELECT *, abs(x_km) <= 600 AND abs(y_km) <= 400 AS inside_study_area,
    sqrt(pow(greatest(abs(x_km) - 600, 0), 2) + pow(greatest(abs(y_km) - 400, 0), 2)) <= 300 AS inside_external_buffer
  FROM placed)"""
