"""Timetable views over plain tables: stop times from events, stops from customers, requests from orders and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Route type of user_id modulo 5.
ROUTE_TYPES = (-1, 0, 2, 3, 4)


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, trip_id, k, t, seq, event_type, route_type): a trip is a user's day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    day = F.col("ts").cast("date")
    order = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    return events.select(
        "user_id", F.concat(F.col("user_id"), F.lit("@"), day.cast("string")).alias("trip_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("bigint").alias("t"),
        F.row_number().over(order).alias("seq"), "event_type",
        F.element_at(F.array(*map(F.lit, ROUTE_TYPES)), (F.col("user_id") % 5 + 1).cast("int")).alias("route_type"),
    )


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, stop_id, lat, lon): a stop for every customer, on a lattice ten wide that grows with the table."""
    at = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("int").alias("k"))
    return at.select(
        "k", F.concat(F.lit("ST"), F.expr("k div 4"), F.lit(":"), F.col("k") % 4).alias("stop_id"),
        (F.lit(46.5) + (F.col("k") % 10) * F.lit(0.0009)).alias("lat"), (F.lit(6.6) + F.expr("k div 10") * F.lit(0.0009)).alias("lon"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, from_k, to_k, departure): a request for every order between two stops."""
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 100).cast("int").alias("from_k"),
        (F.col("o_orderkey") * 7 % 100).cast("int").alias("to_k"), (F.lit(28800) + F.col("o_orderkey") % 8 * 1800).alias("departure"),
    )
    return made.where("from_k <> to_k")


def sources(asked: DataFrame) -> DataFrame:
    """(from_k, departure): what searches start from, each once however many requests share it."""
    return asked.select("from_k", "departure").distinct()


def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, from_k, to_k, departure): a request for every nation, for whole answers; every sixth leaves late at night."""
    n = F.col("n_nationkey")
    made = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        n.cast("long").alias("query_id"), (n * 4 % 100).cast("int").alias("from_k"), (n * 13 % 100 + 37).cast("int").alias("to"),
        F.when(n % 6 == 5, 86_280 + n).otherwise(28_800 + n % 8 * 1800).cast("long").alias("departure"),
    )
    return made.select("query_id", "from_k", (F.col("to") % 100).cast("int").alias("to_k"), "departure").where("from_k <> to_k")
