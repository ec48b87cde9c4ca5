"""Raw timetable rows to stops, trips and stop times with dense keys.

Raw rows: stop_id, trip_id, arrival_time, stop_sequence and route_type as text, stop_lat, stop_lon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railloom.functions import columns as C
from railloom.workspace import Workspace

PRECEDENCE = ("arrival", "stop_id", "trip_id")


def good_rows(raw: DataFrame) -> DataFrame:
    """Rows with a stop, a trip, a readable time and a sequence number; the others are left out."""
    parsed = raw.withColumns({
        "arrival": C.parse_time_seconds(F.col("arrival_time")), "seq": F.trim("stop_sequence").try_cast("int"), "kind": C.route_type(F.col("route_type")),
        "lat": C.known(F.col("stop_lat")), "lon": C.known(F.col("stop_lon")),
    })
    parsed = parsed.where("stop_id IS NOT NULL AND trip_id IS NOT NULL AND arrival IS NOT NULL AND seq IS NOT NULL")
    return parsed.select("stop_id", "trip_id", "arrival", "seq", "kind", "lat", "lon")


def ranked(values: DataFrame, column: str, workspace: Workspace, name: str) -> DataFrame:
    """``values`` with idx, the place of each row in the order of ``column`` from 0.

    Rows are dealt out by range and numbered within their part; only the size of each part comes to
    the driver, so no task sees them all.
    """
    dealt = workspace.table(values.repartitionByRange(column).withColumn("part", F.spark_partition_id()), name)
    sizes = sorted(tuple(r) for r in dealt.groupBy("part").count().collect())
    firsts, at = [], 0
    for p, n in sizes:
        firsts.append((p, at))
        at += n
    firsts = values.sparkSession.createDataFrame(firsts, "part int, first long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return dealt.join(F.broadcast(firsts), "part").withColumn("idx", F.col("first") + nth - 1).drop("part", "first")


def dense_keys(rows: DataFrame, column: str, workspace: Workspace, name: str) -> DataFrame:
    """(column, idx): the distinct values numbered from 0 in order."""
    return ranked(rows.select(column).distinct(), column, workspace, name)


def quantiles(values: DataFrame, column: str, shares: Sequence[float], workspace: Workspace) -> list[float | None]:
    """Exact quantiles of a column, linear between neighbours; nulls do not count, and without values all are null."""
    some = values.select(column).where(F.col(column).isNotNull())
    n = some.count()
    if not n:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    wanted = {int(p) for p in places} | {min(n - 1, int(p) + 1) for p in places}
    at = {r.idx: r[column] for r in ranked(some, column, workspace, f"ranked_{column}").where(F.col("idx").isin(*wanted)).collect()}
    return [at[int(p)] + (at[min(n - 1, int(p) + 1)] - at[int(p)]) * (p - int(p)) for p in places]


def stop_table(good: DataFrame) -> DataFrame:
    """(stop_id, lat, lon): coordinates of the stop's first row that has both, null without."""
    order = F.struct(*PRECEDENCE, "seq")
    both = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(order.alias("o"), "lat", "lon"))
    return good.groupBy("stop_id").agg(F.min(both).alias("m")).select("stop_id", "m.lat", "m.lon")


def trip_table(good: DataFrame) -> DataFrame:
    """(trip_id, route_type): the first known route type of the trip's rows."""
    first = F.min(F.when(F.col("kind") != C.UNKNOWN_TYPE, F.struct("seq", "arrival", "stop_id", "kind")))
    return good.groupBy("trip_id").agg(first.alias("m")).select("trip_id", F.coalesce("m.kind", F.lit(C.UNKNOWN_TYPE)).alias("route_type"))


def with_coordinates(stops: DataFrame) -> DataFrame:
    """Stops whose place is known."""
    return stops.where(C.known(F.col("lat")).isNotNull() & C.known(F.col("lon")).isNotNull())


def clean_ids(ids: str) -> Column:
    """An array of ids trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))
