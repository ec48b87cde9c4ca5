"""Scalar functions on the cases that the survey names."""

from pyspark.sql import functions as F

from railloom.functions import columns as C


def test_times(spark):
    rows = [("08:05", 29100), ("25:10:00", 90600), ("300", 300), ("x", None), (None, None), ("1:2:3:4", None)]
    got = spark.createDataFrame(rows, "s string, want int").withColumn("got", C.parse_time_seconds(F.col("s"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_station_keys_and_text(spark):
    got = spark.createDataFrame([("8501120:0:1",), (" X ",), ("",)], "s string").select(C.station_key(F.col("s")), C.normalize_text(F.lit(" Lausanne-Ours  2!"))).collect()
    assert [r[0] for r in got] == ["8501120", "X", ""] and got[0][1] == "lausanne ours 2"


def test_distances_and_walks(spark):
    m = C.haversine_m(F.lit(48.8566), F.lit(2.3522), F.lit(48.8570), F.lit(2.3530))
    row = spark.range(1).select(m.alias("m"), C.walk_seconds(m).alias("s"), C.walk_seconds(F.lit(0.0)).alias("least")).first()
    assert round(row.m, 2) == 73.51 and row.s == 52 and row.least == 30
