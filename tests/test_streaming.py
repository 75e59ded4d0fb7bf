"""Streams give what the tables give."""

from pyspark.sql import functions as F

from graphloom.sources import files
from graphloom.streaming import flows

SF = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_throttle_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = {r.event_id for r in run(flows.throttle_stream(stream, 6 * 3600, "user_id"), "throttled").collect()}
    assert got == {r.event_id for r in flows.throttle(events, 6 * 3600, ["user_id"], ["ts", "event_id"]).collect()}


def test_windows_close_by_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 2), ("2024-01-01 03:00:00", 3)], "ts string, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))
    out = run(flows.aligned_windows(stream, "1 hour", [], [F.sum("v").alias("v")], late="10 minutes"), "windows").collect()
    assert [(r.window_start.hour, r.v) for r in out] == [(0, 3)]


def test_upsert_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "k int, v string, seq int"
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 2)], [(2, "c", 3), (3, "d", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        flows.upsert_stream(stream, str(tmp_path / "out"), ["k"], ["seq"], str(tmp_path / "cp")).awaitTermination(120)
        state = {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out/v={i}").collect()}
    assert state == {(1, "a"), (2, "c"), (3, "d")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 'say "x"', 1), ("plain", None, 2)], "s string, q string, n int")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
