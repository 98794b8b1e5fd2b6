"""Streams give what the same tables give at once."""

from pyspark.sql import functions as F

from terrace.operators import matching
from terrace.streaming import reviews


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def folder(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "ev"))
    return str(tmp_path / "ev")


def test_latest_decisions(spark, data, tmp_path):
    got = run(reviews.latest_decisions(reviews.events(spark, folder(spark, data, tmp_path), 1)), "latest", "complete")
    batch = spark.read.parquet(f"{data}/events.parquet").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    want = matching.latest(batch, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_sessions_and_state(spark, data, tmp_path):
    stream = reviews.events(spark, folder(spark, data, tmp_path))
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert run(reviews.windowed_counts(stream), "windows", "complete").agg(F.sum("n")).first()[0] == n
    assert 0 < run(reviews.sessions(stream), "sessions", "append").agg(F.sum("n")).first()[0] <= n
    status = run(reviews.item_status(stream), "status", "update")
    assert status.groupBy("user_id").agg(F.max("seen").alias("s")).agg(F.sum("s")).first()[0] == n


def test_reminders_expiry_and_repeated_answers(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(rows):
        """One run of the query over new events, (id, minute, user, kind); each run starts from the checkpoint."""
        made = spark.createDataFrame(rows, "event_id long, minute long, user_id long, event_type string")
        made = made.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, minute) AS ts", "user_id", "event_type", "0D AS value", "'' AS props")
        made.coalesce(1).write.mode("append").parquet(source)
        query = reviews.reminders(reviews.events(spark, source), wait_minutes=60, times=2, keep_minutes=300)
        query.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        found = spark.read.parquet(out).where("user_id < 9").selectExpr("user_id", "kind", "status", "n", "(unix_seconds(at) - unix_seconds(timestamp '2024-01-01')) div 60 AS minute").collect()
        return sorted(map(tuple, found))

    told = [(1, "status", "PENDING", 1, 0), (2, "status", "PENDING", 1, 5), (3, "status", "COMPLETE", 2, 20)]
    # the answer of item 3 comes before its first event
    assert run([(1, 0, 1, "view"), (2, 5, 2, "view"), (4, 20, 3, "purchase"), (3, 10, 3, "view")]) == told
    # the watermark goes to 65 - 10: no timer yet; item 2 is answered, twice, and only the first answer changes anything
    told = sorted([*told, (2, "status", "COMPLETE", 3, 40)])
    assert run([(5, 40, 2, "purchase"), (6, 30, 2, "purchase"), (7, 65, 9, "view")]) == told
    # minute 100 passes item 1's first timer
    told = sorted([*told, (1, "reminder", "PENDING", 1, 60)])
    assert run([(8, 110, 9, "view")]) == told
    # a repeated answer of a known item, and an event before the watermark: nothing new
    assert run([(9, 115, 2, "purchase"), (10, 1, 4, "view")]) == told
    told = sorted([*told, (1, "reminder", "PENDING", 2, 120), (1, "expired", "PENDING", 1, 180)])
    run([(11, 400, 9, "view"), (12, 130, 9, "view")])
    # the expiry's timer is set as the second reminder's fires, so it may take another batch
    assert run([(13, 401, 9, "view")]) == told
    # item 3 was forgotten at minute 320 and begins anew
    told = sorted([*told, (3, "status", "PENDING", 1, 405)])
    assert run([(14, 405, 3, "view")]) == told
