"""Streams run to their end, and the batch queries that they equal."""

from pyspark.sql import functions as F

from pointspark import fixtures as X
from pointspark.plans.graphs import moving_boxes
from pointspark.plans.registry import query
from pointspark.session import materialize
from pointspark.streaming import windows as S



@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    w = S.drained(S.tumbling(S.events(spark, d), "1 hour", "event_type"), "complete")
    return w.select(F.floor(F.unix_timestamp("start") / 3600).cast("bigint").alias("hour"), "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


@query("SELECT CAST(floor(epoch(ts) / 1800) AS BIGINT) - k AS slot, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1), (2), (3)) t(k) GROUP BY 1")
def stream_sliding(spark, d):
    w = S.drained(S.sliding(S.events(spark, d), "2 hours", "30 minutes"), "complete")
    return w.select(F.floor(F.unix_timestamp("start") / 1800).cast("bigint").alias("slot"), "n")


@query("WITH c AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 36000 THEN 0 ELSE 1 END AS cut FROM events), s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT user_id, CAST(floor(min(epoch(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, d):
    w = S.drained(S.sessions(S.events(spark, d), "10 hours", "user_id"), "complete")
    return w.select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, d):
    e = S.events(spark, d)
    return S.drained(S.distinct_events(e.select("event_id", "ts"), "event_id")).select("event_id")


def streamed(rows, label):
    """A table as a stream of the files it was written to, with the row that ends it."""
    table = materialize(S.ended(rows), label)
    return rows.sparkSession.readStream.schema(table.schema).parquet(table.written_path)


@query()
def stream_keyframes(spark, d):
    """Segment starts by event time; the tests hold them against a fold in order."""
    e = X.table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") / 10.0).alias("step"))
    return S.drained(S.stream_keyframes(streamed(e, "events")))


@query()
def stream_tracker(spark, d):
    """The boxes of every frame through the stateful tracker; the tests hold it against the batch fold."""
    boxes = moving_boxes(spark, d).withColumn("seq", F.col("seq").cast("bigint")).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1))
    return S.drained(S.stream_tracks(streamed(boxes, "boxes")))


@query()
def stream_superframes(spark, d):
    """The superframe of every frame, from points as a stream; the tests hold it against the batch plan."""
    p = X.points(spark, d).select(F.timestamp_seconds(F.col("frame") + 1).alias("ts"), "frame", "x", "y", "z", "intensity")
    poses = X.poses(spark, d).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1))
    return S.drained(S.stream_superframes(streamed(p, "points"), poses, 3, 2.0))
