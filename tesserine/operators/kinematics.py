"""Rocket motion: a recurrence by frame, from each launch to its end or the next cancel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Start height, gain of speed a frame, frame time, height at which the motion stops.
START_Y, GAIN, FRAME_MS, STOP_Y = 220.0, 0.4, 40, -150.0
#: Frames after which every motion has stopped: the closed form 220 - 0.2 n (n + 1) < -150 holds from 43 on.
MOST_FRAMES = 43


def frames() -> Column:
    """array<struct<frame, vel, y>>: the recurrence in its own order of additions, up to the stop."""
    start = F.struct(F.lit(0.0).alias("v"), F.lit(START_Y).alias("y"), F.array().cast("array<struct<frame:int,vel:double,y:double>>").alias("out"))

    def advance(acc: Column, n: Column) -> Column:
        v = acc["v"] + GAIN
        y = acc["y"] - v
        row = F.struct(n.cast("int").alias("frame"), v.alias("vel"), y.alias("y"))
        moved = F.struct(v.alias("v"), y.alias("y"), F.concat(acc["out"], F.array(row)).alias("out"))
        return F.when(acc["y"] < STOP_Y, acc).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_FRAMES)), start, advance, lambda acc: acc["out"])


def launches(path: DataFrame) -> DataFrame:
    """Trajectory of the five-state machine -> device_id, launch_id (from 1), launch_ts, end_ts (the event
    that leaves LAUNCHED; null if none does)."""
    order = Window.partitionBy("device_id").orderBy("step")
    edges = path.filter((F.col("state") == "LAUNCHED") != (F.col("next_state") == "LAUNCHED"))
    pairs = edges.withColumn("end_ts", F.lead("ts").over(order)).filter("next_state = 'LAUNCHED'")
    return pairs.select("device_id", F.row_number().over(Window.partitionBy("device_id").orderBy("ts", "seq")).alias("launch_id"), F.col("ts").alias("launch_ts"), "end_ts")


def motion(started: DataFrame) -> DataFrame:
    """launches -> device_id, launch_id, frame, t_ms, vel, y, flame_on, launched: frames up to the end."""
    each = started.select("device_id", "launch_id", "launch_ts", "end_ts", F.explode(frames()).alias("f"))
    ms = F.col("f.frame") * FRAME_MS
    until = F.timestamp_diff("MILLISECOND", F.col("launch_ts"), F.col("end_ts"))
    kept = each.filter(F.col("end_ts").isNull() | (ms <= until))
    return kept.select("device_id", "launch_id", "f.frame", ms.alias("t_ms"), "f.vel", "f.y", (F.col("f.y") >= STOP_Y).alias("flame_on"), F.lit(True).alias("launched"))


def last_frames(moved: DataFrame) -> DataFrame:
    """motion() -> device_id, launch_id, frame, t_ms, vel, y, stopped: where each launch ends."""
    last = moved.groupBy("device_id", "launch_id").agg(F.max(F.struct("frame", "t_ms", "vel", "y")).alias("f"))
    return last.select("device_id", "launch_id", "f.*", (F.col("f.y") < STOP_Y).alias("stopped"))
