"""Streams of the machines against the batch folds, for events in any order of arrival."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserine.operators import five_state as five
from tesserine.operators import kinematics as kin
from tesserine.operators import seven_state as seven
from tesserine.schema import FIVE_BUTTONS
from tesserine.sinks import append_log
from tesserine.streaming.machines import five_log_stream, five_state_stream, motion_stream, seven_log_stream, seven_state_stream

T0 = dt.datetime(2024, 1, 1)
FIVE = "device_id long, ts timestamp, seq long, button string"
SEVEN = "device_id long, ts timestamp, seq long, input string, arg boolean"
NAMES = ("igniter", "test", "enable", "ready", "launch", "lp_cancel", "circuit", "full_reset")


def five_rows(n):
    return [(1 + i % 3, T0 + dt.timedelta(milliseconds=300 * i), i, FIVE_BUTTONS[(i * 7 + i // 5) % 6]) for i in range(n)]


def seven_rows(n):
    return [(1 + i % 3, T0 + dt.timedelta(milliseconds=700 * i), i, NAMES[(i * 5 + i // 7) % 8 if i % 4 else i // 4 % 5], i % 3 > 0) for i in range(n)]


class Feed:
    """Files of events, one a micro-batch, and a stream over them."""

    def __init__(self, spark, path, schema, make):
        self.spark, self.path, self.schema, self.make, self.n = spark, path, schema, make, 0

    def add(self, rows):
        self.n += 1
        folder = self.path / "in"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(folder))

    def pass_time(self, hours):
        """Events of another device move the watermark over all others."""
        for h in hours:
            self.add([(99, T0 + dt.timedelta(hours=h), 10**6 + h, *("enable", False)[: 1 if "button" in self.schema else 2])])

    def run(self):
        """Takes what is there, and stops; a later run goes on from the checkpoint."""
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        query = self.make(source).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    def found(self):
        return self.spark.read.parquet(str(self.path / "out")).filter("device_id < 99")


def rows_of(df):
    cols = ["device_id", "at", "kind", "name", "state", "next_state", *[c for c in ("igniter", "circuit") if c in df.columns]]
    return sorted(str((pd.Timestamp(r["at"]), *(r[c] for c in cols if c != "at"))) for r in df.select(*cols).collect())


@pytest.mark.parametrize(("rows", "schema", "batch", "make"), [(five_rows(150), FIVE, five.timed, five_state_stream), (seven_rows(150), SEVEN, seven.timed, seven_state_stream)], ids=["five", "seven"])
def test_shuffled_batches_equal_the_batch_fold(spark, tmp_path, rows, schema, batch, make):
    whole = batch(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    feed = Feed(spark, tmp_path, schema, make)
    order = np.random.default_rng(4).permutation(len(rows))
    for part in np.array_split(order, 4):
        feed.add([rows[i] for i in part])
    feed.add([(1, None, 7, *("launch", True)[: len(rows[0]) - 3])])  # an event without a time takes no part
    feed.pass_time([2, 3])
    feed.run()
    assert rows_of(feed.found()) == rows_of(whole)


def test_a_late_batch_is_put_in_order(spark, tmp_path):
    feed = Feed(spark, tmp_path, FIVE, five_state_stream)
    at = lambda s, name: (1, T0 + dt.timedelta(seconds=s), s, name)
    feed.add([at(0, "test"), at(20, "ready"), at(30, "launch")])
    feed.add([at(10, "enable")])
    feed.pass_time([1, 2])
    feed.run()
    last = feed.found().groupBy("device_id").agg(F.max_by("next_state", F.struct("at", F.col("kind") == "ack")).alias("s")).collect()
    assert [r["s"] for r in last] == ["LAUNCHED"]


def test_restart_between_press_and_result(spark, tmp_path):
    """The press is out, its result is pending in the checkpoint when the stream stops; the restarted stream gives it."""
    feed = Feed(spark, tmp_path, FIVE, lambda e: five_state_stream(e, late="0 seconds"))
    feed.add([(1, T0, 0, "test"), (99, T0 + dt.timedelta(milliseconds=100), 1, "enable")])
    feed.run()
    assert [r["kind"] for r in feed.found().collect()] == ["press"]
    feed.add([(1, T0 + dt.timedelta(seconds=9), 2, "enable")])
    feed.pass_time([2, 3])
    feed.run()
    whole = five.timed(spark.createDataFrame([(1, T0, 0, "test"), (1, T0 + dt.timedelta(seconds=9), 2, "enable")], FIVE).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert rows_of(feed.found()) == rows_of(whole)


def test_start_from_a_batch(spark, tmp_path):
    """A stream that begins in the final states of a batch gives what one fold over both would."""
    rows = seven_rows(60)
    early, rest = rows[:30], [(d, ts + dt.timedelta(hours=1), *more) for d, ts, *more in rows[30:]]
    ntz = lambda r: spark.createDataFrame(r, SEVEN).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    begun = seven.timed(ntz(early))
    ends = begun.groupBy("device_id").agg(F.max_by(F.struct("next_state", "igniter", "circuit"), "step").alias("s")).select("device_id", F.col("s.next_state").alias("state"), "s.igniter", "s.circuit")
    ends = spark.createDataFrame([tuple(r) for r in ends.collect()], "device_id long, state string, igniter boolean, circuit boolean")
    feed = Feed(spark, tmp_path, SEVEN, lambda e: seven_state_stream(e, initial=ends))
    feed.add(rest[::2])
    feed.add(rest[1::2])
    feed.pass_time([5, 6])
    feed.run()
    whole = seven.timed(ntz([*early, *rest]))
    assert sorted([*rows_of(begun), *rows_of(feed.found())]) == rows_of(whole)


@pytest.mark.parametrize(("rows", "schema", "batch", "make"), [(five_rows(90), FIVE, lambda e: five.timed_log(five.timed(e)), five_log_stream), (seven_rows(90), SEVEN, seven.timed_log, seven_log_stream)], ids=["five", "seven"])
def test_log_of_a_restarted_stream(spark, tmp_path, rows, schema, batch, make):
    """Two runs of the stream, and its last batch once more as after a crash: the log equals the batch log."""
    feed = Feed(spark, tmp_path, schema, make)

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        append_log(make(source), str(tmp_path / "log"), str(tmp_path / "cp"), once=True).awaitTermination()

    feed.add(rows[1::2])
    feed.add(rows[::2])
    run()
    feed.pass_time([2, 3])
    run()
    commits = tmp_path / "cp" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    (commits / str(last)).unlink()
    (commits / f".{last}.crc").unlink()
    run()
    key = lambda df: sorted(str((r["device_id"], pd.Timestamp(r["at"]), r["log_seq"], r["line"])) for r in df.filter("device_id < 99").collect())
    whole = batch(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert key(spark.read.parquet(str(tmp_path / "log"))) == key(whole)


def test_motion_frames(spark, tmp_path):
    """Launches that stop by themselves, by a cancel (one at the time of a frame) and at once; a restart between two
    frames of a launch. The stream gives the frames of the batch."""
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    sets = []
    for device, end in ((1, None), (2, 800), (3, 801), (4, 799), (5, 0), (6, 5000)):
        for i, name in enumerate(("test", "enable", "ready", "launch")):
            sets.append((device, ms(10 * device + i), i, name))
        if end is not None:
            sets.append((device, ms(10 * device + 3 + end), 9, "lpu_cancel"))
            for i, name in enumerate(("test", "enable", "ready", "launch")):
                sets.append((device, ms(20_000 + i), 20 + i, name))
    feed = Feed(spark, tmp_path, FIVE, lambda e: motion_stream(e, late="0 seconds"))
    early = [r for r in sets if r[1] < ms(400)]
    late = [r for r in sets if r[1] >= ms(400)]
    feed.add(early[::-1])
    feed.add([(99, ms(500), 0, "enable")])
    feed.run()
    some = feed.found().count()
    feed.add(late[::-1])
    feed.pass_time([1, 2])
    feed.run()
    whole = kin.motion(kin.launches(five.trajectory(spark.createDataFrame(sets, FIVE).withColumn("ts", F.col("ts").cast("timestamp_ntz")))))
    rows = lambda df: sorted(tuple(r[c] for c in whole.columns) for r in df.collect())
    got = rows(feed.found())
    assert got == rows(whole) and 0 < some < len(got)
    assert {max(r[2] for r in got if r[:2] == (d, 1)) for d in (1, 6)} == {43} and max(r[2] for r in got if r[0] == 2 and r[1] == 1) == 20
