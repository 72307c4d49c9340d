import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tesserine import catalog
from tesserine.operators import five_state as five
from tesserine.operators import kinematics as kin
from tesserine.operators import scan
from tesserine.operators import seven_state as seven
from tesserine.schema import FIVE_BUTTONS, FIVE_STATES
from tesserine.streaming.machines import five_state_stream, seven_state_stream

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows, cols="device_id long, ts timestamp_ntz, seq long, button string"):
    return spark.createDataFrame([(1, T0 + dt.timedelta(milliseconds=ms), i, *rest) for i, (ms, *rest) in enumerate(rows)], cols)


# The expected transitions, texts, colours and delays below are those of the behaviour that is rebuilt.


def test_transition_map():
    moves = {(s, b): five.move(s, b) for s in FIVE_STATES for b in FIVE_BUTTONS}
    changed = {k: v for k, v in moves.items() if k[0] != v}
    assert len(moves) == 30 and len(changed) == 10
    assert changed == {
        ("IDLE", "test"): "CIRCUIT_TESTED", ("CIRCUIT_TESTED", "enable"): "ENABLED", ("ENABLED", "ready"): "READY", ("READY", "launch"): "LAUNCHED",
        ("CIRCUIT_TESTED", "lpu_cancel"): "IDLE", ("ENABLED", "lpu_cancel"): "IDLE", ("READY", "lpu_cancel"): "IDLE", ("LAUNCHED", "lpu_cancel"): "IDLE",
        ("ENABLED", "cu_cancel"): "IDLE", ("READY", "cu_cancel"): "IDLE",
    }


def test_full_run_and_log(spark):
    path = five.trajectory(events(spark, [(i * 5000, b) for i, b in enumerate(("test", "enable", "ready", "launch", "cu_cancel", "lpu_cancel"))]))
    assert [r["next_state"] for r in path.orderBy("step").collect()] == ["CIRCUIT_TESTED", "ENABLED", "READY", "LAUNCHED", "LAUNCHED", "IDLE"]
    log = five.event_log(path).orderBy("ts", "seq", "log_seq").collect()
    assert len(log) == 2 + 1 + 2 + 3 + 2 and log[0]["line"].startswith("[00:00:00] TEST button")


def timed(spark, rows):
    return [(r["kind"], r["name"], r["state"], r["next_state"]) for r in five.timed(events(spark, rows)).orderBy("step").collect()]


def test_timer_races(spark):
    # a second press while the first is pending starts a second timer; the first acknowledgement wins
    assert timed(spark, [(0, "test"), (100, "test")]) == [("press", "test", "IDLE", "IDLE"), ("press", "test", "IDLE", "IDLE"), ("ack", "test", "IDLE", "CIRCUIT_TESTED"), ("ack", "test", "CIRCUIT_TESTED", "CIRCUIT_TESTED")]
    # due exactly at a press: it comes first
    assert timed(spark, [(0, "test"), (600, "enable")])[-1] == ("press", "enable", "CIRCUIT_TESTED", "ENABLED")
    # a cancel doesn't stop a timer; re-armed within the delay, the stale acknowledgement fires early
    rows = [(0, "test"), (600, "enable"), (700, "ready"), (750, "cu_cancel"), (760, "test"), (1000, "enable"), (1370, "enable")]
    got = timed(spark, rows)
    assert ("ack", "ready", "IDLE", "IDLE") in got
    # cancel in IDLE does nothing to a pending test
    assert timed(spark, [(0, "test"), (10, "lpu_cancel")])[-1] == ("ack", "test", "IDLE", "CIRCUIT_TESTED")


def test_undeclared_transitions(spark):
    seen = [("IDLE", "CIRCUIT_TESTED", 3), ("READY", "IDLE", 1), ("IDLE", "LAUNCHED", 2), ("LAUNCHED", "READY", 1)]
    left = five.undeclared(spark.createDataFrame(seen, "state string, next_state string, n long")).collect()
    assert sorted(map(tuple, left)) == [("IDLE", "LAUNCHED", 2), ("LAUNCHED", "READY", 1)]


def test_transition_check_stops_at_an_undeclared_one(spark, monkeypatch):
    monkeypatch.setitem(five.FIVE_DECLARED, "IDLE", ())
    with pytest.raises(Exception, match="undeclared transition: IDLE to CIRCUIT_TESTED"):
        catalog.five_transition_check(spark, SF).collect()


def test_motion(spark):
    rows = [(i * 5000, b) for i, b in enumerate(("test", "enable", "ready", "launch"))]
    frames = kin.motion(kin.launches(five.trajectory(events(spark, rows)))).orderBy("frame").collect()
    assert len(frames) == 43 and frames[-1]["t_ms"] == 1720 and frames[-1]["y"] == -158.40000000000015 and not frames[-1]["flame_on"]
    assert all(a["vel"] < b["vel"] and a["y"] > b["y"] for a, b in zip(frames, frames[1:], strict=False))
    cut = kin.motion(kin.launches(five.trajectory(events(spark, [*rows, (15_000 + 100, "lpu_cancel")])))).collect()
    assert len(cut) == 2
    assert kin.motion(kin.launches(five.trajectory(events(spark, rows[:3])))).count() == 0


SEVEN = "device_id long, ts timestamp_ntz, seq long, input string, arg boolean"


def test_seven_rows():
    start = ("IDLE", False, True)
    assert seven.press(start, "igniter", None) == ("IDLE", True, True)
    assert seven.press(("READY", True, True), "igniter", None) == ("READY", True, True)
    assert seven.press(start, "circuit", False) == ("IDLE", False, False)
    assert seven.press(start, "test", None) == start
    assert seven.press(("IDLE", True, True), "test", None)[0] == "TESTING"
    assert seven.resolve(("TESTING", True, True), "test")[0] == "TEST_PASS"
    assert seven.resolve(("TESTING", True, False), "test") == ("IDLE", True, False)
    assert seven.press(("TEST_PASS", True, True), "enable", None)[0] == "ENABLED"
    assert seven.press(("ENABLED", True, True), "ready", None)[0] == "READY"
    assert seven.press(("READY", True, True), "launch", None)[0] == "LAUNCHING"
    assert seven.resolve(("LAUNCHING", True, True), "launch")[0] == "LAUNCHED"
    for s in ("TESTING", "TEST_PASS", "ENABLED", "READY"):
        assert seven.press((s, True, False), "lp_cancel", None) == seven.press((s, True, False), "cu_cancel", None) == start
    for s in ("IDLE", "LAUNCHING", "LAUNCHED"):
        assert seven.press((s, True, True), "lp_cancel", None) == (s, True, True)
        assert seven.press((s, True, False), "full_reset", None) == start
    assert seven.resolve(("IDLE", True, True), "test") == ("IDLE", True, True)


def test_seven_circuit_is_read_when_the_result_fires(spark):
    rows = [(0, "igniter", None), (10, "test", None), (500, "circuit", False)]
    out = seven.timed(events(spark, rows, SEVEN)).orderBy("step").collect()
    assert [(r["kind"], r["next_state"]) for r in out] == [("press", "IDLE"), ("press", "TESTING"), ("press", "TESTING"), ("result", "IDLE")]


def test_seven_log(spark):
    rows = [(0, "test", None), (1, "igniter", None), (2, "test", None), (3, "enable", None), (4, "circuit", False), (5, "cu_cancel", None)]
    log = seven.event_log(seven.trajectory(events(spark, rows, SEVEN))).orderBy("seq", "log_seq").collect()
    assert [r["level"] for r in log] == ["ERROR", "EVENT", *["EVENT", "EVENT", "STATE"] * 2, "EVENT", "EVENT", "STATE", "WARN", "WARN", "INFO", "STATE"]
    assert log[4]["msg"] == "Transition:  Idle  →  Testing Circuit" and log[0]["color"] == "#ff4455"


SEVEN_NAMES = ("igniter", "test", "enable", "ready", "launch", "lp_cancel", "circuit", "full_reset")
FIVE_ROWS = [(1 + i % 3, T0 + dt.timedelta(milliseconds=300 * i), i, FIVE_BUTTONS[(i * 7 + i // 5) % 6]) for i in range(120)]
SEVEN_ROWS = [(1 + i % 3, T0 + dt.timedelta(milliseconds=700 * i), i, SEVEN_NAMES[(i * 5 + i // 7) % 8 if i % 4 else i // 4 % 5], i % 3 > 0) for i in range(120)]


@pytest.mark.parametrize(
    ("rows", "names", "batch", "stream"),
    [(FIVE_ROWS, ["button"], five.timed, five_state_stream), (SEVEN_ROWS, ["input", "arg"], seven.timed, seven_state_stream)],
    ids=["five", "seven"],
)
def test_stream_equals_batch(spark, tmp_path, rows, names, batch, stream):
    columns = ["device_id", "ts", "seq", *names]
    kinds = ", ".join(f"{n} {'boolean' if n == 'arg' else 'string'}" for n in names)
    whole = batch(spark.createDataFrame(rows, f"device_id long, ts timestamp_ntz, seq long, {kinds}"))
    out = [c for c in whole.columns if c != "step"]
    key = lambda found: {tuple(str(r[c]) for c in out) for r in found}
    for k in range(3):
        part = spark.createDataFrame(pd.DataFrame(rows[k * 40 : k * 40 + 40], columns=columns)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    for h in range(2):  # another device's events move the watermark, so what is pending is flushed
        late = (9, T0 + dt.timedelta(hours=2 + h), 1000 + h, "enable", False)[: len(columns)]
        spark.createDataFrame(pd.DataFrame([late], columns=columns)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"out_{names[0]}"
    query = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert key(spark.sql(f"SELECT * FROM {name} WHERE device_id < 9").collect()) == key(whole.collect())


def test_timed_log_repeats_presses_and_drops_stale_results(spark):
    log = five.timed_log(five.timed(events(spark, [(0, "test"), (100, "test"), (2000, "lpu_cancel"), (2100, "ready")]))).orderBy("step", "log_seq").collect()
    assert [r["msg"] for r in log] == [five.MESSAGES["test"][0], five.MESSAGES["test"][0], five.MESSAGES["test"][1], *five.MESSAGES["lpu_cancel"]]
    rows = [(0, "igniter", None), (10, "test", None), (20, "test", None), (500, "lp_cancel", None)]
    log = seven.timed_log(events(spark, rows, SEVEN)).orderBy("step", "log_seq").collect()
    assert [r["level"] for r in log] == ["EVENT", "EVENT", "EVENT", "STATE", "WARN", "WARN", "STATE"]
    start = seven.start_log(events(spark, rows, SEVEN)).collect()
    assert [r["line"][10:] for r in start] == ["  " + seven.START_LOG[1]]


def many_presses(spark, names, arg=False):
    """Runs without a gap, gaps, and gaps of just the longest delays, on one device of many events and two of few."""
    rng, ms, rows = np.random.default_rng(3), 0, []
    for i in range(900):
        ms += int(rng.choice([90, 150, 400, 500, 600, 1400, 2200, 9000], p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]))
        name = names[int(rng.integers(len(names)))]
        extra = (bool(rng.integers(2)) if name == "circuit" else None,) if arg else ()
        rows.append((1 if i % 9 else 2 + i % 2, T0 + dt.timedelta(milliseconds=ms), i, name, *extra))
    kind = "input string, arg boolean" if arg else "button string"
    return spark.createDataFrame(rows, f"device_id long, ts timestamp_ntz, seq long, {kind}")


def one_fold(df, machine, cols):
    out = []
    rows = df.toPandas().astype(object).sort_values(["device_id", "ts", "seq"])
    for device, g in rows.groupby("device_id"):
        m = machine()
        made = [r for e in g[["ts", *cols]].itertuples(index=False, name=None) for r in m.press(*e)] + m.rest()
        out += [(device, i, *r) for i, r in enumerate(made, 1)]
    return sorted(map(str, out))


@pytest.fixture
def shuffle_partitions(spark, request):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("shuffle_partitions", ["1", "3", "16"], indirect=True)
def test_timed_ranges_give_the_rows_of_one_fold(spark, shuffle_partitions):
    key = lambda out: sorted(str((r["device_id"], r["step"], pd.Timestamp(r["at"]), *r[3:])) for r in out.collect())
    df = many_presses(spark, FIVE_BUTTONS[:4] * 3 + FIVE_BUTTONS)
    assert key(five.timed(df)) == one_fold(df, five.Timed, ["button"])
    df = many_presses(spark, ("igniter", "test", "enable", "ready", "launch") * 3 + ("lp_cancel", "circuit", "full_reset"), arg=True)
    assert key(seven._timed(df)) == one_fold(df, lambda: seven.Timed("IDLE/0/1"), ["input", "arg"])


def steps_of(df, machine, cols, start):
    """(device, seq, step, state before, state after) by one loop in order."""
    out, now, n = [], {}, {}
    for r in sorted(df.filter("ts IS NOT NULL").collect(), key=lambda r: (str(r["device_id"]), r["ts"], r["seq"])):
        d = r["device_id"]
        before = now.get(d, start)
        now[d], n[d] = machine(before, *(r[c] for c in cols)), n.get(d, 0) + 1
        out.append((d, r["seq"], n[d], before, now[d]))
    return sorted(out, key=str), sorted(((d, n[d], now[d]) for d in now), key=str)


@pytest.mark.parametrize("parts", ["1", "5", "16"])
def test_ranges_give_the_rows_of_one_fold(spark, parts):
    """A third of all events on one device, bursts at one time, a device that fills several ranges, null devices."""
    rng, rows = np.random.default_rng(int(parts)), []
    for i in range(1500):
        device = None if i % 50 == 0 else 3 if i % 3 == 0 else int(rng.integers(0, 30))
        rows.append((device, T0 + dt.timedelta(seconds=0 if i % 2 else i), i, FIVE_BUTTONS[(i * 7 + i // 5) % 6]))
    rows += [(3, None, 5000 + i, "test") for i in range(40)]
    df = spark.createDataFrame(rows, "device_id long, ts timestamp_ntz, seq long, button string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        sizes = [r["count"] for r in scan._ranges(df, ["button"]).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == int(parts) and max(sizes) < 3 * 1500 / int(parts)
        path, ends = steps_of(df, five.move, ["button"], "IDLE")
        assert sorted((tuple(r) for r in five.trajectory(df).select("device_id", "seq", "step", "state", "next_state").collect()), key=str) == path
        assert sorted((tuple(r) for r in five.final_state(df).collect()), key=str) == ends
        names = ("igniter", "test", "enable", "ready", "launch", "lp_cancel", "circuit", "full_reset")
        df = df.select("device_id", "ts", "seq", F.get(F.array(*map(F.lit, names)), F.pmod(F.xxhash64("seq"), F.lit(8)).cast("int")).alias("input"), (F.col("seq") % 3 > 0).alias("arg"))
        path, ends = steps_of(df, seven.step, ["input", "arg"], "IDLE/0/1")
        code = lambda x: F.concat_ws("/", f"{x}state", F.col(f"{x}igniter").cast("int"), F.col(f"{x}circuit").cast("int"))
        assert sorted((tuple(r) for r in seven.trajectory(df).select("device_id", "seq", "step", code(""), code("next_")).collect()), key=str) == path
        assert sorted((tuple(r) for r in seven.final_state(df).select("device_id", "n_events", code("")).collect()), key=str) == ends
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def timed_rows(out):
    return sorted(str((r["device_id"], r["step"], pd.Timestamp(r["at"]), *r[3:])) for r in out.collect())


@pytest.mark.parametrize("shuffle_partitions", ["8"], indirect=True)
@pytest.mark.parametrize("gap_ms", [100, 0], ids=["dense", "burst"])
def test_a_timed_device_without_a_gap_is_many_tasks(spark, shuffle_partitions, gap_ms):
    """An event each 100 ms, and all within one instant: never a time when nothing is pending, several ranges, the rows of one fold."""
    rng = np.random.default_rng(11)
    names = FIVE_BUTTONS[:4] * 3 + FIVE_BUTTONS
    rows = [(7, T0 + dt.timedelta(milliseconds=gap_ms * i), i, names[int(rng.integers(len(names)))]) for i in range(1200)]
    df = spark.createDataFrame(rows, "device_id long, ts timestamp_ntz, seq long, button string")
    out = five.timed(df)
    assert timed_rows(out) == one_fold(df, five.Timed, ["button"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or these few rows would be put together again
    try:
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = ("igniter", "test", "enable", "ready", "launch") * 3 + ("lp_cancel", "circuit", "full_reset")
    rows = [(2**60 + 1, *r[1:3], names[int(rng.integers(len(names)))], bool(rng.integers(2))) for r in rows]
    df = spark.createDataFrame(rows, SEVEN)
    assert timed_rows(seven._timed(df)) == one_fold(df, lambda: seven.Timed("IDLE/0/1"), ["input", "arg"])


def test_lanes_that_meet_keep_their_own_counts():
    """Each entry's exit and number of rows are those of a fold from it alone, also with results pending at the start."""
    entries = [*FIVE_STATES, "IDLE 100000 test 3", "ENABLED 250000 ready 1 300000 test 1", "READY 450000 launch 1"]
    rng, epoch = np.random.default_rng(5), dt.datetime(1970, 1, 1)
    presses = [(epoch + dt.timedelta(milliseconds=60 * i), FIVE_BUTTONS[int(rng.integers(6))]) for i in range(101)]
    lanes = scan._Lanes(entries, lambda code: scan._opened(five.Timed, code))
    for e in presses:
        lanes.press(*e)
    alone = []
    for code in entries:
        m = scan._opened(five.Timed, code)
        assert scan._coded(m) == code
        n = sum(len(m.press(*e)) for e in presses)
        alone.append((code, scan._coded(m), n))
    assert lanes.done() == alone and len(lanes.lanes) < len(entries) and len({n for *_, n in alone}) > 1


def test_timed_takes_no_events_and_null_devices(spark):
    none = events(spark, [(0, "test")]).limit(0)
    assert five.timed(none).count() == 0 and five.timed(none).columns == ["device_id", "step", "at", "kind", "name", "state", "next_state"]
    df = events(spark, [(0, "test"), (700, "enable")]).withColumn("device_id", F.lit(None).cast("long"))
    assert [(r["device_id"], r["next_state"]) for r in five.timed(df).orderBy("step").collect()] == [(None, "IDLE"), (None, "CIRCUIT_TESTED"), (None, "ENABLED")]


@pytest.mark.parametrize("shuffle_partitions", ["1", "4"], indirect=True)
def test_events_without_a_time_take_no_part(spark, shuffle_partitions):
    rows = [(0, "test"), (5000, "enable"), (9000, "ready")]
    df = events(spark, rows).union(spark.createDataFrame([(1, None, 9, "test"), (1, None, None, "lpu_cancel")], "device_id long, ts timestamp_ntz, seq long, button string"))
    assert five.timed(df).orderBy("step").collect() == five.timed(events(spark, rows)).orderBy("step").collect()
    assert [r["state"] for r in five.final_state(df).collect()] == ["READY"]
    assert five.trajectory(df).count() == 3 and scan.untimed(df).count() == 2
