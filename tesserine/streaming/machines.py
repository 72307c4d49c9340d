"""The two machines over a stream, in the order of event time.

Events wait in state until the watermark has passed them, whatever batch they came in, and are then taken by
(ts, seq) with the results that come due before or at each, as in the batch fold; so the rows are those of the
batch fold for every order of arrival within the watermark's delay. A timer wakes a device at the earliest time at which
it has something to do, so idle devices finish too. Events later than the watermark are dropped by Spark, and
those without a time take no part, as in the folds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserine.operators import five_state, seven_state
from tesserine.operators.kinematics import FRAME_MS, GAIN, START_Y, STOP_Y

FIVE_ROWS = "at timestamp, kind string, name string, state string, next_state string"
SEVEN_ROWS = f"{FIVE_ROWS}, igniter boolean, circuit boolean, arg boolean, was_igniter boolean, was_circuit boolean"
#: Operators with timers and maps keep their state in this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_START = dt.datetime(1970, 1, 1)


def _time(micros: int) -> dt.datetime:
    return _START + dt.timedelta(microseconds=micros)


def _micros(at: dt.datetime) -> int:
    return (at - _START) // dt.timedelta(microseconds=1)


class Device(StatefulProcessor):
    """One device: its state, the events that wait, and the pending results in a map, by time and place among equals."""

    def __init__(self, machine: Callable, columns: tuple[str, ...], types: str, rows: list[str]) -> None:
        self.machine, self.columns, self.types, self.rows = machine, columns, types, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")
        self.alarm = handle.getValueState("alarm", "at long")
        self.waiting = handle.getListState("waiting", f"ts long, seq long, {self.types}")
        self.pending = handle.getMapState("pending", "at long, place int", "name string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState["state"],))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r["ts"], r["seq"], *(r[c] for c in self.columns)) for r in rows]
        if came:
            self.waiting.appendList(came)
            self._wake(min(r[0] for r in came), timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Everything up to the watermark, in order."""
        until = timerValues.getCurrentWatermarkInMs() * 1000
        now, later = self._take(until)
        entries = sorted((tuple(k), v[0]) for k, v in self.pending.iterator())
        machine = self.machine(*([self.state.get()[0]] if self.state.exists() else []), pending=[(_time(at), name) for (at, _), name in entries])
        out = []
        for r in now:
            out += machine.press(_time(r[0]), *r[2:])
        out += machine.due(_time(until))
        self.state.update((machine.state,))
        for k, _ in entries:
            self.pending.removeKey(k)
        for i, (at, name) in enumerate(machine.pending):
            self.pending.updateValue((_micros(at), i), (name,))
        nexts = later + [_micros(at) for at, _ in machine.pending]
        if nexts:
            self._wake(min(nexts), timerValues)
        return iter([Row(**dict(zip(["device_id", *self.rows], (key[0], _micros(r[0]), *r[1:]), strict=True))) for r in out])

    def _take(self, until: int) -> tuple[list[tuple], list[int]]:
        """The events that wait no longer, in order, and the times of the others; the alarm is off."""
        self.alarm.clear()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        later = [r for r in held if r[0] > until]
        if len(later) < len(held):
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        # null seq before all; equal events by their columns
        order = lambda r: (r[0], r[1] is not None, r[1] or 0, *((x is not None, x) for x in r[2:]))
        return sorted((r for r in held if r[0] <= until), key=order), [r[0] for r in later]

    def _wake(self, micros: int, timerValues) -> None:
        """A timer at the first millisecond by which the time is passed, unless an earlier one is set."""
        at = max(-(-micros // 1000), timerValues.getCurrentWatermarkInMs() + 1)
        if self.alarm.exists():
            was = self.alarm.get()[0]
            if was <= at:
                return
            self.handle.deleteTimer(was)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def close(self) -> None:
        pass


class Rocket(Device):
    """One device's motion: from a launch a frame each FRAME_MS of event time, until it stops or the machine leaves
    LAUNCHED. The timer of the next frame is set anew after each."""

    def __init__(self) -> None:
        super().__init__(None, ("button",), "button string", [])

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.motion = handle.getValueState("motion", "launches int, begun long, frame int, vel double, y double")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        now, later = self._take(until)
        state = self.state.get()[0] if self.state.exists() else "IDLE"
        launches, begun, frame, vel, y = tuple(self.motion.get()) if self.motion.exists() else (0, None, 0, 0.0, START_Y)
        out = []
        due = lambda: begun + (frame + 1) * FRAME_MS * 1000 if begun is not None and y >= STOP_Y else None
        for ts, _, *pressed in [*now, (until, None)]:
            while (at := due()) is not None and at <= ts:
                frame, vel = frame + 1, vel + GAIN
                y -= vel
                out.append(Row(device_id=key[0], launch_id=launches, frame=frame, t_ms=frame * FRAME_MS, vel=vel, y=y, flame_on=y >= STOP_Y, launched=True))
            if pressed:
                was, state = state, five_state.move(state, pressed[0])
                if (was == "LAUNCHED") != (state == "LAUNCHED"):
                    launches, begun, frame, vel, y = launches + (state == "LAUNCHED"), ts if state == "LAUNCHED" else None, 0, 0.0, START_Y
        self.state.update((state,))
        self.motion.update((launches, begun, frame, vel, y))
        nexts = later + [at for at in [due()] if at is not None]
        if nexts:
            self._wake(min(nexts), timerValues)
        return iter(out)


def _processed(events: DataFrame, device: Device, schema: str, late: str, initial: DataFrame | None) -> DataFrame:
    events.sparkSession.conf.set(*PROVIDER)
    timed = events.filter("ts IS NOT NULL").select("device_id", F.col("ts").cast("timestamp").alias("event_time"), "seq", *device.columns).withWatermark("event_time", late)
    slim = timed.withColumn("ts", F.unix_micros("event_time"))
    grouped = None if initial is None else initial.select("device_id", "state").groupBy("device_id")
    return slim.groupBy("device_id").transformWithState(device, schema, "append", "EventTime", initialState=grouped)


def _stream(events: DataFrame, machine: Callable, columns: tuple[str, ...], types: str, rows: str, late: str, initial: DataFrame | None) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in rows.split(",")]
    schema = f"device_id long, {rows.replace('at timestamp', 'at long', 1)}"
    out = _processed(events, Device(machine, columns, types, names), schema, late, initial)
    return out.withColumn("at", F.timestamp_micros("at"))


def five_state_stream(events: DataFrame, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """Streaming events(device_id, ts timestamp, seq, button) -> rows of the timed machine, appended. With `initial`
    (device_id, state: those of `five_state.final_state`, say) devices begin in the states of an earlier batch."""
    return _stream(events, five_state.Timed, ("button",), "button string", FIVE_ROWS, late, initial)


def seven_state_stream(events: DataFrame, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """Streaming events(device_id, ts timestamp, seq, input, arg) -> rows of the timed machine, appended. `initial`
    has device_id, state, igniter, circuit."""
    return _seven_rows(events, late, initial).drop("arg", "was_igniter", "was_circuit")


def _seven_rows(events: DataFrame, late: str, initial: DataFrame | None) -> DataFrame:
    coded = None if initial is None else initial.select("device_id", F.concat_ws("/", "state", F.col("igniter").cast("int"), F.col("circuit").cast("int")).alias("state"))
    return _stream(events, seven_state.Timed, ("input", "arg"), "input string, arg boolean", SEVEN_ROWS, late, coded)


def motion_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming events(device_id, ts timestamp, seq, button) -> the rows of `kinematics.motion` over the launches of
    `five_state.trajectory` (a press acts at once), appended as the watermark passes each frame's time."""
    schema = "device_id long, launch_id int, frame int, t_ms int, vel double, y double, flame_on boolean, launched boolean"
    return _processed(events, Rocket(), schema, late, None)


def five_log_stream(events: DataFrame, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """The log of the five-state machine's stream: `five_state.timed_log` without step."""
    return five_state.timed_log(five_state_stream(events, late, initial))


def seven_log_stream(events: DataFrame, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """The log of the seven-state machine's stream: `seven_state.timed_log` without step."""
    return seven_state.log_of_rows(_seven_rows(events, late, initial))
