"""The five-state launch machine: folds of button events by device, in batch.

`sync`: an acknowledgement follows its press at once. `timed`: it comes after a delay, is never cancelled,
and only counts if the machine is still in the state that waits for it; acknowledgements that are due
at the time of a press come first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators import scan
from tesserine.schema import DELAYS_FIVE_MS, FIVE_DECLARED, FIVE_STATES

# Button -> (states in which it acts, state that follows), acknowledgements included.
MOVES = {
    "test": (("IDLE",), "CIRCUIT_TESTED"),
    "enable": (("CIRCUIT_TESTED",), "ENABLED"),
    "ready": (("ENABLED",), "READY"),
    "launch": (("READY",), "LAUNCHED"),
    "lpu_cancel": (("CIRCUIT_TESTED", "ENABLED", "READY", "LAUNCHED"), "IDLE"),
    "cu_cancel": (("ENABLED", "READY"), "IDLE"),
}
# Log texts by button; those with an acknowledgement have its text after theirs.
MESSAGES = {
    "test": ("TEST button pressed → closing test circuit…", "✅ Test current detected — circuit OK"),
    "enable": ("ENABLE pressed → LP Enable Light ON, comms enabled",),
    "ready": ("READY button pressed → notifying launch pad…", "✅ Launch pad acknowledged READY — CU Ready Light ON"),
    "launch": ("LAUNCH button pressed → sending launch command…", "🔥 Launch acknowledged — closing igniter circuit!", "🚀 ROCKET LAUNCHED!"),
    "lpu_cancel": ("⛔ LPU CANCEL pressed — system reset to IDLE", "System reset to IDLE"),
    "cu_cancel": ("⛔ CU CANCEL pressed — system reset to IDLE", "System reset to IDLE"),
}


def step(state: Column, button: Column) -> Column:
    """The next state, as an expression."""
    out = F.when(F.lit(False), state)
    for name, (froms, to) in MOVES.items():
        out = out.when((button == name) & state.isin(*froms), F.lit(to))
    return out.otherwise(state)


def move(state: str, button: str) -> str:
    froms, to = MOVES.get(button, ((), state))
    return to if state in froms else state


def final_state(events: DataFrame) -> DataFrame:
    """events(device_id, ts, seq, button) -> device_id, n_events, state. Events without a time don't count."""
    return scan.final(events, FIVE_STATES, "IDLE", move, ["button"])


def trajectory(events: DataFrame) -> DataFrame:
    """One row an event that has a time: step, state before and after."""
    out = scan.trajectory(events, FIVE_STATES, "IDLE", move, ["button"])
    return out.withColumnsRenamed({"_before": "state", "_after": "next_state"})


def acts(button: str = "button") -> Column:
    """Whether a row of the trajectory did anything (and so wrote to the log)."""
    return F.exists(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(s).alias("s")) for b, (froms, _) in MOVES.items() for s in froms]), lambda x: (x["b"] == F.col(button)) & (x["s"] == F.col("state")))


def transitions(path: DataFrame) -> DataFrame:
    """Trajectory -> state, next_state, n: the changes of state, counted."""
    return path.filter("state <> next_state").groupBy("state", "next_state").agg(F.count(F.lit(1)).alias("n"))


def undeclared(seen: DataFrame) -> DataFrame:
    """The rows of transitions() that the declared adjacency doesn't have."""
    pairs = [(a, b) for a, to in FIVE_DECLARED.items() for b in to]
    declared = seen.sparkSession.createDataFrame(pairs, "state string, next_state string")
    return seen.join(F.broadcast(declared), ["state", "next_state"], "left_anti")


def adjacency(seen: DataFrame) -> DataFrame:
    """transitions() -> state, next_state, n, declared."""
    pairs = [(a, b) for a, to in FIVE_DECLARED.items() for b in to]
    declared = seen.sparkSession.createDataFrame(pairs, "state string, next_state string").withColumn("declared", F.lit(True))
    return seen.join(F.broadcast(declared), ["state", "next_state"], "left").withColumn("declared", F.coalesce("declared", F.lit(False)))


def event_log(path: DataFrame) -> DataFrame:
    """Trajectory -> device_id, ts, seq, log_seq, msg, line."""
    texts = F.create_map(*[x for b, m in MESSAGES.items() for x in (F.lit(b), F.array(*map(F.lit, m)))])
    rows = path.filter(acts()).select("device_id", "ts", "seq", F.posexplode(texts[F.col("button")]).alias("log_seq", "msg"))
    return rows.withColumn("line", F.concat(F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] "), "msg"))


def timed(events: DataFrame) -> DataFrame:
    """One row a press and one an acknowledgement that came due: kind, at, state before and after. Those
    still pending after the last press come at their times."""
    schema = "device_id long, step int, at timestamp_ntz, kind string, name string, state string, next_state string"
    return scan.timed(events, FIVE_STATES, "IDLE", Timed, ["button"], schema)


def timed_log(path: DataFrame) -> DataFrame:
    """Rows of timed(), or of its stream (which have no step) -> device_id, step, at, log_seq, msg, line. A press that acts logs its own text each time,
    pending acknowledgements or not; an acknowledgement that still counts logs what follows."""
    texts = lambda part: F.create_map(*[x for b, m in MESSAGES.items() for x in (F.lit(b), F.array(*map(F.lit, part(b, m))).cast("array<string>"))])[F.col("name")]
    pressed = F.when(acts("name"), texts(lambda b, m: m[:1] if b in DELAYS_FIVE_MS else m))
    acked = F.when(F.col("state") != F.col("next_state"), texts(lambda b, m: m[1:] if b in DELAYS_FIVE_MS else ()))
    keys = [c for c in ("device_id", "step", "at") if c in path.columns]
    rows = path.select(*keys, F.posexplode(F.when(F.col("kind") == "press", pressed).otherwise(acked)).alias("log_seq", "msg"))
    return rows.withColumn("line", F.concat(F.lit("["), F.date_format("at", "HH:mm:ss"), F.lit("] "), "msg"))


class Timed:
    """State of one device: the machine's, and a multiset of pending acknowledgements in order."""

    def __init__(self, state: str = "IDLE", pending: list | None = None) -> None:
        self.state, self.pending = state, pending or []

    def due(self, ts) -> list[tuple]:
        """Acknowledgements up to ts, in order of their times."""
        out = []
        while self.pending and (ts is None or self.pending[0][0] <= ts):
            at, name = self.pending.pop(0)
            before, self.state = self.state, move(self.state, name)
            out.append((at, "ack", name, before, self.state))
        return out

    def rest(self) -> list[tuple]:
        return self.due(None)

    def press(self, ts, button: str) -> list[tuple]:
        out = self.due(ts)
        before = self.state
        if move(before, button) != before:
            if button in DELAYS_FIVE_MS:
                self.pending.append((ts + dt.timedelta(milliseconds=DELAYS_FIVE_MS[button]), button))
                self.pending.sort(key=lambda p: p[0])
            else:
                self.state = move(before, button)
        out.append((ts, "press", button, before, self.state))
        return out


def lights(state: Column) -> list[Column]:
    """Four indicator lights: each stays on from one state to the end."""
    names = ("lpu_green", "lpu_red", "cu_red", "cu_green")
    return [state.isin(*FIVE_STATES[i + 1 :]).alias(n) for i, n in enumerate(names)]


def buttons(state: Column) -> list[Column]:
    """Which of the six buttons can be pressed."""
    return [state.isin(*froms).alias(f"can_{name}") for name, (froms, _) in MOVES.items()]


def label(state: Column) -> Column:
    return F.concat(F.lit("STATE:  "), state)
