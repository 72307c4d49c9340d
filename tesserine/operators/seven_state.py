"""The seven-state launch machine with two environment flags: batch folds by device."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators import scan
from tesserine.schema import DELAYS_SEVEN_MS, SEVEN_STATES

# Display texts, banners (background, foreground, hint), log and lamp colours.
DISPLAY = {"IDLE": "Idle", "TESTING": "Testing Circuit", "TEST_PASS": "Test Passed", "ENABLED": "Launch Pad Enabled", "READY": "Ready to Launch", "LAUNCHING": "Launching", "LAUNCHED": "Launched!"}
BANNER = {
    "IDLE": ("#1e1e00", "#cccc44", "Connect igniter to begin"),
    "TESTING": ("#002200", "#44ff66", "Testing circuit…"),
    "TEST_PASS": ("#003300", "#00ff77", "Press ENABLE when ready"),
    "ENABLED": ("#330000", "#ff7777", "Walk to safe distance, then press READY"),
    "READY": ("#440000", "#ff4444", "Press LAUNCH to ignite"),
    "LAUNCHING": ("#550000", "#ff2222", "Ignition sequence in progress…"),
    "LAUNCHED": ("#003322", "#00ffaa", "SUCCESS"),
}
DEFAULT_BANNER = ("#111111", "#ffffff")
LEVEL_COLOR = {"INFO": "#00cc55", "WARN": "#ffaa00", "ERROR": "#ff4455", "EVENT": "#44aaff", "STATE": "#cc88ff"}
LAMP_COLOR = {"off": ("#1a1a1a", "#444444"), "green": ("#00ff55", "#004422"), "red": ("#ff3333", "#550000")}

# Lights, and the place of the first state (of five) from which each is on.
LIGHTS = {"lpu_green": 0, "lpu_red": 1, "cu_red": 2, "cu_green": 4}
CANCELLABLE = ("TESTING", "TEST_PASS", "ENABLED", "READY")
# Log rows. (input, condition on the row before, [(level, text)]); the first that holds counts.
# Conditions are SQL over state, igniter, circuit, arg.
_MOVE = "Transition:  {}  →  {}"
_RESET = ("STATE", "System reset to initial IDLE state.")


def _moved(a: str, b: str) -> tuple[str, str]:
    return "STATE", _MOVE.format(DISPLAY[a], DISPLAY[b])


_PASS = [("EVENT", "INPUT  EVENT: Test Button Pressed"), ("EVENT", "OUTPUT EVENT: Close Test Circuit — sending low-current pulse…"), _moved("IDLE", "TESTING")]
_RESTORED = ("INFO", "[SIM] Physical igniter circuit set to: intact")
LOG_RULES = [
    ("igniter", "state <> 'IDLE'", [("WARN", "Igniter change blocked — system is active.")]),
    ("igniter", "NOT igniter", [("EVENT", "Igniter wired to LPU connectors.  Circuit closed externally.")]),
    ("igniter", "igniter", [("EVENT", "Igniter disconnected from LPU.")]),
    ("circuit", "arg", [_RESTORED]),
    ("circuit", "NOT arg", [("WARN", "[SIM] Physical igniter circuit set to: BROKEN")]),
    ("test", "state <> 'IDLE'", [("WARN", "Test Button ignored — not in IDLE state.")]),
    ("test", "NOT igniter", [("ERROR", "Test Button Pressed — ERROR: igniter not connected.")]),
    ("test", "circuit", [*_PASS, ("EVENT", "INPUT  EVENT: Test Current Detected"), ("EVENT", "OUTPUT EVENT: Test Light On  (green light on LPU)"), _moved("TESTING", "TEST_PASS")]),
    ("test", "NOT circuit", [*_PASS, ("ERROR", "INPUT  EVENT: (no test current — circuit broken)"), ("ERROR", "Circuit check FAILED.  Check wiring and retry."), _moved("TESTING", "IDLE")]),
    ("enable", "state <> 'TEST_PASS'", [("WARN", "Enable Button ignored — circuit must be tested first.")]),
    ("enable", "TRUE", [("EVENT", "INPUT  EVENT: Enable Button Pressed"), ("EVENT", "OUTPUT EVENT: LP Enable Light On  (red light on LPU)"), _moved("TEST_PASS", "ENABLED")]),
    ("ready", "state <> 'ENABLED'", [("WARN", "Ready Button ignored — LPU must be enabled first.")]),
    ("ready", "TRUE", [("EVENT", "INPUT  EVENT: Ready Button Pressed  (CU)"), ("EVENT", "OUTPUT EVENT: CU Enable Light On  (red light on CU — link established)"), _moved("ENABLED", "READY")]),
    ("launch", "state <> 'READY'", [("WARN", "Launch Button ignored — not in READY state.")]),
    ("launch", "TRUE", [("EVENT", "INPUT  EVENT: Launch Button Pressed  (CU)"), ("EVENT", "OUTPUT EVENT: Close Igniter Connection — firing igniter circuit…"), _moved("READY", "LAUNCHING"), ("EVENT", "INPUT  EVENT: Launch Successful"), ("EVENT", "OUTPUT EVENT: Launch Light On  (green light on CU)"), _moved("LAUNCHING", "LAUNCHED")]),
    ("lp_cancel", "state IN ('IDLE', 'LAUNCHED', 'LAUNCHING')", [("WARN", "LP Cancel: nothing to abort in current state.")]),
    ("lp_cancel", "circuit", [("WARN", "INPUT EVENT: Launch Pad Cancel Pressed → resetting to IDLE."), _RESET]),
    ("lp_cancel", "NOT circuit", [("WARN", "INPUT EVENT: Launch Pad Cancel Pressed → resetting to IDLE."), _RESTORED, _RESET]),
    ("cu_cancel", "state IN ('IDLE', 'LAUNCHED', 'LAUNCHING')", [("WARN", "CU Cancel: nothing to abort in current state.")]),
    ("cu_cancel", "circuit", [("WARN", "INPUT EVENT: Control Unit Cancel Pressed → resetting to IDLE."), _RESET]),
    ("cu_cancel", "NOT circuit", [("WARN", "INPUT EVENT: Control Unit Cancel Pressed → resetting to IDLE."), _RESTORED, _RESET]),
    ("full_reset", "circuit", [_RESET]),
    ("full_reset", "NOT circuit", [_RESTORED, _RESET]),
]


# Fixed value: the log row of a machine that starts.
START_LOG = ("INFO", "System initialised.  Connect igniter to LPU to begin.")
#: With delays: what a press that waits logs at once, and what its result logs if it still counts.
_AT_ONCE = 3
_STILL = {"test": "state = 'TESTING'", "launch": "state = 'LAUNCHING'"}
TIMED_LOG_RULES = [("press", name, condition, texts[:_AT_ONCE]) for name, condition, texts in LOG_RULES]
TIMED_LOG_RULES += [("result", name, f"{_STILL[name]} AND {condition}", texts[_AT_ONCE:]) for name, condition, texts in LOG_RULES if len(texts) > _AT_ONCE]

Now = tuple[str, bool, bool]


def press(now: Now, name: str, arg: bool | None) -> Now:
    """What an input does at once; TESTING and LAUNCHING wait for `resolve`."""
    state, igniter, circuit = now
    match name:
        case "igniter" if state == "IDLE":
            return state, not igniter, circuit
        case "circuit":
            return state, igniter, bool(arg)
        case "test" if state == "IDLE" and igniter:
            return "TESTING", igniter, circuit
        case "enable" if state == "TEST_PASS":
            return "ENABLED", igniter, circuit
        case "ready" if state == "ENABLED":
            return "READY", igniter, circuit
        case "launch" if state == "READY":
            return "LAUNCHING", igniter, circuit
        case "lp_cancel" | "cu_cancel" if state in CANCELLABLE:
            return "IDLE", False, True
        case "full_reset":
            return "IDLE", False, True
    return now


def resolve(now: Now, name: str) -> Now:
    """The delayed result of a test (which reads the circuit then) or a launch."""
    state, igniter, circuit = now
    if name == "test" and state == "TESTING":
        return ("TEST_PASS" if circuit else "IDLE"), igniter, circuit
    if name == "launch" and state == "LAUNCHING":
        return "LAUNCHED", igniter, circuit
    return now


def _code(now: Now) -> str:
    return f"{now[0]}/{now[1]:d}/{now[2]:d}"


CONFIGURATIONS = tuple(_code((s, g, c)) for s in SEVEN_STATES for g in (False, True) for c in (False, True))
_DECODED = {_code((s, g, c)): (s, g, c) for s in SEVEN_STATES for g in (False, True) for c in (False, True)}


def step(code: str, name: str, arg: bool | None) -> str:
    """Press and result at once (sync mode), on coded configurations."""
    return _code(resolve(press(_DECODED[code], name, arg), name))


def _decoded(out: DataFrame, code: str, prefix: str = "") -> DataFrame:
    part = F.split(code, "/")
    return out.withColumn(f"{prefix}state", part[0]).withColumn(f"{prefix}igniter", part[1] == "1").withColumn(f"{prefix}circuit", part[2] == "1")


def trajectory(events: DataFrame) -> DataFrame:
    """events(device_id, ts, seq, input, arg) -> one row an event that has a time, with the state before and after;
    results follow their press at once (sync mode)."""
    out = scan.trajectory(events, CONFIGURATIONS, _code(("IDLE", False, True)), step, ["input", "arg"])
    return _decoded(_decoded(out, "_before"), "_after", "next_").drop("_before", "_after")


def timed(events: DataFrame) -> DataFrame:
    """As trajectory, with the delays: rows for presses and for results when they come due."""
    return _timed(events).drop("arg", "was_igniter", "was_circuit")


def _timed(events: DataFrame) -> DataFrame:
    schema = "device_id long, step int, at timestamp_ntz, kind string, name string, state string, next_state string, igniter boolean, circuit boolean, arg boolean, was_igniter boolean, was_circuit boolean"
    return scan.timed(events, CONFIGURATIONS, _code(("IDLE", False, True)), Timed, ["input", "arg"], schema)


def timed_log(events: DataFrame) -> DataFrame:
    """events -> device_id, step, at, log_seq, level, msg, color, line with the delays: presses log at once, results
    when they come due, stale ones nothing."""
    return log_of_rows(_timed(events))


def log_of_rows(path: DataFrame) -> DataFrame:
    """The log of rows of the timed machine (arg and what was before included), or of its stream, which have no step."""
    rows = F.when(F.lit(False), F.array().cast("array<struct<level:string,msg:string>>"))
    for kind, name, condition, texts in TIMED_LOG_RULES:
        rows = rows.when((F.col("kind") == kind) & (F.col("name") == name) & F.expr(condition), _texts(texts))
    keys = [c for c in ("device_id", "step", "at") if c in path.columns]
    was = path.withColumn("igniter", F.col("was_igniter")).withColumn("circuit", F.col("was_circuit"))
    out = was.withColumn("rows", rows).select(*keys, F.posexplode("rows").alias("log_seq", "r"))
    return out.select(*keys, "log_seq", "r.level", "r.msg", color(F.col("r.level")).alias("color"), line("at", F.col("r.msg")).alias("line"))


def start_log(events: DataFrame) -> DataFrame:
    """One row a device: what a machine logs when it starts, at the time of its first event."""
    first = events.groupBy("device_id").agg(F.min("ts").alias("ts"))
    level, msg = map(F.lit, START_LOG)
    return first.select("device_id", "ts", level.alias("level"), msg.alias("msg"), color(level).alias("color"), line("ts", msg).alias("line"))


def line(ts: str, msg: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("]  "), msg)


def _texts(texts: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("level"), F.lit(b).alias("msg")) for a, b in texts]).cast("array<struct<level:string,msg:string>>")


class Timed:
    """One device: its coded configuration, and the pending results in order."""

    def __init__(self, state: str = _code(("IDLE", False, True)), pending: list | None = None) -> None:
        self.now, self.pending = _DECODED[state], pending or []

    @property
    def state(self) -> str:
        return _code(self.now)

    def due(self, ts) -> list[tuple]:
        out = []
        while self.pending and (ts is None or self.pending[0][0] <= ts):
            at, name = self.pending.pop(0)
            before, self.now = self.now, resolve(self.now, name)
            out.append((at, "result", name, before[0], *self.now, None, *before[1:]))
        return out

    def rest(self) -> list[tuple]:
        return self.due(None)

    def press(self, ts, name: str, arg: bool | None) -> list[tuple]:
        out = self.due(ts)
        before, self.now = self.now, press(self.now, name, arg)
        if self.now[0] != before[0] and name in DELAYS_SEVEN_MS:
            self.pending.append((ts + dt.timedelta(milliseconds=DELAYS_SEVEN_MS[name]), name))
            self.pending.sort(key=lambda p: p[0])
        out.append((ts, "press", name, before[0], *self.now, arg, *before[1:]))
        return out


def final_state(events: DataFrame) -> DataFrame:
    """events -> device_id, n_events, state, igniter, circuit (sync mode): no row of an event is made."""
    out = scan.final(events, CONFIGURATIONS, _code(("IDLE", False, True)), step, ["input", "arg"])
    return _decoded(out.withColumnRenamed("state", "_code"), "_code").drop("_code")


def event_log(path: DataFrame) -> DataFrame:
    """Trajectory -> device_id, ts, seq, log_seq, level, msg, color, line."""
    rows = F.when(F.lit(False), F.array().cast("array<struct<level:string,msg:string>>"))
    for name, condition, texts in LOG_RULES:
        rows = rows.when((F.col("input") == name) & F.expr(condition), _texts(texts))
    out = path.withColumn("rows", rows).select("device_id", "ts", "seq", F.posexplode("rows").alias("log_seq", "r"))
    return out.select("device_id", "ts", "seq", "log_seq", "r.level", "r.msg", color(F.col("r.level")).alias("color"), line("ts", F.col("r.msg")).alias("line"))


def looked_up(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def color(level: Column) -> Column:
    return looked_up(LEVEL_COLOR, level, LEVEL_COLOR["INFO"])


def display(state: Column) -> Column:
    return looked_up(DISPLAY, state)


def banner(state: Column) -> list[Column]:
    text = F.concat(F.lit("STATE: "), F.upper(display(state)), F.lit("   —   "), looked_up({s: b[2] for s, b in BANNER.items()}, state))
    return [
        looked_up({s: b[0] for s, b in BANNER.items()}, state, DEFAULT_BANNER[0]).alias("bg"),
        looked_up({s: b[1] for s, b in BANNER.items()}, state, DEFAULT_BANNER[1]).alias("fg"),
        F.coalesce(text, state).alias("text"),
    ]


def buttons(state: Column, igniter: Column) -> list[Column]:
    idle, cancel = state == "IDLE", ~state.isin("IDLE", "LAUNCHING", "LAUNCHED")
    gates = {"igniter": idle, "test": idle & igniter, "enable": state == "TEST_PASS", "ready": state == "ENABLED", "launch": state == "READY", "lp_cancel": cancel, "cu_cancel": cancel}
    return [c.alias(f"can_{n}") for n, c in gates.items()]


def lights(state: Column) -> list[Column]:
    order = ("TEST_PASS", "ENABLED", "READY", "LAUNCHING", "LAUNCHED")
    return [state.isin(*order[i:]).alias(n) for n, i in LIGHTS.items()]


def lamp(kind: Column) -> list[Column]:
    return [looked_up({k: v[i] for k, v in LAMP_COLOR.items()}, kind, LAMP_COLOR["off"][i]).alias(n) for i, n in enumerate(("fill", "outline"))]


def lamps(path: DataFrame) -> DataFrame:
    """Rows with device_id, step, next_state -> a row for each of the four lights: device_id, step, light, fill, outline."""
    lights_on = [F.struct(F.lit(n).alias("light"), F.when(c, n.split("_")[1]).otherwise("off").alias("kind")) for n, c in zip(LIGHTS, lights(F.col("next_state")), strict=True)]
    each = path.select("device_id", "step", F.explode(F.array(*lights_on)).alias("l"))
    return each.select("device_id", "step", "l.light", *lamp(F.col("l.kind")))


def wire(state: Column, igniter: Column) -> Column:
    """Colour of the igniter's wire; null where none is drawn."""
    live = state.isin("TEST_PASS", "ENABLED", "READY", "LAUNCHING")
    return F.when(~igniter | (state == "LAUNCHED"), F.lit(None).cast("string")).when(live, "#00ff44").otherwise("#ffdd00")


def flame(state: Column) -> Column:
    return state == "LAUNCHING"
