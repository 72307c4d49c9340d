"""Folds of a finite machine over long keys: a segmented scan.

Events are dealt by ranges of (device, time, seq), so that a range has about as many as any other, whatever the
devices and times. In a sorted range only its first device can have begun in an earlier one. All others
are folded from the start; for the first one a task keeps, for each state the device may be in, the state that
follows. Such maps compose: from those of a device's segments follows the state in which each begins.

An event without a time has no place in any order: all folds and streams leave it out (`untimed` gives them).
At equal times the smaller seq comes first, null before all.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserine.storage import written


def untimed(events: DataFrame) -> DataFrame:
    """The events that no fold and no stream takes."""
    return events.filter("ts IS NULL")


def _ranges(events: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Events that have a time, in order, dealt by ranges."""
    order = ["device_id", "ts", "seq", *cols]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.select(*order).filter("ts IS NOT NULL").repartitionByRange(parts, *order).sortWithinPartitions(*order)


class _Table:
    """The machine as a table that grows by the kinds of events that come: for each, the state after each state."""

    def __init__(self, states: Sequence[str], step: Callable[..., str]) -> None:
        self.states, self.step, self.at, self.kinds, self.moves = states, step, {s: i for i, s in enumerate(states)}, {}, []

    def code(self, event: tuple) -> int:
        found = self.kinds.get(event)
        if found is None:
            found = self.kinds[event] = len(self.moves)
            self.moves.append([self.at[self.step(s, *event)] for s in self.states])
        return found


def _fold_ranges(laid: DataFrame, states: Sequence[str], start: str, step: Callable[..., str], cols: Sequence[str], rows: bool) -> DataFrame:
    """Sorted ranges -> device_id, p (range), n, before, after, befores, afters: for each event (or, without `rows`, for the
    last one of each device in a range): n events of the device in the range up to it. before and after are states of
    devices that begin in the range, befores and afters, of the range's first device, by the state it comes in with."""
    types = {f.name: f.dataType.simpleString() for f in laid.schema.fields}
    keep = ["device_id", "ts", "seq", *cols] if rows else ["device_id"]
    tiny = "array<tinyint>"
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + f", p int, n long, before tinyint, after tinyint, befores {tiny}, afters {tiny}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, p = _Table(states, step), TaskContext.get().partitionId()
        at0, every = table.at[start], np.arange(len(states), dtype=np.int8)
        device, first, seen, now, n = None, True, False, at0, 0
        reach, moves = every, {}
        last: tuple | None = None  # of a device, when only last ones count

        def batch_of(kept: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*found, strict=True)) if found else [()] * 5
            lists = [pa.array(x, pa.list_(pa.int8())) for x in c[3:]]
            arrays = [*kept, pa.array([p] * len(found), pa.int32()), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int8()), pa.array(c[2], pa.int8()), *lists]
            return pa.RecordBatch.from_arrays(arrays, names=[*keep, "p", "n", "before", "after", "befores", "afters"])

        kind = None
        for batch in batches:
            kind = kind or batch.schema.field("device_id").type
            ids = batch.column(0).to_pylist()
            events = zip(*(batch.column(i).to_pylist() for i in range(3, 3 + len(cols))), strict=True)
            out, done = [], []
            for d, e in zip(ids, events, strict=True):
                if not seen or d != device:
                    if seen:
                        first = False
                        if last is not None:
                            done.append((device, last))
                    device, seen, now, n = d, True, at0, 0
                n += 1
                c = table.code(e)
                if first:
                    if c not in moves:
                        moves[c] = np.array(table.moves[c], np.int8)
                    was, reach = reach, moves[c][reach]
                    last = (n, None, None, was, reach)
                else:
                    was, now = now, table.moves[c][now]
                    last = (n, was, now, None, None)
                if rows:
                    out.append(last)
            if rows:
                yield batch_of([batch.column(i) for i in range(len(keep))], out)
            elif done:
                yield batch_of([pa.array([x for x, _ in done], kind)], [x for _, x in done])
        if seen and not rows:
            yield batch_of([pa.array([device], kind)], [last])

    return laid.mapInArrow(run, schema)


def _segments(ends: DataFrame) -> Column:
    """A device's segments in order, aggregated: n and what each does to the state. A device has one in each range
    that it reaches into."""
    return F.array_sort(F.collect_list(F.struct("p", "n", "after", "afters")))


def _through(state: Column, segment: Column) -> Column:
    return F.coalesce(segment["after"], F.get(segment["afters"], state.cast("int"))).cast("tinyint")


def trajectory(events: DataFrame, states: Sequence[str], start: str, step: Callable[..., str], cols: Sequence[str]) -> DataFrame:
    """device_id, ts, seq, step, cols, _before, _after: one row an event that has a time. Tasks hold a batch of a range;
    what is gathered by device is a row for each range it reaches into."""
    laid = written(_fold_ranges(_ranges(events, cols), states, start, step, cols, rows=True), "trajectory")
    ends = laid.groupBy("device_id", "p").agg(F.max("n").alias("n"), F.max_by("after", "n").alias("after"), F.max_by("afters", "n").alias("afters"))
    first = F.struct(F.lit(states.index(start)).cast("tinyint").alias("s"), F.lit(0).cast("long").alias("k"), F.array().cast("array<struct<p:int,entry:tinyint,earlier:bigint>>").alias("out"))

    def enter(acc: Column, x: Column) -> Column:
        begun = F.struct(x["p"].alias("p"), acc["s"].alias("entry"), acc["k"].alias("earlier"))
        return F.struct(_through(acc["s"], x).alias("s"), (acc["k"] + x["n"]).alias("k"), F.concat(acc["out"], F.array(begun)).alias("out"))

    many = ends.groupBy(F.col("device_id").alias("_device")).agg(_segments(ends).alias("x")).filter(F.size("x") > 1)
    entries = many.select("_device", F.explode(F.aggregate("x", first, enter, lambda acc: acc["out"])).alias("e")).select("_device", F.col("e.p").alias("_p"), "e.entry", "e.earlier")
    joined = laid.join(entries, F.col("device_id").eqNullSafe(F.col("_device")) & (F.col("p") == F.col("_p")), "left")
    entry = F.coalesce("entry", F.lit(states.index(start))).cast("int")
    name = lambda one, many: F.get(F.array(*map(F.lit, states)), F.coalesce(F.col(one), F.get(F.col(many), entry)).cast("int"))
    place = (F.col("n") + F.coalesce("earlier", F.lit(0))).cast("int")
    return joined.select("device_id", "ts", "seq", place.alias("step"), *cols, name("before", "befores").alias("_before"), name("after", "afters").alias("_after"))


def final(events: DataFrame, states: Sequence[str], start: str, step: Callable[..., str], cols: Sequence[str]) -> DataFrame:
    """device_id, n_events, state: from the segments alone, no row of an event is made."""
    ends = _fold_ranges(_ranges(events, cols), states, start, step, cols, rows=False)
    found = ends.groupBy("device_id").agg(F.sum("n").alias("n_events"), _segments(ends).alias("x"))
    state = F.aggregate("x", F.lit(states.index(start)).cast("tinyint"), _through)
    return found.select("device_id", "n_events", F.get(F.array(*map(F.lit, states)), state.cast("int")).alias("state"))


class _Lanes:
    """Machines that begin in different configurations and get the same presses; those that meet go on as one."""

    #: Presses between two looks for machines that have met.
    EVERY = 8

    def __init__(self, entries: Sequence[str], opened: Callable[[str], Any]) -> None:
        self.entries, self.lanes = entries, [opened(e) for e in entries]
        self.lane_of, self.ahead, self.n, self.presses = list(range(len(entries))), [0] * len(entries), [0] * len(entries), 0

    def press(self, *event: Any) -> None:
        if len(self.lanes) == 1:
            self.n[0] += len(self.lanes[0].press(*event))
            return
        self.n = [n + len(m.press(*event)) for n, m in zip(self.n, self.lanes, strict=True)]
        self.presses += 1
        if self.presses % self.EVERY == 0:
            self._merge()

    def _merge(self) -> None:
        met: dict[tuple, int] = {}
        to = [met.setdefault((m.state, tuple(m.pending)), len(met)) for m in self.lanes]
        if len(met) < len(to):
            kept = [to.index(j) for j in range(len(met))]
            self.ahead = [a + self.n[i] - self.n[kept[to[i]]] for a, i in zip(self.ahead, self.lane_of, strict=True)]
            self.lane_of = [to[i] for i in self.lane_of]
            self.lanes, self.n = [self.lanes[i] for i in kept], [self.n[i] for i in kept]

    def done(self) -> list[tuple]:
        """entry, exit, rows made: for each configuration that was asked for."""
        return [(e, _coded(self.lanes[i]), self.n[i] + a) for e, i, a in zip(self.entries, self.lane_of, self.ahead, strict=True)]


_MICROSECOND = dt.timedelta(microseconds=1)
_EPOCH = dt.datetime(1970, 1, 1)


def _coded(machine: Any) -> str:
    """A configuration as text: the state, then time, name and number of the results that are pending, in order."""
    runs = [(at, name, len(list(same))) for (at, name), same in groupby(machine.pending)]
    return " ".join([machine.state, *(f"{(at - _EPOCH) // _MICROSECOND} {name} {n}" for at, name, n in runs)])


def _opened(machine: Callable[..., Any], code: str) -> Any:
    state, *rest = code.split(" ")
    return machine(state, [(_EPOCH + int(at) * _MICROSECOND, name) for at, name, n in zip(rest[::3], rest[1::3], rest[2::3], strict=True) for _ in range(int(n))])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["device_id"].eqNullSafe(b["device_id"]) & (a["p"] == b["p"])


def _headed(laid: DataFrame, heads: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Events by segment (device_id, p) in order, each segment after its row of `heads`, if it has one; only that has no time."""
    fields = [c for c in heads.columns if c not in ("device_id", "p")]
    both = laid.unionByName(heads, allowMissingColumns=True).repartition("device_id", "p").sortWithinPartitions("device_id", "p", "ts", "seq", *cols)
    return both.select("device_id", "p", "ts", *cols, *fields)


def _closure(laid: DataFrame, long: DataFrame, states: Sequence[str], start: str, machine: Callable[..., Any], cols: Sequence[str]) -> DataFrame:
    """device_id, p, entry, exit, n: what each segment that another one follows does to the configurations that it may
    be entered in. The first round asks for all states with nothing pending (of first segments, for the start);
    each next one for what the segment before was left in and nobody has asked for yet, until nothing is new."""
    schema = "device_id long, p int, entry string, exit string, n long"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lanes = None, None
        for batch in batches:
            out = []
            for device, p, ts, *event, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ts is None:
                    out += [(*now, *x) for x in lanes.done()] if lanes else []
                    now, lanes = (device, p), _Lanes(entries, lambda code: _opened(machine, code))
                else:
                    lanes.press(ts, *event)
            if out:
                yield _batch(schema, out)
        if lanes:
            yield _batch(schema, [(*now, *x) for x in lanes.done()])

    inner = long.filter("following IS NOT NULL")
    guesses = F.when(F.col("opens"), F.array(F.lit(start))).otherwise(F.array(*map(F.lit, states)))
    asked, known = inner.select("device_id", "p", F.explode(guesses).alias("entry")), None
    while True:
        heads = asked.groupBy("device_id", "p").agg(F.array_sort(F.collect_set("entry")).alias("entries"))
        made = written(_headed(laid.join(heads, _same(laid, heads), "left_semi"), heads, cols).mapInArrow(fold, schema), "timed-maps")
        known = made if known is None else known.union(made)
        left = made.join(inner.filter("followed"), _same(made, inner)).select(made["device_id"], F.col("following").alias("p"), F.col("exit").alias("entry")).distinct()
        asked = written(left.join(known, _same(left, known) & (left["entry"] == known["entry"]), "left_anti"), "timed-asked")
        if asked.isEmpty():
            return known


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*(f.strip().split(" ") for f in schema.split(",")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}


def timed(events: DataFrame, states: Sequence[str], start: str, machine: Callable[..., Any], cols: Sequence[str], schema: str) -> DataFrame:
    """Rows of a machine with delays; `schema` begins with device_id, step. A machine is made of a state and what is
    pending (time, name), has press(ts, *cols) and rest(), which give rows, `state` and `pending`.

    Ranges of events are as in `trajectory`, however dense a device is. A configuration is a state and what is pending,
    so there is no end of them; but what differs at the beginning of a segment mostly meets within a few delays, and
    `_closure` folds each segment from those that occur. A device's segments then compose, and each is read once
    more from the configuration it is entered in. Tasks hold a batch of a segment and its configurations; by device
    are gathered a few rows for each range it reaches into. Rounds go on while a segment is left in a
    configuration that is new to the next one: two or three, and one more for each further segment within one delay.
    """
    clean = events.withColumn("device_id", F.col("device_id").cast("long")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    laid = written(_ranges(clean, cols).withColumn("p", F.spark_partition_id()), "timed")
    place = Window.partitionBy("device_id").orderBy("p")
    segments = laid.groupBy("device_id", "p").agg(F.count(F.lit(1)).alias("n")).select("device_id", "p", F.lead("p").over(place).alias("following"), F.lag("p").over(place).isNull().alias("opens"), F.lead("p", 2).over(place).isNotNull().alias("followed"))
    long = written(segments.filter("NOT opens OR following IS NOT NULL"), "timed-segments")
    entered = "device_id long, p int, entry string, before long, ends boolean"

    def compose(found: pa.Table) -> pa.Table:
        maps: dict[int, dict] = {}
        for r in found.to_pylist():
            maps.setdefault(r["p"], {})[r["entry"]] = (r["exit"], r["n"])
        device, code, k, out = found.column("device_id")[0].as_py(), start, 0, []
        for p in sorted(maps):
            out.append((device, p, code, k, p == max(maps)))
            if p != max(maps):
                code, n = maps[p][code]
                k += n
        return pa.Table.from_batches([_batch(entered, out)])

    known = _closure(laid, long, states, start, machine, cols) if not long.isEmpty() else long.selectExpr("device_id", "p", "'' AS entry", "'' AS exit", "0L AS n").limit(0)
    heads = known.unionByName(long.select("device_id", "p"), allowMissingColumns=True).groupBy("device_id").applyInArrow(compose, entered)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, k, ends = None, None, 0, False
        for batch in batches:
            out = []
            for device, p, ts, *event, entry, before, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (device, p) != now:
                    out += [(now[0], k + i, *x) for i, x in enumerate(held.rest(), 1)] if held and ends else []
                    now, held, k, ends = (device, p), _opened(machine, start if entry is None else entry), before or 0, last is not False
                if ts is not None:
                    made = held.press(ts, *event)
                    out += [(device, k + i, *x) for i, x in enumerate(made, 1)]
                    k += len(made)
            yield _batch(schema, out)
        if held and ends:
            yield _batch(schema, [(now[0], k + i, *x) for i, x in enumerate(held.rest(), 1)])

    return _headed(laid, heads, cols).mapInArrow(rows, schema)
