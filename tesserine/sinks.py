"""Sinks: ordered result lines in folders or in one file, event logs of streams."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tesserine.operators import equations
from tesserine.sources.inputs import NoValidEquations, resolve_input
from tesserine.sources.long_text import SPLIT, read_long_text


class OutputError(OSError):
    """The result can't be written."""


def write_lines(lines: DataFrame, path: str, order: tuple[str, ...] = ("doc_id", "eq_idx"), single: bool = False) -> None:
    """line in order, overwriting. Part files follow one another in order; `single` asks for one of them."""
    out = lines.orderBy(*order).select("line")
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


@dataclass
class Part(WriterCommitMessage):
    place: int
    path: str
    lines: int
    valid: int
    size: int


class _LineWriter(DataSourceWriter):
    """Tasks write parts beside the result; the commit joins them in their order, and only then there is a file."""

    def __init__(self, path: str) -> None:
        self.path, self.staged = path, f"{path}.parts-{uuid.uuid4().hex}"
        os.mkdir(self.staged)

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        name = f"{self.staged}/{task.partitionId():08d}-{task.taskAttemptId()}"  # attempts don't share a file
        lines = valid = 0
        with open(name, "w", encoding="utf-8", newline="") as f:
            for line, ok in iterator:
                f.write(line + "\n")
                lines, valid = lines + 1, valid + bool(ok)
        return Part(task.partitionId(), name, lines, valid, os.path.getsize(name))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.place)
        summary = {"lines": sum(m.lines for m in parts), "valid": sum(m.valid for m in parts), "bytes": sum(m.size for m in parts)}
        try:
            if summary["valid"]:
                with open(f"{self.staged}/whole", "wb") as out:
                    for m in parts:
                        with open(m.path, "rb") as f:
                            shutil.copyfileobj(f, out, 1 << 20)
                os.replace(f"{self.staged}/whole", self.path)
            with open(f"{self.path}.summary", "w", encoding="utf-8") as f:
                json.dump(summary, f)
        finally:
            shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class LineFile(DataSource):
    """Write-only source `line_file`: rows (line string, valid boolean) -> one file at `path`, in the order of partitions and
    of rows in them, each line ended by a line feed. The path must be one that driver and executors share. No file is
    made, and a file that is there stays, where a task fails or no row is valid. Beside it lies `path`.summary."""

    @classmethod
    def name(cls) -> str:
        return "line_file"

    def schema(self) -> str:
        return "line string, valid boolean"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _LineWriter(self.options["path"])


def write_line_file(rows: DataFrame, path: str) -> dict:
    """rows(line, valid) in their order -> one file, written by the tasks. Returns lines, valid and bytes."""
    spark: SparkSession = rows.sparkSession
    folder = os.path.dirname(path) or "."
    if not os.path.isdir(folder) or os.path.isdir(path):
        raise OutputError(f"cannot write file: {path}: no such folder, or a folder itself")
    spark.dataSource.register(LineFile)
    try:
        rows.select("line", "valid").write.format("line_file").mode("append").option("path", path).save()
        with open(f"{path}.summary", encoding="utf-8") as f:
            return json.load(f)
    except OSError as e:
        raise OutputError(f"cannot write file: {path}: {e}") from e
    finally:
        if os.path.exists(f"{path}.summary"):
            os.remove(f"{path}.summary")


def write_result_file(lines: DataFrame, path: str, order: tuple[str, ...] = ("doc_id", "eq_idx")) -> int:
    """One plain file, each line ended by a line feed, sorted by range and written by tasks. Returns the number of lines."""
    return write_line_file(lines.orderBy(*order).select("line", F.lit(True).alias("valid")), path)["lines"]


def calculate(spark: SparkSession, argument: str | None, path: str = "output.txt") -> int:
    """The whole run in one job: input, evaluation, gate, result file. Returns the number of lines. Where no equation
    parses there is an error and no file. A file of more than one split is read by many tasks, after a job that counts
    its tokens."""
    if argument is not None and os.path.isfile(argument) and os.path.getsize(argument) > SPLIT:
        rows = equations.run_pieces(read_long_text(spark, argument))
    else:
        rows = equations.run(resolve_input(spark, argument))  # one text: its rows are in order
    parsed = F.coalesce(F.col("err_stage") != "parse", F.lit(True))
    found = write_line_file(rows.select("line", parsed.alias("valid")), os.path.join(os.getcwd(), path))
    if not found["valid"]:
        raise NoValidEquations("no valid equations found in input")
    return found["lines"]


def append_log(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Streamed log rows, appended to a table of Parquet files. Each micro-batch has a folder of its own that a repeated
    batch overwrites, so a stream that is restarted logs each row once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
