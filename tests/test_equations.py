import math
import os
import re
from decimal import Decimal

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tesserine import catalog, sinks
from tesserine.functions.numbers import number_text, parse_number
from tesserine.operators import equations as eq
from tesserine.plans import derived
from tesserine.sources.inputs import InputError, NoValidEquations, read_documents, resolve_input


def lines(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw string")
    return [r["line"] for r in eq.run(docs).orderBy("doc_id", "eq_idx").collect()]


CASES = [
    ("3 + 4 10 * 2 8 // 3", ["3 + 4 = 7", "10 * 2 = 20", "8 // 3 = 2"]),
    ("1 + 2, 3 * 4", ["1 + 2 = 3", "3 * 4 = 12"]),
    ("10 - 3, 6 / 2", ["10 - 3 = 7", "6 / 2 = 3"]),
    ("4 / 0", ["4 / 0 = error: division by zero"]),
    ("5 / -0", ["5 / 0 = error: division by zero"]),
    ("5 % 0 5 // 0", ["5 % 0 = error: division by zero", "5 // 0 = error: division by zero"]),
    ("1 ^ 2", ["error: '^' is not a recognized operator = error: '^' is not a recognized operator"]),
    ("foo ^ bar", ["error: 'foo' is not a valid number = error: 'foo' is not a valid number"]),
    ("1 +", ["error: expected 3 tokens but got 2: '1 +' = error: expected 3 tokens but got 2: '1 +'"]),
    ("1 +, 2 * 3", ["1 + 2 = 3", "error: expected 3 tokens but got 2: '* 3' = error: expected 3 tokens but got 2: '* 3'"]),
    ("-7 // 2 -7 % 3 7 % -3", ["-7 // 2 = -4", "-7 % 3 = -1", "7 % -3 = 1"]),
    ("1e300 + 1", ["9223372036854775807 + 1 = 9223372036854775807"]),
    ("1d + 2 0x1p3 + 1 1_0 + 1", [f"error: '{x}' is not a valid number = error: '{x}' is not a valid number" for x in ("1d", "0x1p3", "1_0")]),
    ("+nan + 1 inf - inf", ["NaN + 1 = NaN", "inf - inf = NaN"]),
    ("1 + 2", ["1 + 2 = 3"]),
    ("0.00001 * 1", ["0.00001 * 1 = 0.00001"]),
    ("3.5 + 2 .5 * 4. 1e400 - 1", ["3.5 + 2 = 5.5", "0.5 * 4 = 2", "inf - 1 = inf"]),
    ("", []),
    (" , ,", []),
]


def test_lines(spark):
    assert lines(spark, *[c[0] for c in CASES]) == [x for c in CASES for x in c[1]]


def shown(x):
    return str(int(x)) if x == int(x) else format(Decimal(repr(x)), "f")


def brute_lines(raw):
    tokens = [t for t in re.split(r"[,\s]+", raw) if t]
    for i in range(0, len(tokens), 3):
        c = tokens[i : i + 3]
        if len(c) < 3:
            error = f"error: expected 3 tokens but got {len(c)}: '{' '.join(c)}'"
        elif c[1] == "^":
            error = "error: '^' is not a recognized operator"
        else:
            a, b = float(c[0]), float(c[2])
            does = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "//": lambda: math.floor(a / b)}
            value = "error: division by zero" if b == 0 and c[1] in ("/", "%", "//") else shown(does[c[1]]())
            yield f"{shown(a)} {c[1]} {shown(b)} = {value}"
            continue
        yield f"{error} = {error}"


def test_all_lines_against_brute_force(spark):
    docs = derived.documents(spark, SF).collect()
    want = sorted((r["doc_id"], i, x) for r in docs for i, x in enumerate(brute_lines(r["raw"])))
    got = sorted(map(tuple, catalog.QUERIES["calc_all_lines"](spark, SF).collect()))
    assert got == want and any(" / 0 = error" in x for _, _, x in got) and any(" / " in x and "." in x for _, _, x in got)


def test_null_text_and_gate(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "foo ^ bar"), (4, "1 + 2 x + y")], "doc_id long, raw string")
    assert {r["doc_id"]: (r["n_equations"], r["any_valid"]) for r in eq.gate(docs).collect()} == {1: (0, False), 2: (0, False), 3: (1, False), 4: (2, True)}


NUMBER = st.floats(allow_nan=False, allow_infinity=False, width=64).filter(lambda x: x == 0 or abs(x) > 1e-300)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(NUMBER, st.sampled_from(["+", "-", "*", "/", "%", "//"]), NUMBER), min_size=20, max_size=40))
def test_arithmetic_is_ieee(spark, rows):
    texts = [f"{a!r} {op} {b!r}" for a, op, b in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw string")
    got = {r["doc_id"]: r for r in eq.evaluate(eq.parse(eq.chunk(eq.tokenize(docs)))).collect()}

    def value(a, op, b):
        if op in ("/", "%", "//") and b == 0:
            return None
        try:
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "//": lambda: float(math.floor(a / b))}[op]()
        except OverflowError:
            return a / b

    for i, (a, op, b) in enumerate(rows):
        want = value(a, op, b)
        assert got[i]["lhs"] == a and got[i]["rhs"] == b
        assert (got[i]["result"] == want) or (want != want and got[i]["result"] != got[i]["result"]), (a, op, b)
        assert (got[i]["err_kind"] == "DivisionByZero") == (want is None)


def test_round_trip_of_text(spark):
    values = [1.5, -0.25, 1e-7, 5.684341886080802e-14, 123456789.125, 1e16, -3.0, 2.0**60]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", number_text(df["v"]).alias("t")).select("v", "t", parse_number(F.col("t")).alias("back")).collect()
    assert all("e" not in r["t"].lower() and r["back"] == r["v"] for r in rows)


def test_inputs_and_files(spark, tmp_path):
    file = tmp_path / "in.txt"
    file.write_text("10 - 3,\n6 / 2")
    out = tmp_path / "out.txt"
    assert sinks.calculate(spark, str(file), str(out)) == 2
    assert out.read_text() == "10 - 3 = 7\n6 / 2 = 3\n"
    assert sinks.calculate(spark, "1 + 2", str(out)) == 1
    assert out.read_text() == "1 + 2 = 3\n"
    with pytest.raises(ValueError):
        resolve_input(spark, None)
    with pytest.raises(InputError):
        resolve_input(spark, str(tmp_path))
    (tmp_path / "bad").write_bytes(b"1 + \xff")
    with pytest.raises(InputError):
        resolve_input(spark, str(tmp_path / "bad"))
    (tmp_path / "many").mkdir()
    for name, text in (("a", "1 + 2,\n3 - 1"), ("b", "4 * 5"), ("c", "")):
        (tmp_path / "many" / name).write_text(text)
    assert sorted(r["line"] for r in eq.run(read_documents(spark, str(tmp_path / "many"))).collect()) == ["1 + 2 = 3", "3 - 1 = 2", "4 * 5 = 20"]
    (tmp_path / "many" / "bad").write_bytes(b"1 + \xff")
    with pytest.raises(Exception, match="not valid UTF-8"):
        read_documents(spark, str(tmp_path / "many")).collect()
    with pytest.raises(NoValidEquations):
        sinks.calculate(spark, "foo ^ bar", str(out))
    assert out.read_text() == "1 + 2 = 3\n"
    with pytest.raises(sinks.OutputError):
        sinks.calculate(spark, "1 + 2", str(tmp_path / "none" / "x"))
    sinks.write_lines(eq.run(resolve_input(spark, "1 + 1 2 + 2")), str(tmp_path / "dir"), single=True)
    parts = [p for p in os.listdir(tmp_path / "dir") if p.startswith("part")]
    assert len(parts) == 1 and (tmp_path / "dir" / parts[0]).read_text() == "1 + 1 = 2\n2 + 2 = 4\n"


def test_line_file_is_written_by_tasks(spark, tmp_path):
    """Many partitions, in order; a failed task or no valid row leaves what was there and nothing beside it."""
    path = str(tmp_path / "lines.txt")
    rows = spark.range(0, 5000, 1, 7).select(F.concat(F.lit("line é "), "id").alias("line"), (F.col("id") == 3).alias("valid"))
    assert sinks.write_line_file(rows, path) == {"lines": 5000, "valid": 1, "bytes": os.path.getsize(path)}
    with open(path, encoding="utf-8") as f:
        assert f.read().split("\n") == [*(f"line é {i}" for i in range(5000)), ""]
    failing = rows.withColumn("line", F.when(F.col("line").endswith("4321"), F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_line_file(failing, path)
    assert sinks.write_line_file(rows.withColumn("valid", F.lit(False)), path)["valid"] == 0
    assert sinks.write_line_file(rows.limit(0), path) == {"lines": 0, "valid": 0, "bytes": 0}
    assert os.listdir(tmp_path) == ["lines.txt"] and os.path.getsize(path) > 50_000


def test_fraction_text_is_shortest(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-12, 12, 3000), rng.integers(1, 10000, 3000) / rng.integers(1, 1000, 3000), rng.integers(0, 2**63, 3000).view(np.float64), 2.0 ** -np.arange(1, 1075), [5e-324, 6.617444900424222e-24, 7.120236347223045e-307, 2e-3, -0.5]])
    got = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    for r in got:
        x = r["v"]
        if x == x and abs(x) < 2**53 and x != int(x):
            assert r["t"] == format(Decimal(repr(x)), "f")
