"""One text over many tasks gives the lines of the serial run."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine import sinks
from tesserine.operators import equations as eq
from tesserine.sources import long_text as lt
from tesserine.sources.inputs import InputError, NoValidEquations, resolve_input

PARTS = ["1", "22.5", "+", "-", "//", "%", "^", "é", "\U0001f680x", "99999", "/", "*"]
GAPS = [" ", ",", "\n", "\t", "\x0b", "\r\n", ", ", " ", "\u0085", " ", " ", " ", " ", " ", "　", "  ,　 "]


def text_of(rng, n):
    return "".join(rng.choice(GAPS) + rng.choice(PARTS) for _ in range(n)) + rng.choice(["", " ", "　"])


@pytest.mark.parametrize(("n", "split", "piece"), [(0, 5, 4), (1, 1, 1), (2, 1, 2), (40, 1, 1), (50, 3, 2), (70, 7, 5), (300, 50, 16), (301, 64, 4096), (2000, 1000, 64)])
def test_splits_cut_nothing(tmp_path, monkeypatch, n, split, piece):
    """Cuts inside of tokens, of separators and of characters, splits without an equation, equations over several splits."""
    monkeypatch.setattr(lt, "PIECE", piece)
    for seed in range(6):
        text = text_of(np.random.default_rng(1000 * n + seed), n)
        path = tmp_path / f"{seed}"
        path.write_bytes(text.encode())
        size = path.stat().st_size
        tokens = [t for t in re.split("[,\\s]+", text) if t]
        splits = [lt.Split(a, min(a + split, size), -1) for a in range(0, size, split)]
        with open(path, "rb") as f:
            counts = [lt._count(f, s) for s in splits]
            assert sum(c for c, _ in counts) == len(tokens) and all(good for _, good in counts)
            before, found = 0, []
            for s, (c, _) in zip(splits, counts, strict=True):
                for number, raw in lt._pieces(f, lt.Split(s.start, s.end, before), size):
                    assert number * lt.ARITY == len(found)
                    found += [t for t in re.split("[,\\s]+", raw.decode()) if t]
                before += c
        assert found == tokens


@pytest.mark.parametrize("bad", [b"\xff", b"\x80", b"\xc3", b"\xe3\x80", b"\xf0\x9f\x9a", b"\xc0\xaf"])
def test_bytes_that_are_not_text(tmp_path, monkeypatch, bad):
    monkeypatch.setattr(lt, "PIECE", 8)
    path = tmp_path / "bad"
    for at in range(24, 60):
        path.write_bytes(("1 + é　" * 20).encode()[:at] + bad + b" 1 + 2 3 + 4 5 + 6")
        whole = path.read_bytes()
        try:
            whole.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        with open(path, "rb") as f:
            assert all(lt._count(f, lt.Split(a, min(a + 12, len(whole)), -1))[1] for a in range(0, len(whole), 12)) == good


def test_lines_equal_the_serial_run(spark, tmp_path, monkeypatch):
    text = text_of(np.random.default_rng(5), 30_001)
    path = tmp_path / "long.txt"
    path.write_text(text, newline="")
    whole = [r["line"] for r in eq.run(resolve_input(spark, text)).orderBy("eq_idx").collect()]
    rows = eq.run_pieces(lt.read_long_text(spark, str(path), split=10_000))
    assert rows.rdd.getNumPartitions() > 10
    got = rows.select("eq_idx", "line", F.spark_partition_id().alias("p")).collect()
    assert [r["line"] for r in got] == whole and [r["eq_idx"] for r in got] == list(range(len(whole)))
    assert len({r["p"] for r in got}) > 10
    monkeypatch.setattr(sinks, "SPLIT", 1000)
    out = tmp_path / "out.txt"
    assert sinks.calculate(spark, str(path), str(out)) == len(whole)
    assert out.read_text() == "".join(x + "\n" for x in whole)


def test_ends_and_errors(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.txt"
    for text, want in (("", []), (" ,　\n", []), ("1", ["1"]), ("1 + 2", ["1 + 2"]), ("1" * 50 + " + 2 3", None)):
        path.write_text(text)
        rows = lt.read_long_text(spark, str(path), split=4)
        if want is None:
            assert eq.run_pieces(rows).count() == 2  # a token longer than a split
        else:
            assert [r["raw"] for r in rows.collect()] == want
    path.write_bytes(b"1 + 2 " * 10 + b"\xff")
    with pytest.raises(InputError):
        lt.read_long_text(spark, str(path), split=16)
    with pytest.raises(InputError):
        lt.read_long_text(spark, str(tmp_path))
    monkeypatch.setattr(sinks, "SPLIT", 4)
    path.write_text("foo ^ bar, x y z")
    with pytest.raises(NoValidEquations):
        sinks.calculate(spark, str(path), str(tmp_path / "none.txt"))
    assert not os.path.exists(tmp_path / "none.txt")
