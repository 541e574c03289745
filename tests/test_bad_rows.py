from __future__ import annotations

import pytest

from tomoframe.operators.bad_rows import classified


def line(**at) -> str:
    fields = [str(i + 1) for i in range(35)]
    fields[17] = "1"
    for k, v in at.items():
        fields[int(k[1:]) - 1] = v
    return " ".join(fields)


CASES = [
    (line(), None),
    (line().replace(" ", "\t") + " \r", None),
    (line(f4='"-1.5"', f5='" 2 "', f6="+.5e-3", f8="1.", f9="NaN"), None),
    (line(f4="1.5+2e-06i", f5="-1-.5J", f1="7+0j"), None),
    (line(f4="1.5+i"), "value"),
    (line(f4="1+2"), "value"),
    (line(f4="1e999"), "value"),
    (line(f4="inf"), "value"),
    (line(f4="1_0"), "value"),
    (line(f4="0x1p3"), "value"),
    (line(f4="1d"), "value"),
    (line(f4="١"), "value"),
    (line(f4="−1"), "value"),
    (line(f4='""'), "value"),
    (line(f4='"1 2"'), "value"),
    (line() + "\r\r", "value"),
    (line(f4='"1'), "quoting"),
    (line(f4='1"'), "quoting"),
    (line(f4='""1""'), "quoting"),
    (line(f4='"1"x'), "quoting"),
    (line(f4='" 1', f9='2 "'), "columns"),
    (line() + " 36", "columns"),
    ("1 2 3", "columns"),
    (line().replace(" ", ","), "columns"),
    (line(f1="0"), "tag"),
    (line(f1="1.5"), "tag"),
    (line(f1="nan"), "tag"),
    (line(f7="360.0"), None),
    (line(f7="-360.01"), "tdrot"),
    (line(f7="nan"), "tdrot"),
    (line(f18="0.0"), None),
    (line(f18="2"), "fs1"),
    (line(f18="nan"), "fs1"),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, text, "kept") for i, (text, _) in enumerate(CASES)] + [(100, "", "x"), (101, " \t", "x"), (102, "  # 35 columns", "x"), (103, None, "x"), (104, "#", "x")]
    out = classified(spark.createDataFrame(rows, "line_id int, line string, row string"))
    return {r.line_id: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reason(got, i):
    assert got[i].reason == CASES[i][1], CASES[i][0]


def test_no_rows(got):
    assert not set(got) & {100, 101, 102, 103, 104}


def test_values(got):
    row = got[2].row
    assert (row.dx, row.dy, row.dz, row.tilt, row.narot) == (-1.5, 2.0, 0.0005, 1.0, None)
    assert (got[3].row.tag, got[3].row.dx, got[3].row.dy) == (7.0, 1.5, -1.0)
    assert got[4].row is None


def test_empty(spark):
    assert classified(spark.createDataFrame([], "line string")).count() == 0
