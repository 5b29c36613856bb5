"""Quoted CSV and JSON documents cut by many tasks give the rows of one reader."""

import csv
import io
import json
import os
import random

import pytest

from logtide.sources import readers, slices

CELLS = ["a", "", "x,y", "line\nbreak", 'q"q', '5" pipe', "long\n\n" + "z" * 300 + "\nend", "é🙂", "a\r\nb", "  sp ", '"', ",", "\n"]


@pytest.fixture(params=[150, 1 << 27])
def blocks(spark, request):
    """Blocks of a few bytes, in which many records begin or end, and blocks larger than the files."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


def _write(path, rows, end):
    with open(path, "w", encoding="utf-8", newline="") as handle:
        csv.writer(handle, lineterminator=end).writerows([("id", "left", "right"), *rows])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_of_many_blocks(spark, tmp_path, blocks, end):
    draw = random.Random(3)
    files = [[(f"{f}-{i}", draw.choice(CELLS), draw.choice(CELLS)) for i in range(n)] for f, n in enumerate((120, 0, 35))]
    for f, rows in enumerate(files):
        _write(tmp_path / f"p{f}.csv", rows, end)
    found = readers.read_csv_strings(spark, str(tmp_path), position="at")
    assert found.columns == ["at", "id", "left", "right"]
    assert sorted(map(tuple, found.collect())) == [(n, *row) for n, row in enumerate((r for rows in files for r in rows), 1)]


def test_csv_lines_and_their_positions(spark, tmp_path, blocks):
    for f, n in enumerate((40, 7, 90)):
        _write(tmp_path / f"p{f}.csv", [(f"{f}-{i}", "x", i) for i in range(n)], "\n\n")
    wanted = [f"{f}-{i}" for f, n in enumerate((40, 7, 90)) for i in range(n)]
    for multi_line in (True, False):
        found = readers.read_csv_strings(spark, str(tmp_path), multi_line, "at").collect()
        assert [r["id"] for r in sorted(found, key=lambda r: r["at"])] == wanted
        assert sorted(r["at"] for r in found) == list(range(1, 138))


def test_one_cell_longer_than_many_blocks(spark, tmp_path, blocks):
    rows = [("1", "a\n" * 900, "x"), ("2", '"' * 50, "\n" * 700), ("3", "", "end")]
    _write(tmp_path / "long.csv", rows, "\n")
    assert sorted(map(tuple, readers.read_csv_strings(spark, str(tmp_path)).collect())) == rows


@pytest.mark.parametrize("row", ["1,2", "1,2,3,4", '"1,2,3'])
def test_ragged_records_are_refused(spark, tmp_path, row):
    path = os.path.join(tmp_path, "ragged.csv")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(f"a,b,c\n1,2,3\n{row}\n")
    with pytest.raises(Exception, match="cells of the header"):
        readers.read_csv_strings(spark, path).collect()


def test_a_step_over_a_line_agrees_with_the_csv_module():
    draw = random.Random(5)
    for _ in range(3_000):
        line = "".join(draw.choice(['"', '""', ",", "a", " "]) for _ in range(draw.randint(0, 9)))
        more = line + '\n",x'
        open_ = slices.csv_step(slices.State(), line).inside
        rows = list(csv.reader(io.StringIO(more)))
        assert open_ == (len(rows) == 1), line


LOGS = [
    [{"message": f'm{i} "quoted", [x] {{y}} \\ end', "n": i, "ok": i % 2 == 0, "none": None} for i in range(60)],
    ["plain", 'with "quotes", and [brackets', "back\\slash\\", "", "é🙂,]", *[f"line {i}" for i in range(80)]],
    [{"message": "only one"}],
]


@pytest.mark.parametrize("logs", LOGS)
@pytest.mark.parametrize("shape, indent", [("list", None), ("list", 2), ("logs", 2), ("logs first", None), ("logs last", None)])
def test_json_of_many_blocks(spark, tmp_path, blocks, logs, shape, indent):
    other = {"a": [1, [2]], "note": "x, ]} y"}
    document = {"list": logs, "logs": {"logs": logs}, "logs first": {"logs": logs, **other}, "logs last": {**other, "logs": logs}}[shape]
    path = os.path.join(tmp_path, "logs.json")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write("\n  " * (indent is not None) + json.dumps(document, indent=indent, ensure_ascii=indent is None))
    found = readers.read_json_logs(spark, path).collect()
    if isinstance(logs[0], str):
        assert sorted(r["log_text"] for r in found) == sorted(logs)
    else:
        rows = sorted((r.asDict() for r in found), key=lambda r: r.get("n", 0))
        assert [{k: v for k, v in r.items() if v is not None} for r in rows] == [{k: v for k, v in r.items() if v is not None} for r in logs]


@pytest.mark.parametrize("text", ["[]", '["a"', '{"logs": []}', '{"logs": ["a"}', "[1, 2]", '["a", {"m": 1}]', '["a", 3]', "7", '{"rows": [1]}'])
def test_json_that_is_refused(spark, tmp_path, blocks, text):
    path = os.path.join(tmp_path, "bad.json")
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)
    with pytest.raises(ValueError, match="JSON"):
        readers.read_json_logs(spark, path)
