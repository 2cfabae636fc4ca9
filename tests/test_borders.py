"""Files whose records are not lines: small splits against one whole read."""

import csv
import io
import json
import random

import numpy as np
import pytest

from tablewright.sources import borders, readers
from tablewright.sources.normalize import IngestError


@pytest.fixture
def small_splits(spark):
    """A few hundred bytes a task, so that borders fall everywhere."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in kept]
    for k, v in kept.items():
        spark.conf.set(k, v)


def odd_text(draw):
    return "".join(draw.choice(['"', '""', "\n", "\r\n", ",", ";", "word", "é", "漢", " ", "x" * 40, "}", "{", "\\", "[", "]"]) for _ in range(draw.randrange(9)))


def csv_file(seed, rows=60, quoting=csv.QUOTE_MINIMAL):
    draw = random.Random(seed)
    out = io.StringIO(newline="")
    writer = csv.writer(out, quoting=quoting, lineterminator=draw.choice(["\n", "\r\n"]))
    table = [[str(i), odd_text(draw), odd_text(draw) or "-", "end"] for i in range(rows)]
    writer.writerows([["id", "a\nb", "c", "d"], *table])
    return out.getvalue(), table


@pytest.mark.parametrize("seed,quoting,size", [(1, csv.QUOTE_MINIMAL, 97), (2, csv.QUOTE_ALL, 150), (3, csv.QUOTE_MINIMAL, 100_000)])
def test_quoted_text_in_small_splits(spark, tmp_path, small_splits, seed, quoting, size):
    text, table = csv_file(seed, quoting=quoting)
    (tmp_path / "t.csv").write_bytes(text.encode())
    small_splits(size)
    found, ends, _ = borders.records(spark, str(tmp_path / "t.csv"), borders.QuotedText(","))
    got = [r for r in found.collect()]
    assert list(ends.values()) == [False] and sum(r["head"] for r in got) == 1
    parsed = sorted((next(csv.reader(io.StringIO(bytes(r["record"]).decode(), newline=""))) for r in got if not r["head"]), key=lambda r: int(r[0]))
    assert parsed == table
    frame, _ = readers.read_delimited(spark, str(tmp_path / "t.csv"))
    assert frame.columns == ["id", "a\nb", "c", "d"]
    # An empty field is a gap.
    blank = lambda v: None if v in readers.V.MISSING_TOKENS or v == "" else v
    rows = sorted(map(tuple, frame.collect()))
    assert rows == [(int(r[0]), *map(blank, r[1:])) for r in table]


def test_a_file_has_many_tasks(spark, tmp_path, small_splits):
    text, table = csv_file(5, rows=1_000)
    (tmp_path / "t.csv").write_bytes(text.encode())
    small_splits(2_000)
    pieces = borders._pieces(spark, str(tmp_path / "t.csv"), borders.QuotedText(","))
    known, _ = borders.beginnings(pieces, borders.QuotedText(","))
    assert len(known) > 20 and any(state for state, _ in known.values())
    assert readers.read_delimited(spark, str(tmp_path / "t.csv"))[0].count() == len(table)


def test_quotes_inside_plain_fields_are_characters(spark, tmp_path, small_splits):
    text = 'id,size\n1,5" pipe\n2,"two\nlines"\n3,6" x 7"\n4,"a ""b""\n"\n' * 3 + '9,""\n'
    (tmp_path / "t.csv").write_text(text.replace("\nid,size", ""), newline="")
    small_splits(20)
    frame, _ = readers.read_delimited(spark, str(tmp_path / "t.csv"))
    rows = sorted(map(tuple, frame.collect()), key=str)
    want = [(1, '5" pipe'), (2, "two\nlines"), (3, '6" x 7"'), (4, 'a "b"\n')] * 3 + [(9, None)]
    assert rows == sorted(want, key=str)


def test_scan_agrees_with_a_plain_machine():
    draw = random.Random(8)
    form = borders.QuotedText(",")
    for _ in range(3_000):
        data = "".join(draw.choice('",\n\rxy') for _ in range(draw.randrange(40))).encode() + b"\n"
        start = draw.random() < .5
        state, ends, i = start, [], 0
        while i < len(data):
            c = data[i:i + 1]
            if state:
                if c == b'"':
                    if data[i + 1:i + 2] == b'"':
                        i += 1
                    else:
                        state = False
            elif c == b'"' and (i == 0 or data[i - 1:i] in (b",", b"\n", b"\r")):
                state = True
            elif c == b"\n":
                ends.append(i + 1)
            i += 1
        got, after = form.scan(np.frombuffer(data, np.uint8), start)
        assert (got.tolist(), after) == (ends, state), data


def test_quote_that_never_closes_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(IngestError, match="never closed"):
        readers.read_delimited(spark, str(tmp_path / "t.csv"))


def test_wide_headers_are_whole(spark, tmp_path):
    names = [f"measure_{i:06d}" for i in range(6_000)]
    for broken in ("0", '"0\n0"'):
        (tmp_path / "t.csv").write_text(",".join(names) + "\n" + ",".join([broken, *["1"] * 5_999]) + "\n")
        assert tuple(readers.dialects(spark, str(tmp_path / "t.csv"))[0].header) == tuple(names)
    quoted = "id," + ",".join(f'"{"long " * 40}\n{i}"' for i in range(700))
    (tmp_path / "q.csv").write_text(quoted + "\n" + ",".join("7" * 701).replace("77", "7") + "\n")
    assert len(readers.dialects(spark, str(tmp_path / "q.csv"))[0].header) == 701


def records_of(seed, n=50):
    draw = random.Random(seed)
    deep = lambda: {"s": odd_text(draw), "in": {"list": [odd_text(draw), "]}"], "n": draw.randrange(9)}}
    return [{"id": i, "text": odd_text(draw), "more": [deep() for _ in range(draw.randrange(3))], **({"late": 1.5} if i > 30 else {})} for i in range(n)]


@pytest.mark.parametrize("indent,size", [(None, 151), (2, 400), (2, 1_000_000)])
def test_json_list_in_small_splits(spark, tmp_path, small_splits, indent, size):
    rows = records_of(size)
    (tmp_path / "t.json").write_text("﻿" + json.dumps(rows, indent=indent, ensure_ascii=indent is None) + "\n", encoding="utf-8")
    whole = spark.read.json(str(tmp_path / "t.json"), multiLine=True)
    small_splits(size)
    got = readers._listed_records(spark, str(tmp_path / "t.json"))
    assert got.schema == whole.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("text", ["[]", "[1, 2]", "[[1], [2]]", '[{"a": 1}, 3]', '[{"a": 1}', '[{"a": "}]', "[null]"])
def test_other_lists_are_left_to_the_whole_read(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    assert readers._listed_records(spark, str(tmp_path / "t.json")) is None


def test_records_keep_the_columns_of_their_folders(spark, tmp_path, small_splits):
    for part in ("7", "8"):
        (tmp_path / f"part={part}").mkdir()
        (tmp_path / f"part={part}" / "t.json").write_text(json.dumps([{"id": i} for i in range(40)]))
    small_splits(50)
    got = readers.read_json(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("part", "id").collect())) == [(p, i) for p in (7, 8) for i in range(40)]
