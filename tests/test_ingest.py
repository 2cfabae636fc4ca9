"""Small files through the readers, the normaliser and the writers."""

import hashlib

import pyarrow as pa
import pytest

from tablewright.sources import dialects, readers, writers
from tablewright.sources import normalize as N
from tablewright.sources.dialects import sniff_delimiter
from tablewright.sources.digests import content_digests


def put(folder, **files):
    """Files by name (a double underscore stands for the dot); the path of the only one, or of the folder."""
    paths = []
    for name, content in files.items():
        paths.append(folder / name.replace("__", "."))
        paths[-1].write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(paths[0] if len(paths) == 1 else folder)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def read(spark, path, fmt=None):
    return readers.ingest(spark, path, fmt=fmt).table


@pytest.mark.parametrize("text,types,want", [
    ("code,mass,open,note\n7,0.25,true,ok\n-3,1e3,FALSE,\n", ["bigint", "double", "boolean", "string"],
     [(-3, 1000.0, False, None), (7, 0.25, True, "ok")]),
    ("pin,day\n007,2021-03-04\n12,05.06.2021\n", ["bigint", "string"], [(7, "2021-03-04"), (12, "05.06.2021")]),
    ('sum\n"12,50"\n3\n', ["string"], [("12,50",), ("3",)]),
    ("big\n123456789012345678901\n1\n", ["string"], [("1",), ("123456789012345678901",)]),
    ("v,w\nNA,n/a\nNULL,none\nx, NA\n", ["string", "string"], [("x", " NA"), (None, "none")]),
])
def test_values_get_the_type_they_all_have(spark, tmp_path, text, types, want):
    table = read(spark, put(tmp_path, t__csv=text))
    assert [t for _, t in table.dtypes] == types
    assert rows(table) == sorted(want, key=str)


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_marks_inside_quotes_do_not_split(spark, tmp_path, mark):
    path = put(tmp_path, t__txt=f'p{mark}q\n"1,;|\t"{mark}2\n"3,;|\t"{mark}4\n')
    done = readers.ingest(spark, path)
    assert rows(done.table) == [("1,;|\t", 2), ("3,;|\t", 4)]
    assert ("delimiter", None, mark) in rows(done.report)


def test_no_candidate_means_comma():
    assert sniff_delimiter(["single", "words"]) == ","
    assert sniff_delimiter(["a;b;c,d", "1;2;3,4", "5;6;7,8"]) == ";"


def test_quoted_line_breaks_stay_in_their_field(spark, tmp_path):
    table = read(spark, put(tmp_path, t__csv='id,note\n1,"first\nsecond"\n2,plain\n3,"a ""b""\n\nc"\n'))
    assert dict(table.dtypes)["id"] == "bigint"
    assert rows(table) == [(1, "first\nsecond"), (2, "plain"), (3, 'a "b"\n\nc')]


def test_header_may_hold_a_line_break(spark, tmp_path):
    assert read(spark, put(tmp_path, t__csv='"two\nlines",b\n1,2\n')).columns == ["two\nlines", "b"]


@pytest.mark.parametrize("line", ["4,x,more", '4,x,,"y,z"', '4,"x,y",more'])
def test_surplus_fields_are_an_error_that_shows_one(spark, tmp_path, line):
    path = put(tmp_path, t__csv=f"id,name\n1,a\n{line}\n2\n")
    with pytest.raises(N.IngestError, match="1 record.*4,"):
        read(spark, path)
    assert rows(readers.surplus_lines(spark, path)) == [(line,)]


def test_short_records_have_gaps(spark, tmp_path):
    assert rows(read(spark, put(tmp_path, t__csv="a,b,c\n1,2,3\n4\n5,6\n"))) == [(1, 2, 3), (4, None, None), (5, 6, None)]


def test_each_file_has_its_own_dialect(spark, tmp_path):
    path = put(tmp_path, a__csv="id,name\n1,ann\n", b__csv="name;id\nbob;2\n", c__csv="id|name\n3|zoë €\n".encode("cp1252"), d__csv="")
    done = readers.ingest(spark, path, fmt="csv")
    assert rows(done.table) == [(1, "ann"), (2, "bob"), (3, "zoë €")]
    found = rows(done.report)
    assert {("delimiter", "a.csv", ","), ("delimiter", "b.csv", ";"), ("encoding", "c.csv", "cp1252")} <= set(found)


@pytest.mark.parametrize("second", ["id,surname\n2,b\n", "id,name,age\n2,b,3\n"])
def test_files_of_other_columns_are_refused(spark, tmp_path, second):
    with pytest.raises(N.IngestError, match="different columns"):
        read(spark, put(tmp_path, a__csv="id,name\n1,a\n", b__csv=second), "csv")


@pytest.mark.parametrize("data,encoding,name", [
    ("naïve – 3 €".encode("cp1252"), "cp1252", "naïve – 3 €"), (b"na\xefve \x9d", "latin-1", "naïve \x9d"),
    ("naïve 東京".encode(), "utf-8", "naïve 東京"),
])
def test_encodings(spark, tmp_path, data, encoding, name):
    done = readers.ingest(spark, put(tmp_path, t__csv=b"what,n\n" + data + b",1\n"))
    assert done.table.first()["what"] == name
    steps = rows(done.report)
    assert ("encoding", None, encoding) in steps
    assert any(s[0] == "warning" for s in steps) == (encoding != "utf-8")


def test_byte_order_mark_is_no_part_of_the_first_name(spark, tmp_path):
    assert read(spark, put(tmp_path, t__csv="﻿größe,цена\n1,2\n")).columns == ["größe", "цена"]


@pytest.mark.parametrize("given,want", [
    (["x", "x", "x "], ["x", "x_2", "x_3"]), (["a", "a_2", "a"], ["a", "a_2", "a_3"]), (["a", "a", "a_2"], ["a", "a_3", "a_2"]),
    (["", " ", "column_2"], ["column_1", "column_2", "column_2_2"]), (["Id", "ID"], ["Id", "ID_2"]),
])
def test_repaired_names_are_free(given, want):
    names, notes = N.repair_names(given)
    assert names == want
    assert [n[1] for n in notes] == [w for g, w in zip(given, want) if g != w]


def test_repeated_names_reach_a_table(spark, tmp_path):
    table = read(spark, put(tmp_path, t__csv="a,a_2,a\n1,2,3\n"))
    assert (table.columns, rows(table)) == (["a", "a_2", "a_3"], [(1, 2, 3)])


def test_empty_rows_and_columns_go_with_a_note(spark, tmp_path):
    done = readers.ingest(spark, put(tmp_path, t__csv=" left ,right,,\n5,,,\n,,,\n,6,,\n"))
    assert rows(done.table) == [(5, None), (None, 6)]
    notes = {(s, c) for s, c, _ in rows(done.report)}
    assert {("renamed", "left"), ("dropped", "column_3"), ("dropped", "column_4"), ("dropped", None)} <= notes


@pytest.mark.parametrize("text,columns,want", [
    ('[{"k":1,"in":{"deep":{"er":"x"}}},{"k":2}]', ["in.deep.er", "k"], [("x", 1), (None, 2)]),
    ('{"meta":"m","items":[{"k":1},{"k":2}]}', ["k"], [(1,), (2,)]),
    ('{"k":[1,2],"v":["p","q"]}', ["k", "v"], [(1, "p"), (2, "q")]),
])
def test_json_documents(spark, tmp_path, text, columns, want):
    table = read(spark, put(tmp_path, t__json=text))
    assert sorted(table.columns) == columns
    assert rows(table.select(*[f"`{c}`" for c in columns])) == want


def test_json_lines_parquet_and_schema(spark, tmp_path):
    table = read(spark, put(tmp_path, t__jsonl='{"k":1,"v":[1,2]}\n{"k":2,"v":null}\n'))
    assert rows(table) == [(1, "[1,2]"), (2, None)]
    path = str(tmp_path / "t.parquet")
    writers.write_table(table, path)
    assert rows(readers.read_table(spark, path)[0]) == rows(table)
    assert readers.columns_of_table(spark, path) == ["k", "v"]
    assert rows(readers.load_columns(spark, path, ["v"])) == [("[1,2]",), (None,)]


@pytest.mark.parametrize("name,content,says", [
    ("t__docx", "x", "Unsupported"), ("t__csv", "", "empty"), ("t__csv", "h1,h2\n", "holds a value"), ("t__json", "true", "JSON"),
    ("t__json", '{"a":[1],"b":[1,2]}', "different lengths"),
])
def test_refusals(spark, tmp_path, name, content, says):
    with pytest.raises(N.IngestError, match=says):
        read(spark, put(tmp_path, **{name: content}))


def test_nan_decimals_and_lists_become_storable(spark):
    frame = spark.sql("SELECT 1 AS i, double('NaN') AS x, 2.50BD AS d, map('k', 1) AS m UNION ALL SELECT 2, 0.5, 1BD, NULL")
    table = N.normalize(frame).table
    assert [t for _, t in table.dtypes] == ["int", "double", "double", "string"]
    assert rows(table) == [(1, None, 2.5, '{"k":1}'), (2, 0.5, 1.0, None)]


def test_fingerprints(spark, tmp_path, monkeypatch):
    path = put(tmp_path, t__csv="a\n1\n")
    assert rows(readers.fingerprint(spark, path).select("bytes", "sha256")) == [(4, hashlib.sha256(b"a\n1\n").hexdigest())]
    monkeypatch.setattr(readers, "HASHED_BYTES", 3)  # as a file that is too large to be one value
    (large,) = rows(readers.fingerprint(spark, path).select("bytes", "sha256", "tree_sha256"))
    block = hashlib.sha256(b"a\n1\n").hexdigest()
    assert large == (4, None, hashlib.sha256(hashlib.sha256(block.encode()).hexdigest().encode()).hexdigest())


@pytest.mark.parametrize("ending", ["", "\n", "\n\n"])
def test_content_hash_goes_by_content_alone(spark, tmp_path, ending):
    data = ("\n".join("é" * (i % 50) + "\r" * (i % 3) for i in range(900)) + ending).encode()
    (tmp_path / "t.bin").write_bytes(data)
    blocks = [hashlib.sha256(data[i:i + 1_000]).hexdigest() for i in range(0, len(data), 1_000)]
    groups = [hashlib.sha256("".join(blocks[i:i + 7]).encode()).hexdigest() for i in range(0, len(blocks), 7)]
    want = hashlib.sha256("".join(groups).encode()).hexdigest()
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {k: spark.conf.get(k) for k in names}
    try:
        for size in (3_001, 100_000):
            for k in names:
                spark.conf.set(k, str(size))
            found = content_digests(spark, str(tmp_path / "t.bin"), 1_000, 7).collect()
            assert [r["tree_sha256"] for r in found] == [want]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_text_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("ü, \"x\"\ny", None)], "name string, v int").coalesce(1)
    for write, mark in ((writers.write_csv, "﻿"), (writers.write_predictions, "")):
        path = str(tmp_path / write.__name__)
        write(frame, path)
        (part,) = (tmp_path / write.__name__).glob("part-*.csv")
        assert part.read_text(encoding="utf-8") == mark + 'name,v\n"ü, ""x""\ny",\n'
    writers.write_report(frame, str(tmp_path / "report"))
    assert rows(spark.read.json(str(tmp_path / "report"), schema=frame.schema)) == rows(frame)


def test_a_stored_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    writers.write_table(spark.range(5), path)
    writers.write_table(spark.read.parquet(path).where("id > 1"), path)  # from itself
    assert rows(spark.read.parquet(path)) == [(2,), (3,), (4,)]
    with pytest.raises(Exception, match="on the way"):
        writers.write_table(spark.range(100).repartition(4).selectExpr("if(id = 77, cast(raise_error('on the way') as bigint), id) AS id"), path)
    assert rows(spark.read.parquet(path)) == [(2,), (3,), (4,)]
    assert [p.name for p in tmp_path.iterdir()] == ["t.parquet"]  # nothing is left beside it


def test_dialects_look_at_the_first_lines_alone(spark, tmp_path):
    """Later lines are passed by where they are read; a null would fail if it were looked at."""
    path = put(tmp_path, a__csv='"x\n' + "y\n" * 3_000 + '",b\n' + "1,2\n" * 3_000, b__csv="a;b\n" + "1;2,0\n" * 3_000)
    wide = ("x\n" + "y\n" * 3_000, "b")
    assert [(d.delimiter, d.header) for d in dialects.dialects(spark, path)] == [(",", wide), (";", ("a", "b"))]
    lines = [b"a;b"] + [b"1;2,0"] * (dialects.HEAD_LINES - 1) + [None] * 5_000
    batches = [pa.RecordBatch.from_arrays([pa.array(["f"] * 100), pa.array(lines[i:i + 100])], ["file", "value"]) for i in range(0, 6_000, 100)]
    batches.append(pa.RecordBatch.from_arrays([pa.array(["g"]), pa.array([b"c,d"])], ["file", "value"]))
    found = [b.to_pylist()[0] for b in dialects._look(None)(iter(batches))]
    assert found == [{"file": "f", "delimiter": ";", "header": ["a", "b"]}, {"file": "g", "delimiter": ",", "header": ["c", "d"]}]
