"""Delimited files of several dialects in one folder."""

import random

import pytest

from docframe.sources import files as FS


def test_every_file_of_a_folder_has_its_own_dialect(spark, tmp_path):
    late = [(f"name {i}", "plain") for i in range(2_000)] + [("last", "café€")]
    cases = {
        "a.csv": "x,1\n".encode(),
        "b [1].csv": "y;2,5\nz;3\n".encode(),
        "c.csv": "".join(f"{a}|{b}\n" for a, b in late).encode("cp1252"),
        "d.csv": "".join(f"{a}\t{b}\n" for a, b in late).encode(),
        "e.csv": b"\xfe\xff" + "u;€\n".encode("utf-16-be"),
        "f.csv": b"",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    df = FS.read_delimited_auto(spark, [str(tmp_path)], columns=["a", "b"])
    want = [("x", "1"), ("y", "2,5"), ("z", "3"), *late, *late, ("u", "€")]
    assert sorted((r.a, r.b) for r in df.collect()) == sorted(want)


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    assert FS.read_delimited_auto(spark, [str(tmp_path)], columns=["a", "b"]).collect() == []


def plain_records(text, sep):
    """Records and fields of a delimited text, one character at a time."""
    rows, row, field, quoted, was = [], [], "", False, False
    i = 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                field += c
        elif c == '"' and field == "" and not was:
            quoted = was = True
        elif c == sep:
            row, field, was = [*row, field], "", False
        elif c in "\r\n":
            rows, row, field, was = [*rows, [*row, field]], [], "", False
        else:
            field += c
        i += 1
    rows.append([*row, field])
    return [[f or None for f in r] for r in rows if r != [""]]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_quoted_line_breaks_across_blocks(spark, tmp_path, split):
    """A file cut at any place, inside quoted line breaks too, gives the records of one reading task."""
    rng = random.Random(split)
    fields = ["plain", 'say "hi"', "a;b", "two\nlines", "x\n\n;y\n" * 9, 'end"', "é€", 'mid"dle', "ret\rurn", "1"]
    texts = {}
    for name, end in (("unix", "\n"), ("dos", "\r\n"), ("mac", "\r")):
        quoted = lambda f: '"' + f.replace('"', '""') + '"'
        rows = [[rng.choice(fields) for _ in range(3)] for _ in range(150)]
        texts[name] = end.join(";".join(f if f in ("plain", 'mid"dle', "1") else quoted(f) for f in r) for r in rows) + end * rng.randrange(3)
        (tmp_path / f"{name}.csv").write_bytes(texts[name].encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = FS.read_delimited_auto(spark, [str(tmp_path)], columns=["a", "b", "c"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [tuple(r) for t in texts.values() for r in plain_records(t, ";")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_all_bytes_of_windows_1252(spark, tmp_path):
    rows = [(b, bytes([b])) for b in range(256) if b not in (0, 9, 10, 13, 34, 44, 59, 124)]
    (tmp_path / "a.csv").write_bytes(b"\n".join(b"%d,<%s>" % r for r in rows))
    got = {int(r.a): r.b[1:-1] for r in FS.read_delimited_auto(spark, [str(tmp_path)], columns=["a", "b"]).collect()}
    assert got == {b: (c.decode("cp1252", errors="ignore") or chr(b)) for b, c in rows}


def test_names_from_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,"first\nname"\n1,x\n')
    (tmp_path / "b.csv").write_bytes(b'id,"first\nname"\n2,y\n')
    (tmp_path / "c.csv").write_bytes("﻿id\tother\n3\tz\n".encode())
    df = FS.read_delimited_auto(spark, [str(tmp_path)], header=True)
    assert sorted(map(str, (r.asDict() for r in df.collect()))) == sorted(
        map(str, [{"id": "3", "other": "z", "first\nname": None}, {"id": "1", "other": None, "first\nname": "x"}, {"id": "2", "other": None, "first\nname": "y"}])
    )
    assert FS.read_delimited_auto(spark, [str(tmp_path / "a.csv")]).columns == ["_c0", "_c1"]


def test_only_heads_are_read(spark, tmp_path):
    for name, size in (("a.pdf", 200_000), ("b c%20.xlsx", 10), ("sub/d.csv", 0)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes((b"%PDF-1.7" + bytes(range(256)) * 800)[:size])
    rows = {r.path.rsplit("/", 1)[1]: r for r in FS.read_heads(spark, str(tmp_path)).collect()}
    assert {k: (r.length, len(r.head)) for k, r in rows.items()} == {"a.pdf": (200_000, 65_536), "b c%20.xlsx": (10, 10)}
    assert [r.head for r in FS.read_heads(spark, str(tmp_path), "*.pdf", head=5).collect()] == [b"%PDF-"]


def test_files_are_written_and_listed_in_executors(spark, tmp_path):
    rows = [(f"doc {i}.csv", bytes([i % 256]) * i) for i in range(50)] + [("a%20b.gz", b"gz"), ("null.txt", None)]
    written = FS.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "out"))
    want = {n: c or b"" for n, c in rows}
    assert {r.path.rsplit("/", 1)[1]: r.length for r in written.collect()} == {n: len(c) for n, c in want.items()}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == want
    (tmp_path / "out" / "_SUCCESS").write_bytes(b"x")
    listed = FS.list_files(spark, str(tmp_path / "out"))
    assert {r.path.rsplit("/", 1)[1]: r.length for r in listed.collect()} == {n: len(c) for n, c in want.items()}
    heads = FS.read_heads(spark, str(tmp_path / "out"), head=3)
    assert {r.path.rsplit("/", 1)[1]: r.head for r in heads.collect()} == {n: c[:3] for n, c in want.items() if c}
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan  # Spark's own listing keeps every name in the driver
    one = FS.list_files(spark, str(tmp_path / "out" / "_SUCCESS")).collect()
    assert [r.length for r in one] == [1]


@pytest.mark.parametrize("glob", ["*.csv", "doc ?.csv", "doc [1-3]*.csv", "*.{gz,txt}", "doc [^1]*", r"a\%20b.*"])
def test_file_name_patterns_are_those_of_spark(spark, tmp_path, glob):
    rows = [(f"doc {i}.csv", b"x") for i in range(1, 25)] + [("a%20b.gz", b"gz"), ("null.txt", b"n"), ("x,y.csv", b"n")]
    FS.write_files(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "out"))
    want = sorted(r.path for r in FS.read_files(spark, str(tmp_path / "out"), glob).select("path").collect())
    assert want and sorted(r.path for r in FS.list_files(spark, str(tmp_path / "out"), glob).collect()) == want
