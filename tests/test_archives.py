"""ZIP archives: directories with pushed filters, members and lines by shares, rows by place, and bad archives as rows."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewise.sources import archives, files


def packed(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(zipfile.ZipInfo(name), content, compress_type=method)
    return path


def text(n, blank=7):
    return "".join("\r\n" if i % blank == 3 else f"row {i} é{'x' * (i % 50)}\r\n" if i % 2 else f"row {i}\n" for i in range(n))


@pytest.fixture()
def folder(tmp_path):
    """Three archives with stored, deflated and bzip2 members, a folder, an empty member, and text without an end."""
    packed(tmp_path / "b.zip", {"2.jsonl": text(900), "1.jsonl": text(400)}, zipfile.ZIP_STORED)
    packed(tmp_path / "a.zip", {f"m/{k:03d}.jsonl": text(k) + "no end" for k in range(60)} | {"m/": "", "e.jsonl": "", "i.png": b"\x89" * 3000})
    packed(tmp_path / "c.zip", {"x.jsonl": text(5000)}, zipfile.ZIP_BZIP2)
    return str(tmp_path)


def want_lines(folder, suffix=".jsonl"):
    out, place = [], 0
    for a in ("a", "b", "c"):
        with zipfile.ZipFile(f"{folder}/{a}.zip") as z:
            for m in sorted(n for n in z.namelist() if n.endswith(suffix)):
                for n, line in enumerate(io.BytesIO(z.read(m)), 1):
                    if line.strip():
                        out.append((a, m, n, place, line.decode().rstrip("\n").removesuffix("\r")))
                        place += 1
    return out


def got_lines(rows):
    name = F.regexp_extract("archive", r"(\w)\.zip$", 1)
    return [tuple(r) for r in rows.select(name, "member", "line", "row_index", "value").orderBy("row_index").collect()]


def test_directory_pushes_filters(spark, folder):
    rows = archives.directory(spark, folder)
    assert rows.count() == 65 and rows.where("error IS NOT NULL").count() == 0
    assert {r["member"] for r in rows.where("member IN ('e.jsonl', 'x.jsonl')").collect()} == {"e.jsonl", "x.jsonl"}
    assert rows.where(F.col("member").endswith(".png")).first()["size"] == 3000
    assert rows.where(F.col("archive").endswith("/b.zip")).count() == 2
    plan = rows.where("member = 'e.jsonl'")._jdf.queryExecution().executedPlan().toString()
    assert "e.jsonl" not in plan  # the scan has taken the comparison


@pytest.mark.parametrize("task_bytes", [archives.TASK_BYTES, 4000])
def test_lines_by_shares(spark, folder, task_bytes):
    members = archives.directory(spark, folder).where(F.col("member").endswith(".jsonl"))
    index = archives.line_index(members, task_bytes)
    want = want_lines(folder)
    rows = archives.lines(index, task_bytes=task_bytes)
    assert got_lines(rows) == want
    if task_bytes == 4000:
        assert index.where("member = '2.jsonl'").count() > 3 and rows.rdd.getNumPartitions() > 3
    for limit in (1, 777):
        assert got_lines(archives.lines(index, limit, task_bytes)) == want[:limit]


def test_first_rows_open_few_members(spark, folder):
    """A limit and a request read only the shares that hold their rows: a member that would raise is not opened."""
    members = archives.directory(spark, folder).where(F.col("member").endswith(".jsonl"))
    index = archives.line_index(members)
    broken = index.withColumn("offset", F.when(F.col("member").isin("m/002.jsonl", "m/003.jsonl"), F.col("offset")).otherwise(F.lit(1)))
    want = want_lines(folder)
    inside = [w[3] for w in want if w[1] in ("m/002.jsonl", "m/003.jsonl")]
    asked = spark.createDataFrame([(i, k) for k, i in enumerate([*inside[::-1], inside[0], 10**9])], "row_index long, position int")
    got = archives.rows_at(broken, asked).orderBy("position").collect()
    assert [(r["row_index"], r["value"]) for r in got] == [(i, want[i][4]) for i in [*inside[::-1], inside[0]]]
    with pytest.raises(Exception, match="offset"):
        archives.lines(broken).count()
    first = index.withColumn("offset", F.when(F.col("first_row") < 2, F.col("offset")).otherwise(F.lit(1)))
    assert got_lines(archives.lines(first, 2)) == want[:2]


def test_requests_over_many_runs_of_places(spark, folder, monkeypatch):
    monkeypatch.setattr(archives, "PLACES", 100)
    index = archives.line_index(archives.directory(spark, folder).where(F.col("member").endswith(".jsonl")), 4000)
    want = want_lines(folder)
    asked = spark.createDataFrame([(i, i) for i in range(0, len(want) + 500, 37)], "row_index long, position long")
    assert sorted((r["row_index"], r["value"]) for r in archives.rows_at(index, asked).collect()) == [(w[3], w[4]) for w in want[::37]]


def test_contents(spark, folder):
    members = archives.directory(spark, folder)
    for task_bytes in (archives.TASK_BYTES, 2000):
        rows = archives.contents(members, task_bytes)
        for r in rows.collect():
            with zipfile.ZipFile(r["archive"].removeprefix("file:")) as z:
                assert r["error"] is None and z.read(r["member"]) == r["content"] and len(r["content"]) == r["size"]
    assert rows.rdd.getNumPartitions() > 3
    assert files.read_zip_members(spark, folder).count() == 65


def test_bad_archives_are_rows(spark, folder, tmp_path):
    (tmp_path / "d.zip").write_bytes(b"no archive")
    whole = packed(tmp_path / "e.zip", {"a.jsonl": "1\n" * 50, "b.jsonl": "2\n"}, zipfile.ZIP_STORED).read_bytes()
    (tmp_path / "e.zip").write_bytes(whole.replace(b"1\n1\n1\n", b"1\n3\n1\n", 1))
    packed(tmp_path / "f.zip", {"l.jsonl": "1\n"}, zipfile.ZIP_LZMA)
    rows = archives.directory(spark, folder)
    errors = {(r["archive"][-5:], r["member"]): r["error"] for r in archives.contents(rows).where("error IS NOT NULL").collect()}
    assert errors.keys() == {("d.zip", None), ("e.zip", "a.jsonl"), ("f.zip", "l.jsonl")}
    assert "BadZipFile" in errors["d.zip", None] and "checksum" in errors["e.zip", "a.jsonl"] and "method 14" in errors["f.zip", "l.jsonl"]
    index = archives.line_index(rows.where(F.col("member").endswith(".jsonl") | F.col("error").isNotNull()))
    assert index.where("error IS NOT NULL").count() == 3
    assert got_lines(archives.lines(index).where("archive NOT LIKE '%e.zip'")) == want_lines(folder)
    with pytest.raises(Exception, match="checksum|BadZipFile|method 14"):
        files.indexed_zip_lines(spark, folder).count()
    with pytest.raises(Exception, match="BadZipFile"):
        files.read_zip_members(spark, str(tmp_path / "d.zip")).count()
    assert archives.directory(spark, str(tmp_path / "none*.zip")).count() == 0


def test_packed_far_beyond_its_size(spark, tmp_path):
    """60 MB of one letter, in a few KB."""
    packed(tmp_path / "z.zip", {"big.jsonl": b"a" * 60_000_000 + b"\nlast"})
    rows = files.indexed_zip_lines(spark, str(tmp_path / "z.zip"))
    assert [(r[0], r[1]) for r in rows.select("line", F.length("value")).orderBy("line").collect()] == [(1, 60_000_000), (2, 4)]


def test_written_archives(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"i": i})) for i in range(300)], "i long, t string").repartition(7)
    archives.write(rows, f"file://{tmp_path}/out", F.concat(F.lit("p"), F.col("i") % 4), F.format_string("%04d.json", F.col("i")), F.col("t"), F.col("i") % 2 == 0)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["p0.zip", "p1.zip", "p2.zip", "p3.zip"]
    with zipfile.ZipFile(tmp_path / "out" / "p3.zip") as z:
        assert z.testzip() is None and z.namelist() == [f"{i:04d}.json" for i in range(3, 300, 4)]
    again = (tmp_path / "out" / "p3.zip").read_bytes()
    archives.write(rows, f"file://{tmp_path}/out2", F.concat(F.lit("p"), F.col("i") % 4), F.format_string("%04d.json", F.col("i")), F.col("t"), F.col("i") % 2 == 0)
    assert (tmp_path / "out2" / "p3.zip").read_bytes() == again
