"""Appended, rotated and cut log files give each line once."""

import os

import pytest

from quillstone.sources import tail
from quillstone.streaming import events as st


@pytest.fixture
def logs(spark, tmp_path, monkeypatch):
    folder = tmp_path / "logs"
    folder.mkdir()
    spark.dataSource.register(tail.TailedLines)

    def run():
        stream = spark.readStream.format("tailed_lines").option("pattern", f"{folder}/app.log*").load()
        return sorted(r["line"] for r in st.run(stream, "append", f"file://{tmp_path}/state").collect())

    return folder, run


def test_appended_rotated_and_cut_files(logs):
    folder, run = logs
    log = folder / "app.log"
    log.write_text("a1\na2\nhalf")
    assert run() == ["a1", "a2"]
    with log.open("a") as f:
        f.write(" line\na4\n")
    assert run() == ["a1", "a2", "a4", "half line"]
    with log.open("a") as f:
        f.write("a5\n")
    os.rename(log, folder / "app.log.1")  # a line was written before, and the new file has another inode
    log.write_text("b1\nb2\n")
    assert run() == ["a1", "a2", "a4", "a5", "b1", "b2", "half line"]
    with log.open("r+") as f:  # cut and written anew, in place
        f.truncate(0)
        f.write("c1\n")
    assert run() == ["a1", "a2", "a4", "a5", "b1", "b2", "c1", "half line"]
    with log.open("r+") as f:  # cut, and longer than before at once
        f.truncate(0)
        f.write("d1 is another line\nd2\n")
    assert run()[-3:] == ["d1 is another line", "d2", "half line"] and len(run()) == 10
    os.remove(folder / "app.log.1")
    assert len(run()) == 10


def test_ranges_split_between_lines(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.log"
    lines = [("é" * (i % 40)) + str(i) for i in range(500)] + ["", "� end"]
    path.write_bytes("\n".join(lines).encode() + b"\nno line feed")
    for size in (1, 7, 64, 1000, 1 << 20):
        monkeypatch.setattr(tail, "RANGE", size)
        parts = tail.ranges({}, tail.look(f"{tmp_path}/x.log", {}))
        got = [(a, x) for p in parts for b in tail.lines_of(p, f"{tmp_path}/x.log") for a, x in zip(b["start"].to_pylist(), b["line"].to_pylist(), strict=True)]
        assert [x for _, x in got] == lines and len({a for a, _ in got}) == len(lines)


def test_a_file_renamed_while_it_is_read(tmp_path):
    path = tmp_path / "y.log"
    path.write_text("one\ntwo\n")
    (part,) = tail.ranges({}, tail.look(f"{tmp_path}/y.log*", {}))
    os.rename(path, tmp_path / "y.log.1")
    path.write_text("other\n")
    assert [b["line"].to_pylist() for b in tail.lines_of(part, f"{tmp_path}/y.log*")] == [["one", "two"]]


def test_batch_read(spark, tmp_path):
    spark.dataSource.register(tail.TailedLines)
    read = lambda: spark.read.format("tailed_lines").option("pattern", f"{tmp_path}/*.log").load()
    assert read().count() == 0
    (tmp_path / "z.log").write_bytes(b"one\r\nbad \xff byte\n")
    assert [(r["start"], r["line"]) for r in read().orderBy("start").collect()] == [(0, "one"), (5, "bad � byte")]
