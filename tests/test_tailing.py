import os

from tidewatch.sources.tailing import GrowingFilesReader, Part, stream_growing_files


def lines_between(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            out += batch.column("line").to_pylist()
    return out


def test_appended_rotated_and_restarted_files(spark, tmp_path):
    log, pattern = tmp_path / "app.log", str(tmp_path / "app.log*")
    inbox = str(tmp_path / "cp"), str(tmp_path / "out")

    def run():
        rows = stream_growing_files(spark, pattern).writeStream.format("parquet")
        rows.option("checkpointLocation", inbox[0]).option("path", inbox[1]).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(inbox[1]).collect())

    log.write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]  # the third line is not yet complete
    with log.open("a") as file:
        file.write("ee\nfour\n")
    assert run() == ["four", "one", "three", "two"]
    with log.open("a") as file:
        file.write("five\n")
    os.rename(log, tmp_path / "app.log.1")  # goes on under its new name
    log.write_text("one again, in a new file\n")
    assert run() == ["five", "four", "one", "one again, in a new file", "three", "two"]
    assert len(run()) == 6


def test_rotation_without_a_new_name(tmp_path):
    log = tmp_path / "a.log"
    reader = GrowingFilesReader(str(tmp_path / "*.log"))
    assert reader.latestOffset() == {}
    log.write_text("x 1\nx 2\n")
    first = reader.latestOffset()
    assert lines_between(reader, {}, first) == ["x 1", "x 2"]
    log.write_text("y 1\n")  # written anew, and shorter
    second = reader.latestOffset()
    assert lines_between(reader, first, second) == ["y 1"]
    log.write_text("y 1\ny 2\n")
    assert lines_between(reader, second, reader.latestOffset()) == ["y 2"]
    log.unlink()
    assert lines_between(reader, second, reader.latestOffset()) == []


def test_parts_hold_each_line_once(tmp_path):
    log = tmp_path / "a.log"
    lines = [f"line {i} " + "é" * (i % 50) for i in range(500)]
    log.write_text("\n".join(lines) + "\n\n\xff".encode("latin-1").decode("latin-1") + "tail without end")
    reader = GrowingFilesReader(str(tmp_path / "a.log"))
    end = reader.latestOffset()[str(log)]["end"]
    for cuts in ([0, end], [0, 1, 2, 3, end], list(range(0, end, 97)) + [end]):
        got = []
        for a, b in zip(cuts, cuts[1:]):
            for batch in reader.read(Part(str(log), 0, a, b)):
                got += batch.column("line").to_pylist()
        assert got == [*lines, ""]
