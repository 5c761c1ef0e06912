"""Live logs that grow, rotate and are cut: every line once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tapline.sources.tail import TailReader, last_line_end, tail_records

HEADER = "#separator \\x09\n#fields\tts\tuid\tnote\n"


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    return folder


def append(path, text):
    with open(path, "ab") as file:
        file.write(text if isinstance(text, bytes) else text.encode())


def run(spark, logs, tmp_path, names=("conn.log", "dns.log"), start="end"):
    """One micro-batch of all that is there; what came out of all runs so far."""
    out = str(tmp_path / "out")
    frame = tail_records(spark, str(logs), list(names), start)
    frame = frame.select("source_file", "byte_offset", "arrival_seq", F.col("raw")["uid"].alias("uid"), F.col("raw")["note"].alias("note"), "reject_reason")
    query = frame.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.schema(frame.schema).parquet(out).collect()


def test_every_line_once(spark, logs, tmp_path):
    conn, dns = logs / "conn.log", logs / "dns.log"
    append(conn, HEADER + "1\tOLD\tx\n")
    assert run(spark, logs, tmp_path) == []  # what was there before the first start is not replayed
    append(conn, "2\tC2\tx\n3\tC3")  # the second line is not whole yet
    append(dns, '{"uid": "D1", "ts": 5}\n')
    seen = lambda: sorted(r.uid for r in run(spark, logs, tmp_path))
    assert seen() == ["C2", "D1"]
    append(conn, "\tx\n4\tC4\tx\n")
    os.rename(conn, logs / "conn.log.1")  # rotated before its last lines were read
    append(conn, "#fields\tuid\tnote\nC5\ty\nC6\n")
    got = run(spark, logs, tmp_path)
    assert sorted(r.uid for r in got if r.uid) == ["C2", "C3", "C4", "C5", "D1"]
    assert [r.reject_reason for r in got if not r.uid] == ["Zeek TSV line @22 has 1 values; expected 2"]
    fresh = {r.uid: r.arrival_seq for r in got if r.uid in ("C3", "C4", "C5")}
    assert fresh["C3"] < fresh["C4"] < fresh["C5"]
    dns.write_text('{"uid": "D2"}\n')  # cut and shorter
    append(conn, "C7\tz\n")
    assert [u for u in sorted(r.uid or "" for r in run(spark, logs, tmp_path)) if u in ("C7", "D2")] == ["C7", "D2"]
    dns.write_text('{"uid": "D3", "much": "longer than the one before"}\n')  # cut, yet longer
    assert len(run(spark, logs, tmp_path)) == 9
    assert len(run(spark, logs, tmp_path)) == 9


def test_copies_and_bad_bytes(spark, logs, tmp_path):
    dns = logs / "dns.log"
    append(dns, '{"uid": "D1"}\r\n')
    assert [r.uid for r in run(spark, logs, tmp_path, start="beginning")] == ["D1"]
    shutil.copy(dns, logs / "dns.log.1")  # copied, then cut
    dns.write_bytes(b'{"uid": "\xff"}\n\n# remark\n{"uid": "D2"}\n')
    got = run(spark, logs, tmp_path, start="beginning")
    assert sorted((r.uid or "", r.reject_reason) for r in got) == [("", "Undecodable text on line @0"), ("D1", None), ("D2", None)]


def test_long_waiting_line(logs):
    path = logs / "conn.log"
    append(path, b"a\n" + b"x" * 200_000)
    assert last_line_end(path) == 2
    append(path, b"\n")
    assert last_line_end(path) == 200_003
    reader = TailReader({"path": str(logs), "names": "conn.log"})
    end = reader.latestOffset()
    assert reader.initialOffset() == end
    part = reader.partitions({}, end)[0]
    assert [b.column("content").to_pylist() for b in reader.read(part)] == [[b"a", b"x" * 200_000]]
    os.remove(path)
    assert list(reader.read(part)) == [] and reader.partitions(end, reader.latestOffset())[0].path == ""
