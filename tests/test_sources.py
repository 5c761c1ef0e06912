import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tapline.operators.packet_flows import packets_to_flows
from tapline.sources import flows as FL
from tapline.sources import sinks, zeek

CONN_LOG = "#separator \\x09\n#fields\tts\tuid\tnote\n\n1.5\tC1\t-\n2.5\tC2\t\"a\tb\"\"c\"\n3.5\tC3\n#close\n"


@pytest.fixture()
def logs(tmp_path):
    (tmp_path / "conn.log").write_text(CONN_LOG)
    (tmp_path / "dns.log").write_text('{"ts": 1, "id.orig_h": "a", "deep": {"x": [1]}}\n{broken\n[1]\n{"ts": 2, "event_type": "ssl"}\n')
    return tmp_path


def test_tsv(spark, logs):
    got = rows(zeek.read_zeek_tsv(spark, str(logs / "conn.log")), "line_number")
    assert [r["line_number"] for r in got] == [4, 5, 6]
    assert got[0]["raw"] == {"ts": "1.5", "uid": "C1", "note": None, "event_type": "conn"}
    assert got[1]["raw"]["note"] == 'a\tb"c'
    assert got[2]["reject_reason"] == "Zeek TSV line 6 has 2 values; expected 3"


def test_json_and_rejects(spark, logs):
    good, bad = zeek.split_rejects(zeek.read_zeek_json(spark, str(logs / "dns.log")))
    got = rows(good, "line_number")
    assert [r["raw"]["event_type"] for r in got] == ["dns", "ssl"] and json.loads(got[0]["raw"]["deep"]) == {"x": [1]}
    assert [r["reject_reason"] for r in rows(bad, "line_number")] == ["Invalid JSON on line 2", "Zeek record on line 3 is not an object"]


def test_headers_change_within_a_file(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"a": 1}\n#fields\tp\tq\n1\t2\n#fields\tr\n9\n')
    got = rows(zeek.read_zeek(spark, str(tmp_path / "x.log")), "line_number")
    assert [r["raw"] for r in got] == [{"a": "1"}, {"p": "1", "q": "2"}, {"r": "9"}]


def test_line_numbers_over_many_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f'{{"n": {i}, "pad": "{"x" * (i % 60)}"}}\n' for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = zeek.read_zeek_json(spark, str(tmp_path / "big.log"))
        assert zeek.numbered_lines(spark, str(tmp_path / "big.log")).rdd.getNumPartitions() > 1
        assert df.filter(F.col("raw")["n"].cast("long") != F.col("line_number")).count() == 0 and df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_replay_index(spark, logs):
    got = rows(zeek.replay_scan(spark, [str(logs / "dns.log"), str(logs / "conn.log")]), "arrival_seq")
    assert [r["event_id"] for r in got] == ["dns.log:0", "dns.log:1", "conn.log:2", "conn.log:3"]


def test_packet_log_end_to_end(spark, tmp_path):
    head = "#fields\tts\tuid\tsrc\tdst\tsrc_port\tdst_port\tproto\tpayload_len\ttcp_flags\tflow_complete\tflow_start_ts\n"
    body = "100.000001\tD1\t10.0.0.5\t10.0.0.53\t5353\t53\t17\t433\t-\tF\t-\n100.5\tD1\t10.0.0.5\t10.0.0.53\t5353\t53\t17\t-\t-\tT\t100.000001\n"
    bad = "101.0\tD2\t10.0.0.5\t10.0.0.53\t53x\t53\t17\t4\t-\tF\t-\n102.0\tD2\t-\t-\t-\t-\t-\t-\t-\tT\t-\n"
    (tmp_path / "packet.log").write_text(head + body + bad)
    packets = zeek.packet_rows(zeek.replay_scan(spark, [str(tmp_path / "packet.log")]))
    good, broken = rows(packets_to_flows(packets), "flow_id")
    want = {"packet_count": 1, "Protocol": 17, "Destination Port": 53, "Flow Duration": 0, "Total Fwd Packets": 1, "Total Backward Packets": 0}
    assert {k: good[k] for k in want} == want and good["Fwd Packets Length Total"] == 433 and good["Flow Packets/s"] == 0.0
    assert broken["incomplete_reasons"] == ["packet observation has invalid src_port"]


def test_netflow_and_captures(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" StartTime ,SrcAddr,DstAddr,Proto,TotBytes,pkts,Label\n2011/08/10 09:46:53,s,d,tcp,10,x,flow=From-Botnet\n")
    (tmp_path / "b.csv").write_text("SrcAddr,v\ns,1\n")
    (r,) = rows(FL.read_netflow_csv(spark, str(tmp_path / "a.csv")))
    assert (r["timestamp_unix"], r["bytes"], r["pkts"], r["target"], r["flow_dir_reverse"]) == (1312969613.0, 10.0, 0.0, 1, False)
    got = rows(FL.load_captures(spark, [(str(tmp_path / "a.csv"), 1), (str(tmp_path / "b.csv"), 0)]), "source")
    assert [(x["source_file"], x["label"], x["v"]) for x in got] == [("a.csv", 1, None), ("b.csv", 0, "1")]
    assert [x["source"] for x in got] == [str(tmp_path / n) for n in ("a.csv", "b.csv")]


def test_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "sub" / "copy.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3,5\n")
    got = rows(FL.capture_inventory(spark, str(tmp_path)), "source_path")
    assert [(r["rows"], r["columns"], r["identical_files"], r["schema_files"]) for r in got] == [(2, 2, 2, 3), (2, 2, 1, 3), (2, 2, 2, 3)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, ["x"]), ("b", 2.5, [])], "source string, v double, tags array<string>")
    sinks.write_results(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    sinks.write_report(df.select("v", "source").coalesce(1), str(tmp_path / "report"))
    line = next((tmp_path / "report").glob("part-*")).read_text().splitlines()[0]
    assert list(json.loads(line)) == ["source", "v"]
    with pytest.raises(Exception, match="not finite"):
        sinks.write_report(df.withColumn("v", F.lit(float("nan"))), str(tmp_path / "bad"))
    sinks.save_features(df.withColumn("helper", F.lit(1)), str(tmp_path / "features"), ["helper"])
    assert set(spark.read.parquet(str(tmp_path / "features")).columns) == {"v", "tags", "source"}


def test_csv_scoring_restarts_per_file(spark, tmp_path):
    from tapline.operators.rolling import delta_prev

    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("v\n1\n4\n9\n")
    score = lambda df: delta_prev(df.withColumn("v", F.col("v").cast("double")), ["source"], "seq", ["v"])
    sinks.score_csv_to_jsonl(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], str(tmp_path / "out"), score)
    got = rows(spark.read.json(str(tmp_path / "out")).select("source", "seq", "v_delta_prev"), "source", "seq")
    assert [r["v_delta_prev"] for r in got] == [None, 3.0, 5.0] * 2


def test_same_named_files_and_long_lines(spark, tmp_path):
    for name, n in (("a", 2), ("b", 1)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "conn.log").write_text("".join(f'{{"ts": {i}, "pad": "{"x" * 1_100_000}"}}\n' for i in range(n)))
    got = rows(zeek.replay_scan(spark, [str(tmp_path / "b" / "conn.log"), str(tmp_path / "a" / "conn.log")]), "arrival_seq")
    assert [(r["event_id"], r["source_path"]) for r in got] == [
        ("conn.log:0", str(tmp_path / "b" / "conn.log")), ("conn.log:1", str(tmp_path / "a" / "conn.log")), ("conn.log:2", str(tmp_path / "a" / "conn.log"))
    ]
    (tmp_path / "d n+s.log").write_bytes('{"q": "\ufffd"}\n'.encode() + b'{"q": "\xff"}\n')
    good, bad = zeek.split_rejects(zeek.read_zeek_json(spark, str(tmp_path / "d n+s.log")))
    assert good.first().raw["q"] == "\ufffd" and bad.first().reject_reason == "Undecodable text on line 2"
    assert zeek.replay_scan(spark, [str(tmp_path / "d n+s.log")]).count() == 1


def test_csv_scoring_reads_each_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v, w\n1,2\n")
    (tmp_path / "b.csv").write_text("w,v,z\n90,9,x\n")
    sinks.score_csv_to_jsonl(spark, str(tmp_path), str(tmp_path / "out"), lambda df: df)
    got = rows(spark.read.json(str(tmp_path / "out")), "source_file")
    assert [(r["v"], r["w"], r.get("z")) for r in got] == [("1", "2", None), ("9", "90", "x")]


def test_no_csv_line_and_one_scan(spark, tmp_path):
    """An input without a line gives an empty result; several headers are read in one pass."""
    from tapline.sources.sinks import score_csv_to_jsonl

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "empty.csv").write_text("")
    score_csv_to_jsonl(spark, str(tmp_path / "in"), str(tmp_path / "none"), lambda df: df)
    assert spark.read.text(str(tmp_path / "none")).count() == 0
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in" / "b.csv").write_text("y,z\n3,4\n\n5,6\n")
    seen = []
    score_csv_to_jsonl(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda df: seen.append(df) or df.drop("source"))
    assert seen[0].columns == ["source", "source_file", "seq", "x", "y", "z"]
    got = sorted((r.source_file, r.seq, r.x, r.y, r.z) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("a.csv", 2, "1", "2", None), ("b.csv", 2, None, "3", "4"), ("b.csv", 4, None, "5", "6")]
