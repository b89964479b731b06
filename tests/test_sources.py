"""Capture files and table sinks on small files written here."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from wiretally.plans import posture
from wiretally.sources import captures, tables


def _v6_fragment(offset, more, data):
    src, dst = bytes.fromhex("fd30" + "0" * 26 + "02"), bytes.fromhex("fd30" + "0" * 26 + "03")
    frag = struct.pack("!BBHI", 50, 0, offset << 3 | more, 1234)
    head = struct.pack("!IHBB", 0x60000000, len(frag) + len(data), 44, 64)
    return b"\xff" * 6 + b"\0" * 6 + b"\x86\xdd" + head + src + dst + frag + data


def _pcap(frames, order="<"):
    out = struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts, f in frames:
        out += struct.pack(order + "IIII", int(ts), int(ts % 1 * 1e6), len(f), len(f)) + f
    return out


def _pcapng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for ts, f in frames:
        us = int(ts * 1e6)
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


FRAMES = [(1, _v6_fragment(0, 1, struct.pack("!II", 0x12345678, 1) + b"a" * 24)), (2, _v6_fragment(4, 0, b"b" * 16)), (3, b"\0" * 20)]


@pytest.mark.parametrize("name,make", [("a.pcap", _pcap), ("b.pcap", lambda f: _pcap(f, ">")), ("c.pcapng", _pcapng)])
def test_fragments_of_ipv6_esp(spark, tmp_path, name, make):
    (tmp_path / name).write_bytes(make(FRAMES) + b"\x01\x02")
    rows = captures.read_packets(spark, str(tmp_path)).orderBy("packet_no").collect()
    assert [(r.ip_proto, r.src, r.length) for r in rows] == [(50, "fd30::2", 80), (44, "fd30::2", 64)]
    assert bytes(rows[0].payload)[:8] == struct.pack("!II", 0x12345678, 1)
    assert rows[0].capture_id.endswith(f"/{name}") and rows[1].ts_us == 2_000_000


def test_captures_of_like_names_stay_apart(spark, tmp_path):
    names = ["a/capture.pcap", "b/capture.pcap", "cap12", "cap13", "s1.pcap0", "s1.pcap1"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(_pcap(FRAMES))
    rows = captures.read_frames(spark, str(tmp_path)).select("capture_id", "frame_no").collect()
    assert len(rows) == len(set(rows)) == len(names) * len(FRAMES)


def test_catalog_keeps_one_of_equal_files(spark, tmp_path):
    for n in ("x.pcap", "y.pcap"):
        (tmp_path / n).write_bytes(_pcap(FRAMES))
    (tmp_path / "z.pcap").write_bytes(_pcap(FRAMES[:1]))
    rows = captures.read_catalog(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(r.stored_name == f"{r.sha256}.pcapng" for r in rows)


def test_manifests_and_profiles(spark, tmp_path):
    (tmp_path / "s" / "a").mkdir(parents=True)
    doc = {"session_id": "a", "profile": "p01", "traffic_type": "web", "labels": {"mode": "tunnel", "pfs": True}, "pcap": "a.pcapng",
           "gateway_evidence": {"before": [{"mode": "tunnel", "spis": ["0x1"]}], "rekey": {"status": "observed", "child": {"dh_group": 31, "spis": ["0x2"]}}}}
    (tmp_path / "s" / "a" / "manifest.json").write_text(json.dumps(doc, indent=1))
    r = tables.read_manifests(spark, str(tmp_path / "s")).first()
    assert (r.session_id, r.labels.mode, r.gateway_evidence.rekey.child.dh_group) == ("a", "tunnel", 31) and r.manifest_at > 0
    (tmp_path / "p").mkdir()
    for i in ("p02", "p01"):
        (tmp_path / "p" / f"{i}.json").write_text(json.dumps({"id": i, "pfs": True, "traffic": ["web"]}))
    assert [r.id for r in tables.read_profiles(spark, str(tmp_path / "p")).collect()] == ["p01", "p02"]
    (tmp_path / "p" / "bad.json").write_text(json.dumps({"id": "p03", "colour": 1}))
    with pytest.raises(ValueError, match="colour"):
        tables.read_profiles(spark, str(tmp_path / "p"))


def test_rule_packs_are_checked(spark, tmp_path):
    assert posture.read_rules(spark, "baseline").count() == 17 and posture.read_rules(spark, "cnsa2").count() == 5
    (tmp_path / "r.yaml").write_text("- {id: X, title: t, category: c, when: 'true', severity: awful, likelihood: 1, refs: [], fix: f}\n")
    with pytest.raises(ValueError, match="severity"):
        posture.load_pack(str(tmp_path / "r.yaml"))
    (tmp_path / "q.yaml").write_text("- {id: X, title: t}\n")
    with pytest.raises(ValueError, match="lacks"):
        posture.load_pack(str(tmp_path / "q.yaml"))


def test_alerts_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = spark.range(5).select(F.concat(F.lit("al_"), F.col("id").cast("string")).alias("id"), F.lit(1.0).alias("timestamp"))
    tables.append_alerts(rows.unionByName(rows), path)
    tables.append_alerts(rows.unionByName(spark.createDataFrame([("al_9", 2.0)], "id string, timestamp double")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["al_0", "al_1", "al_2", "al_3", "al_4", "al_9"]


def test_report_sinks_and_refresh(spark, tmp_path):
    f = spark.createDataFrame([("an_1", "R", "t", "c", "high", 0.5, 0.5, ["a", "b"], "fix"), ("an_2", "R", "t", "c", "low", 0.5, 0.5, [], "")],
                              "analysis_id string, rule_id string, title string, category string, severity string, likelihood double, confidence double, refs array<string>, fix string")
    tables.write_findings_csv(f, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv")).orderBy("severity").collect()
    assert back[0].refs == "a; b" and len(back[0]) == 8
    tables.write_report(f.select("analysis_id").distinct().withColumn("grade", F.lit("A")), str(tmp_path / "rep"), findings=f)
    assert spark.read.json(str(tmp_path / "rep" / "findings")).count() == 2
    tables.write_features(f, str(tmp_path / "feat"), "analysis_id")
    assert tables.read_features(spark, str(tmp_path / "feat")).count() == 2

    def report(i, n):
        doc = {"analysis_id": i, "security_score": 50, "sas": [{"spi": "0x1"}], "traffic_windows": [], "findings": [{"rule_id": "R", "severity": "low"}] * n}
        return spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.from_json("j", tables.REPORT_SCHEMA).alias("r")).select("r.*")
    for i, n in (("an_1", 2), ("an_2", 1), ("an_1", 3)):
        tables.refresh_tables(report(i, n), str(tmp_path / "db"))
    got = {r.analysis_id: r["count"] for r in spark.read.parquet(str(tmp_path / "db" / "finding")).groupBy("analysis_id").count().collect()}
    assert got == {"an_1": 3, "an_2": 1}


def test_report_rows_keep_the_later_of_two_sas_and_what_rows_carry(spark):
    doc = {"analysis_id": "an_1", "sas": [{"spi": "0x1", "enc": "AES-CBC"}, {"spi": "0x1", "enc": "AES-GCM-16"}, {"spi": "0x2"}],
           "traffic_windows": [{"sa_id": "0x1", "t0": 1.5, "features": {"n": 3}}], "findings": [{"rule_id": "R", "evidence": {"spi": "0x1", "n": 2}}] * 2}
    reports = spark.createDataFrame([(json.dumps(doc),), (json.dumps({"analysis_id": "an_2"}),)], "j string").select(F.from_json("j", tables.REPORT_SCHEMA).alias("r")).select("r.*")
    parts = {name: rows.collect() for name, rows in tables.report_tables(reports).items()}
    assert sorted((r.id, r.enc, json.loads(r.params)["spi"]) for r in parts["sa"]) == [("an_1-0x1", "AES-GCM-16", "0x1"), ("an_1-0x2", None, "0x2")]
    assert [(r.sa_id, r.features) for r in parts["flow_window"]] == [("an_1-0x1", {"n": 3.0})]
    assert sorted((r.id, r.evidence["n"]) for r in parts["finding"]) == [("an_1-R-0", "2"), ("an_1-R-1", "2")]
    assert sorted(r.id for r in parts["analysis"]) == ["an_1", "an_2"]


def test_small_files_share_a_batch_and_large_ones_fill_several(spark):
    """A batch of frames costs a fixed time, so many files of two frames must not be one each."""
    import pandas as pd
    record = lambda n: struct.pack(">IIII", n, 0, 4, 4) + bytes([n % 256] * 4)
    file = lambda k, n: (str(k), struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1) + b"".join(record(i) for i in range(n)))
    class Files:
        columns = None
        def select(self, *names):
            return self
        def mapInPandas(self, body, schema):
            self.out = list(body(iter([pd.DataFrame([file(k, 2) for k in range(100)], columns=["capture_id", "content"]),
                                       pd.DataFrame([file(100, 500)], columns=["capture_id", "content"])])))
            return self
    out = captures.split_frames(Files(), batch=300).out
    assert [len(b) for b in out] == [300, 300, 100]
    rows = pd.concat(out)
    assert rows.capture_id.value_counts().to_dict() == {**{str(k): 2 for k in range(100)}, "100": 500}
    assert rows[rows.capture_id == "100"].frame_no.tolist() == list(range(500)) and rows[rows.capture_id == "7"].frame_no.tolist() == [0, 1]
    assert [len(b) for b in captures.split_frames(Files(), batch_bytes=400).out] == [100] * 7
