"""Served heads and the whole chain from capture bytes to posture."""

import struct

import pytest
from pyspark.sql import functions as F

from test_ranges import block, interface, packet, section
from wiretally.plans import analysis, posture, serving
from wiretally.sources import captures


def ip4(proto, src, dst, body):
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, bytes(src), bytes(dst))
    return head + body


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    """One SA of GCM-shaped ESP packets at bare IP, 130 bytes each, over 30 s."""
    out = section() + interface(101)
    for i in range(60):
        body = struct.pack("!II", 0x1234ABCD, i + 1) + bytes(8) + bytes(16 * 5 + 2) + bytes(12)
        out += packet(i * 500_000, ip4(50, (10, 0, 0, 1), (192, 0, 2, 9), body))
    path = tmp_path_factory.mktemp("chain") / "esp.pcapng"
    path.write_bytes(out)
    return captures.read_packets(spark, str(path))


def constant(value, classes, p=0.9):
    return serving.Head(lambda df: df.withColumn("probs", F.array(*[F.lit(p if c == value else (1 - p) / (len(classes) - 1)) for c in classes])), classes, 0.4, "v2")


def test_chain_without_heads(packets):
    out = analysis.analyse_packets(packets, posture.load_pack("baseline"))
    sa = out["sas"].collect()
    assert len(sa) == 1 and sa[0]["spi"] == 0x1234ABCD and sa[0]["mode"] is None and sa[0]["traffic_top"] is None
    row = out["evidence"].first()
    assert row["pfs"]["tag"] == row["dh_group"]["tag"] == row["mode"]["tag"] == "unknown" and row["rekey_interval_s"]["value"] == 30
    assert out["windows"].filter("prediction IS NOT NULL").count() == 0 and out["windows"].count() == 6
    assert out["posture"].count() == 1 and out["compliance"].count() == 1 and out["exposure"].count() == 1
    assert [(r["proto_class"], r["packets"]) for r in out["classes"].collect()] == [("esp", 60)]
    assert out["links"].first()["rekey_of"] is None


def test_chain_with_heads(packets):
    heads = {"mode": constant("tunnel", ["transport", "tunnel"]), "cipher": constant("AES-CBC", ["AES-CBC", "AES-GCM-16", "3DES"], 0.8),
             "pfs": constant("true", ["false", "true"]), "traffic": constant("web", ["bulk", "voip", "web"], 0.5)}
    out = analysis.analyse_packets(packets, posture.load_pack("baseline"), heads)
    row = out["evidence"].first()
    assert (row["mode"]["value"], row["mode"]["tag"], row["mode"]["confidence"]) == ("tunnel", "inferred", 0.9)
    assert row["enc"]["value"] == "AES-CBC" and row["pfs"]["tag"] == "unknown"  # no rekey was captured
    assert row["traffic_top"] == "web" and row["conformal_set"] == ["web"] and row["traffic_confidence"] == 0.5
    assert {r["prediction"] for r in out["windows"].collect()} == {"web"}
    assert out["sas"].first()["mode"] == "tunnel"


def test_heads_come_from_the_registry(spark, tmp_path):
    from wiretally.plans import training
    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, "tunnel").otherwise("transport").alias("mode"), *[((F.col("id") % 2) * (i + 1)).cast("double").alias(f"f{i}") for i in range(3)])
    model = training.train_head(rows, "mode", ["f0", "f1", "f2"], rounds=3, depth=2)
    training.save_head(model, str(tmp_path), "mode", "1.0")
    registry = spark.createDataFrame([("mode", "1.0", 0.3), ("cipher", None, None)], "task string, version string, q double")
    heads = serving.load_heads(registry, str(tmp_path), ["mode", "cipher", "pfs"])
    assert list(heads) == ["mode"] and heads["mode"].version == "1.0" and heads["mode"].q == 0.3
    out = serving.score_sas(rows.withColumns({"capture_id": F.lit("c"), "spi": F.monotonically_increasing_id()}), heads)
    assert out.columns == ["capture_id", "spi", "mode_pred", "mode_p"] and out.filter("mode_pred = 'tunnel'").count() == 100


def test_threat_models_score_detector_features(spark):
    from wiretally import constants as C
    from wiretally.plans import training
    cols = C.THREAT_FEATURES["beaconing"]
    rows = spark.range(80).select("id", F.col("id").alias("packet_no"), (F.col("id") % 2).cast("int").alias("label"), *[(F.col("id") % 2 + i).cast("double").alias(c) for i, c in enumerate(cols)])
    score = serving.threat_scorer(training.train_threat(rows, "beaconing", rounds=2), "beaconing", "3")
    got = score(rows.drop("label"))
    assert got.columns == ["packet_no", "score", "model_version"]
    assert got.filter("packet_no % 2 = 1 AND score > 0.5").count() == 40 == got.filter("packet_no % 2 = 0 AND score < 0.5").count()
    assert {r["model_version"] for r in got.collect()} == {"beaconing-3"}
