"""Hand-checked numbers for single operators."""

import pytest
from pyspark.sql import functions as F

from wiretally.functions import net, text
from wiretally.functions.tagged import known_or_unknown, tag_value
from wiretally.operators import evidence as ev, ike, metrics as mt, packets as pk, sa
from wiretally.plans import datasets as ds, inference, posture, threats as th

ESP = "capture_id string, packet_no long, ts_us long, spi long, seq long, src string, dst string, length long, udp_encapsulated boolean"


def esp(spark, rows):
    return spark.createDataFrame([("c", i, int(t * 1e6), spi, seq, src, dst, n, u) for i, (t, spi, seq, src, dst, n, u) in enumerate(rows)], ESP)


def test_cbc_structure(spark):
    rows = [(i, 1, i, "10.0.0.1", "10.0.0.2", 104, False) for i in range(10)]
    r = sa.esp_structure(esp(spark, rows)).first()
    assert (r.cipher_mode, r.icv_len, r.consistency) == ("CBC", 12, 1.0)


def test_gcm_structure_v6(spark):
    rows = [(i, 1, i, "fd30::2", "fd30::3", 132, False) for i in range(20)]
    r = sa.esp_structure(esp(spark, rows)).first()
    assert (r.cipher_mode, r.icv_len, r.consistency) == ("GCM", 24, 1.0)


def test_rekey_link_and_lifetime(spark):
    rows = [(1.0, 0xAA, 1, "a", "b", 100, False), (6.5, 0xAA, 2, "a", "b", 100, False), (7.0, 0xBB, 1, "b", "a", 100, False),
            (8.0, 0xBB, 2, "b", "a", 100, False), (9.0, 0xCC, 1, "a", "z", 100, False)]
    tracks = sa.sa_tracks(esp(spark, rows))
    got = {r.spi: r.rekey_of for r in sa.link_rekeys(tracks).collect()}
    assert got == {0xAA: None, 0xBB: 0xAA, 0xCC: None}
    life = {r.spi: r.rekey_interval_s for r in sa.sa_lifetime(tracks).collect()}
    assert life == {0xAA: 6, 0xBB: 1, 0xCC: None}  # 5.5 rounds to the even 6


def test_rekey_links_against_order_dependent_walk(spark):
    import random
    rnd = random.Random(3)
    rows = []
    for spi in range(60):
        t = rnd.randrange(200)
        for k in range(3):
            rows.append((t + k * rnd.randrange(1, 15), spi, k, "a", "b", 100, False))
    tracks = sa.sa_tracks(esp(spark, rows))
    listed = sorted(tracks.collect(), key=lambda r: (r.first_us, r.first_packet))
    link = {}
    for later in listed:
        for earlier in listed:
            if earlier.spi == later.spi or link.get(earlier.spi) is not None:
                continue
            if later.first_us >= earlier.last_us:
                link[later.spi] = earlier.spi
                break
    got = {r.spi: r.rekey_of for r in sa.link_rekeys(tracks).collect()}
    assert got == {r.spi: link.get(r.spi) for r in listed}


def test_replay_reset(spark):
    rows = [(0, 1, 4_000_000_000, "a", "b", 100, False), (1, 1, 1, "a", "b", 100, False)]
    r = sa.replay_resets(esp(spark, rows)).first()
    assert (r.replay_resets, r.replay_window) == (1, 0)


def test_score_matrix_and_grades(spark):
    f = spark.createDataFrame([("x", "R", "critical", 1.0, 1.0)], "analysis_id string, rule_id string, severity string, likelihood double, confidence double")
    r = posture.posture_score(f).first()
    assert (r.risk_score, r.security_score, r.grade) == (10.0, 60, "D")
    b = spark.createDataFrame([(0.55,), (0.9,), (1.0,), (0.0,)], "likelihood double").select(posture.likelihood_bucket().alias("b"))
    assert [r.b for r in b.collect()] == [3, 5, 5, 1]


def test_unknown_values_satisfy_no_comparison(spark):
    flat = spark.createDataFrame([("x", 1)], "analysis_id string, spi long")
    kinds = {"pfs": "boolean", "nat_t": "boolean", "esn": "boolean", "key_bits": "int", "replay_window": "int", "rekey_interval_s": "long", "ike_version": "int"}
    for f in posture.RULE_FIELDS:
        flat = flat.withColumns({f: F.lit(None).cast(kinds.get(f, "string")), f"{f}_conf": F.lit(None).cast("double")})
    flat = flat.withColumns({"traffic_confidence": F.lit(0.0), "traffic_top": F.lit(None).cast("string")})
    assert [r.rule_id for r in posture.evaluate_rules(flat, posture.load_pack("baseline")).collect()] == ["COMP-001"]


PACKET = "packet_no long, ts_us long, src string, dst string, ip_proto int, sport int, dport int, length int, tcp_flags int"


def packets(spark, rows):
    return spark.createDataFrame([(i, int(t * 1e6), *r) for i, (t, *r) in enumerate(rows)], PACKET)


def test_flood_gives_one_alert(spark):
    rows = [(n / 200, f"10.0.0.{n % 20 + 1}", "1.2.3.4", 6, 1000, 80, 100, 2) for n in range(110)]
    alerts = th.detect_ddos(packets(spark, rows)).collect()
    assert len(alerts) == 1 and '"syn_sources":20' in alerts[0].evidence


def test_scan_and_upload(spark):
    rows = [(2 + n / 20, "10.1.1.1", "8.8.8.8", 6, 1000, 100 + n, 100, 0) for n in range(11)]
    scans = th.detect_port_scan(packets(spark, rows)).collect()
    assert scans and all('"source":"10.1.1.1"' in a.evidence for a in scans)
    up = th.detect_exfiltration(packets(spark, [(5, "10.1.1.1", "8.8.8.8", 6, 1000, 443, 1_100_000, 0)])).collect()
    assert len(up) == 1 and up[0].confidence == 0.95


def test_periodic_tls_connections(spark):
    rows = [(10 + 5 * n, "10.1.1.1", "8.8.8.8", 6, 1000 + n, 443, 100, 0) for n in range(4)]
    p = packets(spark, rows).withColumns({"tls": F.lit(True), "quic": F.lit(False)})
    assert th.detect_beaconing(p).count() == 1 and th.detect_periodic_encrypted(p).count() == 1


def test_flow_id_text(spark):
    p = packets(spark, [(0, "8.8.8.8", "10.1.1.1", 6, 443, 1000, 1, 0)])
    assert p.select(net.flow_text().alias("t")).first().t == "(('10.1.1.1', 1000), ('8.8.8.8', 443), 6)"


def test_internal_networks(spark):
    df = spark.createDataFrame([("10.255.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True),
                                ("10.1.1", False), ("10.1.1.256", False), ("8.8.8.8", False), ("fd30::2", False)], "a string, want boolean")
    assert df.filter(net.is_internal("a") != F.col("want")).count() == 0
    assert df.filter(net.is_internal("a", ("fd30::/16",))).count() == 1


def _transform(ttype, tid, bits=None):
    body = tid.to_bytes(2, "big") + b"\0\0" + (b"\0\x0e" + bits.to_bytes(2, "big") if bits else b"")
    return bytes([ttype, 0]) + (4 + len(body)).to_bytes(2, "big") + body


def test_simple_transform_layout(spark):
    body = _transform(1, 20, 256) + _transform(1, 12, 128) + _transform(3, 2) + _transform(4, 14)
    df = spark.createDataFrame([(33, bytearray(body))], "ptype int, body binary")
    names = [r.name for r in ike.ike_transforms(df, layout="simple").orderBy("transform_no").collect()]
    assert names == ["AES-GCM-16-256", "AES-CBC-128", "HMAC-SHA1-96", "MODP-2048"]


def test_aggressive_mode_header(spark):
    head = bytearray(28)
    head[17], head[18] = 0x10, 4
    df = spark.createDataFrame([("c", 0, 0, "a", "b", 500, 500, 17, head)],
                               "capture_id string, packet_no long, ts_us long, src string, dst string, sport int, dport int, ip_proto int, payload binary")
    r = ike.ike_messages(df).first()
    assert (r.major, r.exchange, r.aggressive) == (1, 4, True)


STATE = ("p01: #29, ESTABLISHED, IKEv2\n  AES_CBC-128/HMAC_SHA2_256_128/PRF_HMAC_SHA2_256/MODP_2048\n"
         "  p01-child: #41, reqid 1, INSTALLED, TUNNEL, ESP:AES_CBC-128/HMAC_SHA2_256_128\n    in  cdde516d, 100 bytes\n    out c6b051c5, 100 bytes\n")
RAW = ("list-sas event {p01 {dh-group=MODP_2048 child-sas {p01-child-1\n{name=p01-child state=INSTALLED mode=TUNNEL protocol=ESP spi-in=cdde516d\n"
       "spi-out=c6b051c5 encr-alg=AES_CBC encr-keysize=128 integ-alg=HMAC_SHA2_256_128}}}}\nlist-sas reply {}\n")


def test_gateway_texts(spark):
    df = spark.createDataFrame([("s1", STATE, RAW)], "session_id string, sa_state string, raw string")
    a = ev.parse_gateway_state(df).first()
    assert (a.mode, a.enc, a.key_bits, a.integ, a.spis) == ("tunnel", "AES-CBC", 128, "sha256", ["0xcdde516d", "0xc6b051c5"])
    b = ev.parse_gateway_raw(df).first()
    assert (b.mode, b.enc, b.key_bits, b.integ, b.dh_group) == ("tunnel", "AES-CBC", 128, "sha256", None)


def test_a_status_line_is_read_once(spark):
    """A part of a lambda that is named twice is worked out twice, and a filter on the result would work out all of it again."""
    df = spark.createDataFrame([("s1", STATE, RAW)], "session_id string, sa_state string, raw string")
    plan = ev.parse_gateway_state(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 8 and plan.count("array_position(") == 1


def test_payload_chains_are_walked_once(spark):
    """A filter on the chains that are found must not walk them again."""
    kinds = "capture_id string, peer_a string, peer_b string, initiator_spi string, packet_no long, is_response boolean, msg_length long, first_payload int, message binary"
    payloads = ike.ike_payloads(spark.createDataFrame([("c", "a", "b", "1", 1, False, 36, 43, bytes(28) + b"\0\0\0\x08" + bytes(4))], kinds))
    assert [(r.payload_no, r.ptype, len(r.body)) for r in payloads.collect()] == [(0, 43, 4)]
    assert payloads._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_session_accuracy_counts(spark):
    labels = spark.createDataFrame([("s", "tunnel", "AES-GCM-16", "web")], "session_id string, mode string, enc string, traffic_type string")
    pred = spark.createDataFrame([("s", 1, "tunnel", "AES-CBC", "web")], "session_id string, spi long, mode string, enc string, traffic_top string")
    r = ev.session_accuracy(ev.best_evidence_sa(pred), labels).first()
    assert (r.matched, r.compared, r.eligible) == (2, 3, 3)
    labels = spark.createDataFrame([("s", "tunnel", "sha1", True, "web")], "session_id string, mode string, integ string, pfs boolean, traffic_type string")
    pred = spark.createDataFrame([("s", 1, None, None, None, None), ("s", 2, "tunnel", "HMAC-SHA*-96/128", None, None)],
                                 "session_id string, spi long, mode string, integ string, pfs boolean, traffic_top string")
    r = ev.session_accuracy(ev.best_evidence_sa(pred), labels).first()
    assert (r.matched, r.compared, r.eligible, r.missing, r.match_rate) == (1, 1, 4, 3, 0.25)


def test_labels_follow_the_esp_proposal(spark):
    df = spark.createDataFrame([("aes256gcm16-ecp256", "aes256gcm16-curve25519", True), ("aes256gcm16-ecp256", "aes256gcm16-curve25519", False)],
                               "ike_proposal string, esp_proposal string, pfs boolean")
    assert [(r.ike_dh_group, r.dh_group) for r in ev.normalize_labels(df).collect()] == [(19, 31), (19, None)]


def test_splits_are_disjoint_and_cover_classes(spark):
    rows = [(f"p{p:02d}", c) for p in range(10) for c in ("a", "b") for _ in range(3)]
    df = spark.createDataFrame(rows, "profile string, label string")
    split = ds.profile_split(df, "label", tries=64)
    parts = [(r.profile, r.part) for r in split.collect()]
    assert len(parts) == len({p for p, _ in parts}) == 10
    assert sorted(x for _, x in parts) == ["calib"] * 2 + ["conformal"] * 2 + ["test"] * 2 + ["train"] * 4
    one_class = spark.createDataFrame([(f"p{p:02d}", "a" if p else "b") for p in range(6)], "profile string, label string")
    with pytest.raises(ValueError):
        ds.profile_split(one_class, "label", tries=64)


def test_label_intervals_against_brute_force(spark):
    import random
    rnd = random.Random(1)
    feats = [(i, rnd.choice(["h", "h", "g"]), rnd.choice(["x", "y"]), rnd.randrange(10**9)) for i in range(300)]
    labels = []
    for i in range(60):
        lo = rnd.choice([None, rnd.randrange(10**9)])
        hi = rnd.choice([None, (lo or 0) + rnd.randrange(-10, 3 * 10**8)])
        labels.append(("dga", f"s{i}", i % 2, rnd.choice(["h", "g"]), rnd.choice([None, "x"]), lo, hi))
    f = spark.createDataFrame(feats, "no long, src string, dst string, ts_us long")
    lab = spark.createDataFrame(labels, "task string, scenario_id string, label int, src string, dst string, start_us long, end_us long")
    got = sorted((r.no, r.scenario_id) for r in ds.label_intervals(f, lab, "dga", per_label=3, salt_rows=20).collect())
    want = sorted((no, s) for no, src, dst, t in feats for _, s, _, ls, ld, lo, hi in labels
                  if src == ls and (ld is None or ld == dst) and (lo is None or t >= lo) and (hi is None or t <= hi))
    assert got == want
    two = [f.withColumn("capture_id", F.lit(c)) for c in ("c1", "c2")]
    scoped = ds.label_intervals(two[0].unionByName(two[1]), lab.withColumn("capture_id", F.lit("c2")), "dga", scope="capture_id")
    assert sorted((r.no, r.scenario_id, r.capture_id) for r in scoped.collect()) == [(*w, "c2") for w in want]


def test_dns_question_and_bad_messages(spark):
    q = b"\0\1\1\0\0\1\0\0\0\0\0\0" + b"\3WwW\7example\3com\0" + b"\0\1\0\1"
    rows = [(0, 17, 5000, 53, bytearray(q)), (1, 17, 53, 5000, bytearray(q[:2] + b"\x81\x83" + q[4:])), (2, 17, 5000, 53, bytearray(q[:20])), (3, 6, 1, 53, bytearray(q))]
    df = spark.createDataFrame(rows, "packet_no long, ip_proto int, sport int, dport int, payload binary")
    assert sorted((r.packet_no, r.qname, r.rcode, r.qtype) for r in pk.dns_queries(df).collect()) == [(0, "www.example.com", None, 1), (1, "www.example.com", 3, 1)]


def test_tagged_values_and_metrics(spark):
    df = spark.createDataFrame([("GCM",), (None,)], "v string").withColumn("t", known_or_unknown(F.col("v"), 0.9))
    assert [(r.t.tag, r.t.confidence) for r in df.collect()] == [("inferred", 0.9), ("unknown", 0.0)]
    assert df.filter(tag_value("t").isNull()).count() == 1
    bad = spark.createDataFrame([("d", 2)], "domain string, label int")
    with pytest.raises(Exception, match="label must be 0 or 1"):
        mt.require_binary_label(bad).collect()


def test_beacon_history_expires_after_an_hour(spark):
    hour = 3_600_000_000
    times = [0, 10, 20, 30, 3_615, 3_630, 9_000, 9_010]
    rows = [(i, t * 1_000_000, "10.0.0.1", "9.9.9.9", 443, 6, "f") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "packet_no long, ts_us long, src string, dst string, dport int, ip_proto int, flow_id string")
    got = {r.packet_no: (r.observations, round(r.interval_mean, 6)) for r in th.beacon_stats(df).collect()}
    want = {}
    for i, t in enumerate(times):
        seen = [x for x in times[:i + 1] if x >= t - hour // 1_000_000]
        if len(seen) >= 2:
            want[i] = (len(seen), round((seen[-1] - seen[0]) / (len(seen) - 1), 6))
    assert got == want and got[4] == (3, 1797.5)


def test_sessions_without_gateway_evidence_are_verified_from_their_status_text(spark):
    line = "  c: #2, reqid 1, INSTALLED, TUNNEL, ESP:AES_CBC-256\n    in  0000000a, 1 bytes\n    out 0000000b, 2 bytes\n"
    sessions = spark.createDataFrame([("new", "completed"), ("old", "completed"), ("bare", "completed"), ("late", "running")], "session_id string, status string")
    children = spark.createDataFrame([("new", "tunnel", "AES-CBC", 256, None, ["0x0000000a"])],
                                     "session_id string, mode string, enc string, key_bits int, integ string, spis array<string>")
    sas = spark.createDataFrame([(s, "0x0000000A") for s in ("new", "old", "bare", "late")], "session_id string, spi string")
    labels = spark.createDataFrame([(s, "tunnel", "CBC", 128, "sha256", True, 14) for s in ("new", "old", "bare", "late")],
                                   "session_id string, mode string, enc string, key_bits int, integ string, pfs boolean, dh_group int")
    legacy = spark.createDataFrame([("old", line), ("bare", None), ("late", line)], "session_id string, sa_state string")
    out = ev.verify_sessions(sessions, children, sas, labels, legacy=legacy)
    got = {(r.session_id, r.field): (r.value, r.source, r.match) for r in out.collect()}
    assert len(got) == 24
    assert got["new", "enc"] == ("AES-CBC", "gateway_vici", True) and got["new", "pfs"] == (None, "unavailable", None)
    assert got["old", "enc"] == ("AES-CBC", "legacy_sa_state", True) and got["old", "key_bits"] == ("256", "legacy_sa_state", False)
    for s in ("old", "bare", "late"):
        assert got[s, "pfs"] == ("true", "configured", None) and got[s, "dh_group"] == ("14", "configured", None)
    assert got["bare", "mode"] == got["late", "mode"] == (None, "unavailable", None)
    totals = {r.session_id: (r.eligible, r.compared, r.matched) for r in ev.verification_totals(out).collect()}
    assert totals == {"new": (6, 3, 2), "old": (6, 3, 2), "bare": (6, 0, 0), "late": (6, 0, 0)}


def test_compliance_counts(spark):
    sas = spark.createDataFrame([("a", "AES-GCM-16-256", "AEAD", "ECP-384"), ("a", "3DES", "SHA1", None), ("a", "AES-CBC", None, "MODP-1024"), ("b", None, None, None)],
                                "analysis_id string, enc string, integ string, dh_group string")
    got = {r.analysis_id: [tuple(r[s]) for s in posture.SUITES] for r in posture.compliance_counts(sas).collect()}
    assert got == {"a": [(2, 1), (2, 1), (1, 2), (1, 2)], "b": [(1, 0), (1, 0), (1, 0), (0, 1)]}
