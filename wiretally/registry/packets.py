"""Packet-level queries: decode, classes, headers, flows, names and texts."""

from pyspark.sql import functions as F

from wiretally.fixtures import table
from wiretally.functions import net, text
from wiretally.functions.binary import bind
from wiretally.functions.tagged import known_or_unknown, tag_value
from wiretally.operators import packets as pk
from wiretally.operators import sa
from wiretally.registry.base import query

# --- frames built from the events table -------------------------------------


def _h(col, digits):
    col = F.col(col) if isinstance(col, str) else col
    return F.lpad(F.hex(col), digits, "0")


def _frames(spark, d):
    """Ethernet and raw-IP frames for every event: ESP, UDP/53, TCP over IPv6 with VLAN tags, UDP/500."""
    e = table(spark, d, "events").select("event_id", "user_id")
    i, u = F.col("event_id"), F.col("user_id")
    kind = i % 4
    esp = F.concat(_h(u, 8), _h(i, 8), F.lit("AB" * 24))
    dns = F.concat(_h(20000 + i % 30000, 4), F.lit("0035"), F.lit("00000000"), _dns_hex(i))
    tcp = F.concat(_h(20000 + i % 30000, 4), F.lit("01BB"), F.lit("0000000100000000"), F.lit("50"),
                   F.when(i % 3 == 0, "02").otherwise("10"), F.lit("FFFF00000000"), F.col("_hello"))
    ike = F.concat(F.lit("01F401F400000000"), F.col("_ike"))
    e = bind(e, _hello=_hello_hex(i), _ike=_ike_hex(i))
    e = bind(e, _body=F.when(kind == 0, esp).when(kind == 1, dns).when(kind == 2, tcp).otherwise(ike))
    body = F.col("_body")
    proto = F.when(kind == 0, F.lit(50)).when(kind == 2, F.lit(6)).otherwise(F.lit(17))
    n = (F.length(body) / 2).cast("long")
    v4 = F.concat(F.lit("4500"), _h(n + 20, 4), F.lit("0000000040"), _h(proto, 2), F.lit("0000"),
                  F.lit("0A01"), _h(u % 65536, 4), F.lit("CB007107"))
    v6 = F.concat(F.lit("60000000"), _h(n, 4), _h(proto, 2), F.lit("40"), F.lit("FD30" + "0" * 24), _h(u % 65535 + 1, 4),
                  F.lit("FD30" + "0" * 27 + "3"))
    e = bind(e, _ip=F.concat(F.when(kind == 2, v6).otherwise(v4), body))
    ip = F.col("_ip")
    tag = F.when(i % 8 == 2, "81000001").when(i % 8 == 6, "88A8000281000001").otherwise("")
    eth = F.concat(F.lit("FF" * 6 + "00" * 6), tag, F.when(kind == 2, "86DD").otherwise("0800"))
    raw = i % 12 == 0
    return e.select(F.lit("events").alias("capture_id"), i.alias("frame_no"), (i * 1000).alias("ts_us"),
                    F.when(raw, 101).otherwise(1).alias("linktype"),
                    F.unhex(F.when(raw, ip).otherwise(F.concat(eth, ip))).alias("frame"))


def _dns_hex(i):
    """A DNS query (response for every fifth) for q<event_id>.example.net."""
    name = F.concat(F.lit("q"), i.cast("string"))
    flags = F.when(i % 5 == 0, "8183").otherwise("0100")
    return F.concat(_h(i % 65536, 4), flags, F.lit("0001000000000000"), _h(F.length(name), 2), F.hex(F.encode(name, "utf-8")),
                    F.lit("076578616D706C65036E657400"), _h(1 + i % 16, 4), F.lit("0001"))


def _hello_hex(i):
    """A ClientHello with 1..4 ciphers, a server name of i % 9 + 1 bytes and one more extension."""
    ciphers = 1 + i % 4
    name = i % 9 + 1
    sni = F.concat(F.lit("0000"), _h(name + 5, 4), _h(name + 3, 4), F.lit("00"), _h(name, 4), F.expr("repeat('61', cast(event_id % 9 + 1 as int))"))
    ext = F.concat(sni, F.lit("00170000"))
    hello = F.concat(F.lit("0303"), F.lit("11" * 32), F.lit("00"), _h(ciphers * 2, 4),
                     F.expr("repeat('1301', cast(1 + event_id % 4 as int))"), F.lit("0100"),
                     _h((F.length(ext) / 2).cast("long"), 4), ext)
    n = (F.length(hello) / 2).cast("long")
    return F.concat(F.lit("160301"), _h(n + 4, 4), F.lit("01"), _h(n, 6), hello)


def _ike_hex(i):
    """IKE: SA_INIT with SA, KE, NAT notify and vendor id; CREATE_CHILD_SA without; IKEv1 aggressive."""
    form = F.shiftright(i, 2) % 3
    transforms = F.concat(
        F.lit("0300000C0100"), F.when(i % 8 == 3, "0014").otherwise("000C"), F.lit("800E"), F.when(i % 8 == 3, "0100").otherwise("0080"),
        F.lit("0300000803000002"), F.lit("0000000804000013"))
    proposal = F.concat(F.lit("0000"), _h((F.length(transforms) / 2 + 8).cast("long"), 4), F.lit("01010003"), transforms)
    sa_body = F.concat(F.lit("2200"), _h((F.length(proposal) / 2 + 4).cast("long"), 4), proposal)
    chain = F.concat(sa_body, F.lit("29000048" + "00130000" + "55" * 64), F.lit("2B000008" + "00004004"),
                     F.lit("0000000C" + "4142434445464748"))
    body = F.when(form == 0, chain).when(form == 1, "00000018" + "77" * 20).otherwise("")
    first = F.when(form == 0, "21").when(form == 1, "2E").otherwise("00")
    total = (F.length(body) / 2 + 28).cast("long")
    return F.concat(_h(F.shiftright(i, 6), 16), F.lit("0" * 16), first, F.when(form == 2, "10").otherwise("20"),
                    F.when(form == 0, "22").when(form == 1, "24").otherwise("04"), F.when(i % 8 == 3, "20").otherwise("08"),
                    _h(F.shiftright(i, 2), 8), _h(total, 8), body)


def packets_from_frames(spark, d):
    return pk.decode_packets(_frames(spark, d))


query("s2_decode_packets", """
    SELECT 'events' AS capture_id, event_id AS packet_no, event_id*1000 AS ts_us,
      CASE WHEN event_id % 4 = 2 THEN concat('fd30::', lower(to_hex(user_id % 65535 + 1)))
           ELSE concat('10.1.', CAST((user_id % 65536)//256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) END AS src,
      CASE WHEN event_id % 4 = 2 THEN 'fd30::3' ELSE '203.0.113.7' END AS dst,
      CAST(CASE event_id % 4 WHEN 0 THEN 50 WHEN 2 THEN 6 ELSE 17 END AS BIGINT) AS ip_proto,
      CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN 500 ELSE 20000 + event_id % 30000 END AS sport,
      CAST(CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN 500 WHEN 1 THEN 53 ELSE 443 END AS BIGINT) AS dport,
      CAST(CASE WHEN event_id % 4 = 2 THEN 6 ELSE 4 END AS BIGINT) AS ip_version,
      CAST(CASE WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 3 = 0 THEN 2 ELSE 16 END ELSE 0 END AS BIGINT) AS tcp_flags,
      CAST(64 AS BIGINT) AS ttl
    FROM events""")(lambda spark, d: packets_from_frames(spark, d).drop("ts", "payload", "length"))

query("p3_esp_records", """
    SELECT 'events' AS capture_id, event_id AS packet_no, event_id*1000 AS ts_us, user_id AS spi, event_id AS seq,
      concat('10.1.', CAST((user_id % 65536)//256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS src, '203.0.113.7' AS dst,
      CAST(52 AS BIGINT) AS length, false AS udp_encapsulated FROM events WHERE event_id % 4 = 0""")(
    lambda spark, d: pk.esp_records(packets_from_frames(spark, d)))

query("p17_dns_queries", """
    SELECT event_id AS packet_no, concat('q', CAST(event_id AS VARCHAR), '.example.net') AS qname, 1 + event_id % 16 AS qtype,
      CASE WHEN event_id % 5 = 0 THEN CAST(3 AS BIGINT) END AS rcode FROM events WHERE event_id % 4 = 1""")(
    lambda spark, d: pk.dns_queries(packets_from_frames(spark, d)).select("packet_no", "qname", "qtype", "rcode"))

query("p18_tls_metadata", """
    SELECT event_id AS packet_no, true AS tls, CAST(769 AS DOUBLE) AS tls_version, CAST(1 + event_id % 4 AS DOUBLE) AS cipher_count,
      CAST(event_id % 9 + 1 AS DOUBLE) AS sni_length, CAST(2 AS DOUBLE) AS extension_count FROM events WHERE event_id % 4 = 2""")(
    lambda spark, d: pk.tls_metadata(packets_from_frames(spark, d)).select(
        "packet_no", "tls", "tls_version", "cipher_count", "sni_length", "extension_count"))


@query("p19_quic_header", """
    SELECT event_id, event_id % 65536 AS quic_version FROM events WHERE event_id % 2 = 0""")
def _p19(spark, d):
    e = table(spark, d, "events").select("event_id")
    first = F.when(F.col("event_id") % 2 == 0, "C3").otherwise("43")
    p = e.withColumn("payload", F.unhex(F.concat(first, _h(F.col("event_id") % 65536, 8), F.lit("00AA"))))
    out = p.select("event_id", net.quic_version("payload").alias("quic_version"))
    return out.filter(F.col("quic_version").isNotNull())


@query("p4_ah_records", """
    SELECT event_id AS packet_no, user_id AS spi, event_id AS seq, CAST(4 AS BIGINT) AS next_header,
      CAST(12 + 4*(event_id % 3) AS BIGINT) AS icv_len FROM events""")
def _p4(spark, d):
    e = table(spark, d, "events")
    body = F.concat(F.lit("04"), _h(4 + F.col("event_id") % 3, 2), F.lit("0000"), _h("user_id", 8), _h("event_id", 8), F.lit("EE" * 12))
    p = e.select(F.lit("events").alias("capture_id"), F.col("event_id").alias("packet_no"), F.col("event_id").alias("ts_us"),
                 F.lit(51).alias("ip_proto"), F.lit(None).cast("int").alias("sport"), F.lit(None).cast("int").alias("dport"),
                 F.unhex(body).alias("payload"))
    return pk.ah_records(p).select("packet_no", "spi", "seq", "next_header", "icv_len")


# --- packet columns ---------------------------------------------------------

query("s3_total_packets", "SELECT capture_id, CAST(count(*) AS BIGINT) AS packets FROM packets_fx GROUP BY 1", ["packets_fx"])(pk.total_packets)

CLASS_SQL = """CASE WHEN ip_proto = 50 THEN 'esp' WHEN ip_proto = 51 THEN 'ah'
      WHEN ip_proto = 17 AND (sport = 500 OR dport = 500) THEN 'ike'
      WHEN ip_proto = 17 AND (sport = 4500 OR dport = 4500) THEN CASE WHEN left(hex(payload), 8) = '00000000' THEN 'ike' ELSE 'esp_in_udp' END
      ELSE 'other' END"""

query("p1_proto_class", f"SELECT packet_no, {CLASS_SQL} AS proto_class FROM packets_fx", ["packets_fx"])(
    lambda p: pk.with_proto_class(p).select("packet_no", "proto_class"))
query("p2_class_counts", f"SELECT capture_id, {CLASS_SQL} AS proto_class, CAST(count(*) AS BIGINT) AS packets FROM packets_fx GROUP BY 1, 2",
      ["packets_fx"])(pk.class_counts)
query("a8_ipsec_present", f"SELECT capture_id, bool_or({CLASS_SQL} <> 'other') AS ipsec_present FROM packets_fx GROUP BY 1",
      ["packets_fx"])(pk.ipsec_present)
query("u1_union_esp", f"""SELECT packet_no, CAST(3333444037 AS BIGINT) AS spi, CAST(7 AS BIGINT) AS seq, CAST(28 AS BIGINT) AS length,
      {CLASS_SQL} = 'esp_in_udp' AS udp_encapsulated FROM packets_fx
    WHERE {CLASS_SQL} IN ('esp', 'esp_in_udp') AND hex(payload) = 'C6B051C500000007'
    UNION ALL SELECT packet_no, 0, 1, 28, false FROM packets_fx WHERE {CLASS_SQL} = 'esp' AND hex(payload) <> 'C6B051C500000007'""",
      ["packets_fx"])(lambda p: pk.union_esp(p).select("packet_no", "spi", "seq", "length", "udp_encapsulated"))

query("p12_spi_text", "SELECT spi, concat('0x', lpad(lower(to_hex(spi)), 8, '0')) AS spi_text FROM esp_fx GROUP BY spi", ["esp_fx"])(
    lambda e: e.groupBy("spi").agg(F.lit(1)).select("spi", net.spi_text("spi").alias("spi_text")))

INSIDE_SQL = "({0} LIKE '10.%' OR {0} LIKE '192.168.%' OR regexp_matches({0}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.'))"
query("p13_is_internal", f"SELECT packet_no, {INSIDE_SQL.format('src')} AS src_inside, {INSIDE_SQL.format('dst')} AS dst_inside FROM packets_fx",
      ["packets_fx"])(lambda p: p.select("packet_no", net.is_internal("src").alias("src_inside"), net.is_internal("dst").alias("dst_inside")))
query("p14_direction", f"""SELECT packet_no, CASE WHEN {INSIDE_SQL.format('src')} AND NOT {INSIDE_SQL.format('dst')} THEN 'out'
      WHEN {INSIDE_SQL.format('dst')} AND NOT {INSIDE_SQL.format('src')} THEN 'in' END AS direction FROM packets_fx""",
      ["packets_fx"])(lambda p: pk.with_direction(p).select("packet_no", "direction"))
query("p15_syn_only", "SELECT packet_no, (tcp_flags & 2) > 0 AND (tcp_flags & 16) = 0 AS syn_only FROM packets_fx", ["packets_fx"])(
    lambda p: p.select("packet_no", net.is_syn().alias("syn_only")))

FLOW_ID_SQL = """substr(sha256(concat('((''', CASE WHEN (src, CAST(sport AS BIGINT)) <= (dst, CAST(dport AS BIGINT)) THEN concat(src, ''', ', sport, '), (''', dst, ''', ', dport)
      ELSE concat(dst, ''', ', dport, '), (''', src, ''', ', sport) END, '), ', ip_proto, ')')), 1, 20)"""
query("p16_flow_id", f"SELECT packet_no, {FLOW_ID_SQL} AS flow_id FROM packets_fx", ["packets_fx"])(
    lambda p: p.select("packet_no", net.flow_id().alias("flow_id")))

ENTROPY_SQL = """round(coalesce(list_sum(list_transform(list_distinct(string_split({0}, '')),
      lambda c: -(len({0}) - len(replace({0}, c, '')))/len({0})::DOUBLE * log2((len({0}) - len(replace({0}, c, '')))/len({0})::DOUBLE))), 0), 6)"""
LABEL_SQL = "split_part(rtrim(lower({0}), '.'), '.', 1)"

query("p20_shannon_entropy", f"SELECT packet_no, {ENTROPY_SQL.format('qname')} AS entropy FROM dns_fx", ["dns_fx"])(
    lambda d: d.select("packet_no", text.shannon_entropy("qname").alias("entropy")))

FEATURES_SQL = f"""CAST(len(lab) AS DOUBLE) AS label_len, {ENTROPY_SQL.format('lab')} AS entropy,
      round(len(list_distinct(list_transform(range(1, len(lab)), lambda i: substr(lab, i, 2)))) / greatest(1, len(lab) - 1)::DOUBLE, 6) AS bigram_diversity,
      round(len(regexp_replace(lab, '[^0-9]', '', 'g')) / greatest(1, len(lab))::DOUBLE, 6) AS digit_ratio,
      CAST(len(name) AS DOUBLE) AS name_len"""
query("p21_dns_name_features", f"""
    WITH l AS (SELECT packet_no, qname AS name, {LABEL_SQL.format('qname')} AS lab FROM dns_fx)
    SELECT packet_no, {FEATURES_SQL}, CAST(0.1 AS DOUBLE) AS qps FROM l""", ["dns_fx"])(
    lambda d: d.select("packet_no", *[c.alias(k) for k, c in text.dns_name_features("qname", F.lit(3)).items()]))

DH_SQL = """CASE WHEN {0} LIKE '%modp1024%' THEN 2 WHEN {0} LIKE '%modp1536%' THEN 5 WHEN {0} LIKE '%modp2048%' THEN 14
      WHEN {0} LIKE '%modp3072%' THEN 15 WHEN {0} LIKE '%modp4096%' THEN 16 WHEN {0} LIKE '%ecp256%' THEN 19
      WHEN {0} LIKE '%ecp384%' THEN 20 WHEN {0} LIKE '%ecp521%' THEN 21 WHEN {0} LIKE '%curve25519%' THEN 31 END"""
query("p22_proposal_labels", f"""SELECT session_id, CASE WHEN esp_proposal LIKE '%gcm%' THEN 'GCM' WHEN esp_proposal LIKE '%cbc%' THEN 'CBC' END AS cipher,
      CASE WHEN esp_proposal LIKE '%gcm%' THEN 'AEAD' ELSE nullif(regexp_extract(esp_proposal, '(sha[0-9]+)', 1), '') END AS integ,
      CAST({DH_SQL.format('esp_proposal')} AS BIGINT) AS dh_group FROM sessions_fx""", ["sessions_fx"])(
    lambda s: s.select("session_id", text.proposal_cipher("esp_proposal").alias("cipher"),
                       text.proposal_integ("esp_proposal").alias("integ"), text.label_dh("esp_proposal").alias("dh_group")))
query("p23_dh_from_proposal", f"SELECT session_id, CAST({DH_SQL.format('esp_proposal')} AS BIGINT) AS dh_group FROM sessions_fx", ["sessions_fx"])(
    lambda s: s.select("session_id", text.dh_from_proposal(F.upper(F.replace("esp_proposal", F.lit("modp"), F.lit("modp_")))).alias("dh_group")))
query("p24_normalize_labels", f"""SELECT session_id, CAST({DH_SQL.format('ike_proposal')} AS BIGINT) AS ike_dh_group,
      CAST(CASE WHEN pfs THEN {DH_SQL.format('esp_proposal')} END AS BIGINT) AS dh_group FROM sessions_fx""", ["sessions_fx"])(
    lambda s: _normalize(s).select("session_id", "ike_dh_group", "dh_group"))


def _normalize(s):
    from wiretally.operators.evidence import normalize_labels
    return normalize_labels(s)


query("p25_gateway_algorithms", """SELECT session_id, spi_in, concat('AES-', CASE WHEN proposal LIKE '%GCM%' THEN 'GCM-16' ELSE 'CBC' END) AS enc,
      CAST(right(proposal, 3) AS BIGINT) AS key_bits, CASE WHEN proposal LIKE '%GCM%' THEN 'AEAD' END AS integ FROM children_fx""", ["children_fx"])(
    lambda c: c.select("session_id", "spi_in", text.gateway_enc("proposal").alias("enc"), text.gateway_bits("proposal").alias("key_bits"),
                       text.gateway_integ("proposal").alias("integ")))
query("p28_comparable", """SELECT session_id, spi, CASE WHEN enc LIKE '%GCM%' THEN 'gcm' WHEN enc LIKE '%CBC%' THEN 'cbc' END AS enc,
      CASE WHEN integ = 'sha1' THEN 'sha1' END AS integ, lower(mode) AS mode, CAST(ike_version AS VARCHAR) AS ike_version FROM predictions_fx""",
      ["predictions_fx"])(lambda p: p.select("session_id", "spi", *[
          text.comparable(F.lit(f), F.concat(F.lit("IKEv"), F.col(f)) if f == "ike_version" else F.col(f)).alias(f)
          for f in ("enc", "integ", "mode", "ike_version")]))
query("p29_parse_duration", """SELECT session_id, CAST(left(child_rekey_time, len(child_rekey_time) - 1) AS BIGINT)
      * CASE right(child_rekey_time, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 ELSE 3600 END AS seconds FROM sessions_fx""", ["sessions_fx"])(
    lambda s: s.select("session_id", text.parse_duration("child_rekey_time").alias("seconds")))
query("p31_iso_utc", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events", ["events"])(
    lambda e: e.select("event_id", text.iso_utc(F.unix_micros(F.col("ts").cast("timestamp"))).alias("iso")))


@query("p32_tag_value", """SELECT session_id, spi, mode, CASE WHEN mode IS NULL THEN 'unknown' ELSE 'inferred' END AS tag,
      CASE WHEN mode IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence FROM predictions_fx""", ["predictions_fx"])
def _p32(p):
    t = p.withColumn("t", known_or_unknown(F.col("mode"), 0.9))
    return t.select("session_id", "spi", tag_value("t").alias("mode"), F.col("t.tag").alias("tag"), F.col("t.confidence").alias("confidence"))


@query("p33_in_range", """SELECT analysis_id, status FROM analyses_fx
      WHERE created >= (SELECT max(created) FROM analyses_fx) - INTERVAL 720 HOUR""", ["analyses_fx"])
def _p33(a):
    from wiretally.operators.readmodels import in_range
    now = a.agg(F.max("created").alias("now"))
    return in_range(a, 720, now).select("analysis_id", "status")
