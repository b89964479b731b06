"""Trailing-window, flow and detector queries."""

from functools import reduce

from pyspark.sql import functions as F

from wiretally.operators import scan
from wiretally.plans import threats as th
from wiretally.registry.base import query
from wiretally.registry.packets import FLOW_ID_SQL, INSIDE_SQL, ENTROPY_SQL, FEATURES_SQL, LABEL_SQL

OUT = f"({INSIDE_SQL.format('src')} AND NOT {INSIDE_SQL.format('dst')})"
IN = f"({INSIDE_SQL.format('dst')} AND NOT {INSIDE_SQL.format('src')})"


def cool(src, key, name="kept", length=30_000_000):
    """Recursive SQL that walks the triggers of each key (src must be one row per key and ts_us)."""
    return f"""lists AS (SELECT {key}, list_sort(list(DISTINCT ts_us)) AS ts FROM {src} GROUP BY 1),
    hops AS (SELECT {key}, ts, ts[1] AS ts_us FROM lists UNION ALL
      SELECT {key}, ts, list_filter(ts, lambda x: x >= ts_us + {length})[1] FROM hops WHERE len(list_filter(ts, lambda x: x >= ts_us + {length})) > 0),
    {name} AS (SELECT {key}, ts_us FROM hops)"""


# --- trailing windows -------------------------------------------------------

query("w7_rolling_count", """SELECT DISTINCT dst, ts_us, CAST(count(*) OVER (PARTITION BY dst ORDER BY ts_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS packets FROM packets_fx""",
      ["packets_fx"])(lambda p: th.rolling_count(p, "dst"))
query("w8_rolling_distinct", """WITH r AS (SELECT dst, ts_us, list_unique(list(CASE WHEN ip_proto = 6 AND (tcp_flags & 2) > 0 AND (tcp_flags & 16) = 0 THEN src END)
      OVER (PARTITION BY dst ORDER BY ts_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW)) AS n, ip_proto, tcp_flags FROM packets_fx)
    SELECT DISTINCT dst, ts_us, CAST(n AS BIGINT) AS syn_sources FROM r WHERE ip_proto = 6 AND (tcp_flags & 2) > 0 AND (tcp_flags & 16) = 0""", ["packets_fx"])(
    lambda p: th.rolling_distinct(p, "dst", "src", (F.col("ip_proto") == 6) & th.is_syn(), name="syn_sources"))
TARGETS = """tg AS (SELECT packet_no, src, sport, dst, dport, ip_proto, ts_us, CAST(len(list_distinct(list(concat(dst, ':', dport)) OVER (PARTITION BY src ORDER BY ts_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW))) AS BIGINT) AS targets FROM packets_fx)"""
query("w10_rolling_targets", f"WITH {TARGETS} SELECT DISTINCT src, ts_us, targets FROM tg", ["packets_fx"])(th.rolling_targets)
DNSN = "dn AS (SELECT *, CAST(count(*) OVER (PARTITION BY src ORDER BY ts_us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS queries_30s FROM dns_fx)"
query("w11_rolling_dns", f"WITH {DNSN} SELECT DISTINCT src, ts_us, queries_30s FROM dn", ["dns_fx"])(th.rolling_dns)

# --- flows ------------------------------------------------------------------

FLOW = f"""fl AS (SELECT *, {FLOW_ID_SQL} AS flow_id, {OUT} AS o, {IN} AS i FROM flow_fx),
    g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow_id ORDER BY ts_us) AS gap FROM fl),
    ep AS (SELECT *, max(CASE WHEN gap IS NULL OR gap > 60000000 THEN ts_us END) OVER (PARTITION BY flow_id ORDER BY ts_us) AS epoch_us FROM g)"""
query("w9_flow_epochs", f"WITH {FLOW} SELECT DISTINCT flow_id, ts_us, epoch_us FROM ep", ["flow_fx"])(
    lambda p: th.flow_epochs(th._flow_points(th.with_flow(p))).select("flow_id", "ts_us", "epoch_us"))
query("a21_flows", f"""WITH {FLOW} SELECT flow_id, epoch_us, CAST(count(*) AS BIGINT) AS packets, CAST(coalesce(sum(length) FILTER (WHERE o), 0) AS BIGINT) AS bytes_out,
      CAST(coalesce(sum(length) FILTER (WHERE i), 0) AS BIGINT) AS bytes_in, CAST(count(*) FILTER (WHERE (tcp_flags & 2) > 0 AND (tcp_flags & 16) = 0) AS BIGINT) AS syns, max(ts_us) AS last_us
    FROM ep GROUP BY 1, 2""", ["flow_fx"])(th.flows)
RUN = FLOW + """, rb AS (SELECT *, CAST(sum(CASE WHEN o THEN length ELSE 0 END) OVER w AS BIGINT) AS bytes_out, CAST(sum(CASE WHEN i THEN length ELSE 0 END) OVER w AS BIGINT) AS bytes_in
      FROM ep WINDOW w AS (PARTITION BY flow_id, epoch_us ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
query("w12_running_bytes", f"WITH {RUN} SELECT DISTINCT flow_id, ts_us, epoch_us, bytes_out, bytes_in FROM rb", ["flow_fx"])(
    lambda p: th.running_bytes(p).select("flow_id", "ts_us", "epoch_us", "bytes_out", "bytes_in"))
query("a22_latest_metadata", f"""SELECT {FLOW_ID_SQL} AS flow_id, arg_max(tls, (ts_us, packet_no)) AS tls, arg_max(packet_no, (ts_us, packet_no)) AS sni_length
    FROM beacon_fx GROUP BY 1""", ["beacon_fx"])(
    lambda b: th.latest_metadata(_full_tls(b).withColumn("sni_length", F.col("packet_no"))).select("flow_id", "tls", "sni_length"))


def _full_tls(b):
    return b.withColumns({c: F.lit(0.0) for c in ("tls_version", "quic_version", "handshake_len", "cipher_count", "sni_length", "extension_count")})


BEACON = f"""bf AS (SELECT *, {FLOW_ID_SQL} AS flow_id FROM beacon_fx),
    bg AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY flow_id ORDER BY ts_us) AS idle FROM bf),
    st AS (SELECT *, (ts_us - lag(ts_us) OVER p)/1e6 AS gap, row_number() OVER p AS rn FROM bg WHERE (idle IS NULL OR idle > 60000000) AND {OUT}
      WINDOW p AS (PARTITION BY src, dst, dport, ip_proto ORDER BY ts_us, packet_no)),
    bs AS (SELECT *, avg(gap) OVER q AS m, stddev_pop(gap) OVER q AS s, least(12, rn) AS obs FROM st
      WINDOW q AS (PARTITION BY src, dst, dport, ip_proto ORDER BY ts_us, packet_no ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
    bt AS (SELECT * FROM bs WHERE obs >= 4 AND m >= 2 AND CASE WHEN m > 0 THEN s/m ELSE 1 END <= 0.15)"""
query("w13_beacon_stats", f"""WITH {BEACON} SELECT packet_no, round(m, 6) AS interval_mean, round(CASE WHEN m > 0 THEN s/m ELSE 1 END, 6) AS interval_cv, obs AS observations FROM bs WHERE obs >= 2""",
      ["beacon_fx"])(lambda p: th.beacon_stats(th.connection_starts(p)).select("packet_no", "interval_mean", "interval_cv", "observations"))

# --- cooldown ---------------------------------------------------------------

query("w14_cooldown", f"""WITH RECURSIVE {cool('dns_fx', 'src')} SELECT src, ts_us FROM kept""", ["dns_fx"])(
    lambda d: th.cooldown(d.select("src", "ts_us", "packet_no"), "src").select("src", "ts_us"))

# --- detectors --------------------------------------------------------------

DDOS = """w AS (SELECT *, CAST(count(*) OVER x AS BIGINT) AS n,
      CAST(len(list_distinct(list_filter(list(CASE WHEN ip_proto = 6 AND (tcp_flags & 2) > 0 AND (tcp_flags & 16) = 0 THEN src END) OVER x, lambda v: v IS NOT NULL))) AS BIGINT) AS syn,
      CAST(len(list_distinct(list_filter(list(CASE WHEN ip_proto = 17 THEN src END) OVER x, lambda v: v IS NOT NULL))) AS BIGINT) AS udp
      FROM packets_fx WINDOW x AS (PARTITION BY dst ORDER BY ts_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW)),
    dt AS (SELECT * FROM w WHERE n >= 100 AND (syn >= 5 OR udp >= 5))"""
query("k1_ddos_triggers", f"""WITH {DDOS} SELECT dst, ts_us, n AS packets_1s, syn AS syn_sources, udp AS udp_sources, round(least(0.99, n/200), 6) AS confidence,
      CASE WHEN syn >= 5 THEN 'syn_flood' ELSE 'udp_flood_or_reflection' END AS subtype FROM dt""", ["packets_fx"])(lambda p: th.ddos_triggers(p).drop("who"))
ENT = """en AS (SELECT dst, at_us, -sum(c/t::DOUBLE*log2(c/t::DOUBLE)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY dst, at_us) AS t FROM
      (SELECT k.dst, k.ts_us AS at_us, p.src, count(*) AS c FROM kept k JOIN packets_fx p ON p.dst = k.dst AND p.ts_us BETWEEN k.ts_us - 1000000 AND k.ts_us GROUP BY 1, 2, 3)) GROUP BY 1, 2)"""
query("a20_source_entropy", f"WITH RECURSIVE {DDOS}, {cool('dt', 'dst')}, {ENT} SELECT dst, at_us AS ts_us, round(h, 6) AS source_entropy FROM en", ["packets_fx"])(
    lambda p: th.source_entropy(th.cooldown(th.ddos_triggers(p), "dst"), p))
query("k1_detect_ddos", f"""WITH RECURSIVE {DDOS}, {cool('dt', 'dst')}
    SELECT dt.ts_us, {FLOW_ID_SQL.replace('src', 'dt.src').replace('dst', 'dt.dst')} AS flow_id, 'ddos' AS threat_class, 'high' AS severity, round(least(0.99, n/200), 4) AS confidence
    FROM kept JOIN dt ON dt.dst = kept.dst AND dt.ts_us = kept.ts_us""", ["packets_fx"])(
    lambda p: th.detect_ddos(p).select("ts_us", "flow_id", "threat_class", "severity", "confidence"))
SCAN = f"{TARGETS}, sc AS (SELECT *, {FLOW_ID_SQL} AS flow_id FROM tg WHERE targets >= 10)"
query("k2_port_scan_triggers", f"WITH {SCAN} SELECT DISTINCT src, ts_us, flow_id, targets, round(least(0.99, targets/30), 6) AS confidence FROM sc", ["packets_fx"])(th.port_scan_triggers)
query("k2_detect_port_scan", f"""WITH RECURSIVE {SCAN}, {cool('sc', 'flow_id')}
    SELECT k.ts_us, k.flow_id, round(least(0.99, targets/30), 4) AS confidence FROM kept k JOIN sc ON sc.flow_id = k.flow_id AND sc.ts_us = k.ts_us""", ["packets_fx"])(
    lambda p: th.detect_port_scan(p).select("ts_us", "flow_id", "confidence"))
DGA = f"""lb AS (SELECT *, {LABEL_SQL.format('qname')} AS lab FROM dns_fx), le AS (SELECT *, {ENTROPY_SQL.format('lab')} AS ent FROM lb),
    dg AS (SELECT *, {FLOW_ID_SQL} AS flow_id, least(0.9, ent/5) AS conf FROM le WHERE len(lab) >= 18 AND ent >= 3.5 AND least(0.9, ent/5) >= 0.75)"""
query("k3_dga_triggers", f"WITH {DGA} SELECT packet_no, round(ent, 5) AS entropy, round(conf, 5) AS confidence FROM dg", ["dns_fx"])(
    lambda d: th.dga_triggers(d).select("packet_no", F.round("entropy", 5).alias("entropy"), F.round("confidence", 5).alias("confidence")))
query("k3_detect_dga", f"WITH RECURSIVE {DGA}, {cool('dg', 'flow_id')} SELECT flow_id, ts_us, 'dga' AS threat_class FROM kept", ["dns_fx"])(
    lambda d: th.detect_dga(d).select("flow_id", "ts_us", "threat_class"))
TUN = f"""{DNSN}, lb AS (SELECT *, {LABEL_SQL.format('qname')} AS lab FROM dn), tn AS (SELECT *, {FLOW_ID_SQL} AS flow_id FROM lb
      WHERE len(qname) >= 65 AND {ENTROPY_SQL.format('lab')} >= 3.4 AND queries_30s >= 3)"""
query("k4_tunnel_triggers", f"WITH {TUN} SELECT packet_no, queries_30s, flow_id, CAST(0.82 AS DOUBLE) AS confidence FROM tn", ["dns_fx"])(
    lambda d: th.tunnel_triggers(d).select("packet_no", "queries_30s", "flow_id", "confidence"))
query("k4_detect_dns_tunneling", f"WITH RECURSIVE {TUN}, {cool('tn', 'flow_id')} SELECT flow_id, ts_us, 'high' AS severity FROM kept", ["dns_fx"])(
    lambda d: th.detect_dns_tunneling(d).select("flow_id", "ts_us", "severity"))
EXF = RUN + ", ex AS (SELECT DISTINCT flow_id, ts_us, bytes_out, bytes_in, bytes_out/greatest(bytes_in, 1) AS ratio FROM rb WHERE o AND bytes_out > 1000000 AND bytes_out/greatest(bytes_in, 1) >= 10)"
query("k5_exfiltration_triggers", f"WITH {EXF} SELECT flow_id, ts_us, bytes_out, bytes_in, round(ratio, 6) AS ratio, round(least(0.95, ratio/40), 6) AS confidence FROM ex", ["flow_fx"])(th.exfiltration_triggers)
query("k5_detect_exfiltration", f"WITH RECURSIVE {EXF}, {cool('ex', 'flow_id')} SELECT k.flow_id, k.ts_us, round(least(0.95, ratio/40), 4) AS confidence FROM kept k JOIN ex ON ex.flow_id = k.flow_id AND ex.ts_us = k.ts_us", ["flow_fx"])(
    lambda p: th.detect_exfiltration(p).select("flow_id", "ts_us", "confidence"))
query("k6_detect_beaconing", f"WITH RECURSIVE {BEACON}, {cool('bt', 'flow_id')} SELECT flow_id, ts_us, CAST(0.85 AS DOUBLE) AS confidence FROM kept", ["beacon_fx"])(
    lambda p: th.detect_beaconing(p).select("flow_id", "ts_us", "confidence"))
query("k7_periodic_encrypted", f"WITH RECURSIVE {BEACON}, pe AS (SELECT * FROM bt WHERE tls OR quic), {cool('pe', 'flow_id')} SELECT flow_id, ts_us, CAST(0.75 AS DOUBLE) AS confidence FROM kept", ["beacon_fx"])(
    lambda p: th.detect_periodic_encrypted(p).select("flow_id", "ts_us", "confidence"))
query("k8_detect_handshake", f"""WITH RECURSIVE hs AS (SELECT *, {FLOW_ID_SQL} AS flow_id, CAST(50 + packet_no % 50 AS DOUBLE)/100 AS score FROM beacon_fx WHERE tls), hh AS (SELECT * FROM hs WHERE score >= 0.9), {cool('hh', 'flow_id')}
    SELECT k.flow_id, k.ts_us, round(score, 4) AS confidence FROM kept k JOIN hh ON hh.flow_id = k.flow_id AND hh.ts_us = k.ts_us""", ["beacon_fx"])(
    lambda b: th.detect_handshake(b.filter("tls").withColumn("handshake_len", F.lit(80.0)), b.select(
        "packet_no", ((50 + F.col("packet_no") % 50).cast("double") / 100).alias("score"), F.lit("m-1").alias("model_version"))).select("flow_id", "ts_us", "confidence"))
query("k9_to_alerts", f"""WITH RECURSIVE {BEACON}, {cool('bt', 'flow_id')}
    SELECT concat('al_', substr(sha256(concat(flow_id, ':beaconing:', ts_us//1000000)), 1, 24)) AS id, ts_us/1e6 AS timestamp, flow_id, 'replay' AS source, 'heuristic-v1' AS model_version FROM kept""", ["beacon_fx"])(
    lambda p: th.to_alerts(th.detect_beaconing(p)).select("id", "timestamp", "flow_id", "source", "model_version"))

query("k10_features_dga", f"""WITH {DNSN}, l AS (SELECT packet_no, qname AS name, queries_30s, {LABEL_SQL.format('qname')} AS lab FROM dn)
    SELECT packet_no, {FEATURES_SQL}, round(queries_30s/30.0::DOUBLE, 6) AS qps FROM l""", ["dns_fx"])(lambda d: th.detector_features(d, "dga").drop("ts_us", "src", "dst"))
query("k10_features_dns_tunneling", f"""WITH {DNSN}, l AS (SELECT packet_no, qname, CAST(queries_30s AS DOUBLE) AS queries_30s, CAST(qtype AS DOUBLE) AS qtype, {LABEL_SQL.format('qname')} AS lab FROM dn)
    SELECT packet_no, CAST(len(qname) AS DOUBLE) AS name_len, {ENTROPY_SQL.format('lab')} AS entropy, queries_30s, qtype FROM l""", ["dns_fx"])(lambda d: th.detector_features(d, "dns_tunneling").drop("ts_us", "src", "dst"))
query("k10_features_beaconing", f"""WITH {BEACON} SELECT packet_no, round(m, 6) AS interval_mean, round(CASE WHEN m > 0 THEN s/m ELSE 1 END, 6) AS interval_cv, CAST(obs AS DOUBLE) AS observations FROM bs WHERE obs >= 2""", ["beacon_fx"])(
    lambda p: th.detector_features(p, "beaconing").drop("ts_us", "src", "dst"))
query("k10_features_encrypted_malware", """SELECT packet_no, CAST(0 AS DOUBLE) AS interval_mean, CAST(1 AS DOUBLE) AS interval_cv, CAST(1 AS DOUBLE) AS observations, CAST(1 AS DOUBLE) AS tls, CAST(0 AS DOUBLE) AS quic,
      CAST(0 AS DOUBLE) AS tls_version, CAST(0 AS DOUBLE) AS quic_version, CAST(0 AS DOUBLE) AS handshake_len, CAST(0 AS DOUBLE) AS cipher_count, CAST(0 AS DOUBLE) AS sni_length, CAST(0 AS DOUBLE) AS extension_count FROM beacon_fx WHERE tls""", ["beacon_fx"])(
    lambda p: th.detector_features(p, "encrypted_malware", periodic=False).drop("ts_us", "src", "dst"))


#: The four packet views as one network on one clock; numbers and times are moved apart so that no two packets tie.
TRAFFIC = {"packets_fx": ("packet_no*4", "ts_us*4"), "dns_fx": ("packet_no*4 + 1", "ts_us*4 + 1"), "flow_fx": ("packet_no*4 + 2", "ts_us*4 + 2"), "beacon_fx": ("packet_no*4 + 3", "ts_us*4 + 3")}
_DNS, _TLS = ("qname", "qtype", "rcode"), ("tls", "quic")


def _part(name, cast="BIGINT"):
    number, time = TRAFFIC[name]
    fields = [f"CAST({c} AS {cast}) AS {c}" for c in ("sport", "dport", "ip_proto", "length", "tcp_flags")]
    if name == "dns_fx":
        fields[3:] = [f"CAST(80 AS {cast}) AS length", f"CAST(0 AS {cast}) AS tcp_flags"]
    text = [c if name == "dns_fx" and c == "qname" else f"CAST({c if name == 'dns_fx' else 'NULL'} AS {'VARCHAR' if c == 'qname' else cast}) AS {c}" for c in _DNS]
    flags = [c if name == "beacon_fx" else f"false AS {c}" for c in _TLS]
    return f"SELECT {number} AS packet_no, {time} AS ts_us, src, dst, {', '.join(fields + text + flags)} FROM {name}"


TRAFFIC_SQL = "all_p AS (" + " UNION ALL ".join(_part(n) for n in TRAFFIC) + "), all_d AS (SELECT * FROM all_p WHERE qname IS NOT NULL)"


def traffic(*views):
    """The same network as a DataFrame, one of all four views."""
    spark = views[0].sparkSession
    named = dict(zip(TRAFFIC, views))
    parts = [spark.sql(_part(n, "LONG").replace("VARCHAR", "STRING").replace(f"FROM {n}", "FROM {part}"), part=df) for n, df in named.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _over(sql, **tables):
    for name, new in tables.items():
        sql = sql.replace(name, new)
    return sql


def triggers_sql(extra=""):
    """Triggers of all seven detectors over all_p, as (k, ts_us, flow_id, threat_class, confidence)."""
    flow, beacon = _over(EXF, flow_fx="all_p"), _over(BEACON, beacon_fx="all_p")
    tunnel = _over(TUN, dns_fx="all_d").replace("lb AS", "lt AS").replace("FROM lb", "FROM lt")
    return f"""{TRAFFIC_SQL}, {_over(DDOS, packets_fx="all_p")}, {_over(SCAN, packets_fx="all_p")}, {_over(DGA, dns_fx="all_d")}, {tunnel}, {flow}, {beacon},
    trig AS (SELECT concat('dst:', dst, '|ddos') AS k, ts_us, {FLOW_ID_SQL} AS flow_id, 'ddos' AS threat_class, round(least(0.99, n/200), 4) AS confidence FROM dt
      UNION ALL SELECT concat(flow_id, '|scan'), ts_us, flow_id, 'port_scan', round(least(0.99, targets/30), 4) FROM sc
      UNION ALL SELECT concat(flow_id, '|dga'), ts_us, flow_id, 'dga', round(conf, 4) FROM dg
      UNION ALL SELECT concat(flow_id, '|tunnel'), ts_us, flow_id, 'dns_tunneling', 0.82 FROM tn
      UNION ALL SELECT concat(flow_id, '|exf'), ts_us, flow_id, 'data_exfiltration', round(least(0.95, ratio/40), 4) FROM ex
      UNION ALL SELECT concat(flow_id, '|beacon'), ts_us, flow_id, 'beaconing', 0.85 FROM bt
      UNION ALL SELECT concat(flow_id, '|malware'), ts_us, flow_id, 'encrypted_malware', 0.75 FROM bt WHERE tls OR quic{extra})"""


def alerts_sql(extra=""):
    return f"""WITH RECURSIVE {triggers_sql(extra)}, {cool('trig', 'k')}
    SELECT DISTINCT concat('al_', substr(sha256(concat(flow_id, ':', threat_class, ':', kept.ts_us//1000000)), 1, 24)) AS id, kept.ts_us/1e6 AS timestamp, flow_id, threat_class, confidence
    FROM kept JOIN trig ON trig.k = kept.k AND trig.ts_us = kept.ts_us"""


@query("k11_detect_all", alerts_sql(), list(TRAFFIC))
def _k11(*views):
    p = traffic(*views)
    return th.detect_all(p.drop(*_DNS, *_TLS), p.filter("qname IS NOT NULL"), p.filter("tls OR quic").select("packet_no", *_TLS)).select(
        "id", "timestamp", "flow_id", "threat_class", "confidence")


# Scores that stand in for four models: of names, of rhythms, of handshakes in a rhythm and of handshakes alone.
SCORE = {"dga": "CAST(60 + packet_no % 41 AS DOUBLE)/100", "dns_tunneling": "CAST(50 + packet_no % 47 AS DOUBLE)/100", "beaconing": "CAST(55 + packet_no % 43 AS DOUBLE)/100",
         "encrypted_malware": "CAST(65 + packet_no % 31 AS DOUBLE)/100", "handshake": "CAST(70 + packet_no % 29 AS DOUBLE)/100"}


def _scored_sql():
    sql = alerts_sql(f"""
      UNION ALL SELECT concat({FLOW_ID_SQL}, '|malware'), ts_us, {FLOW_ID_SQL}, 'encrypted_malware', round({SCORE['handshake']}, 4) FROM all_p WHERE (tls OR quic) AND {SCORE['handshake']} >= 0.9""")
    # Without heuristics: every name is judged by its score, every rhythm of four starts or more by its.
    sql = sql.replace("least(0.9, ent/5) AS conf FROM le WHERE len(lab) >= 18 AND ent >= 3.5 AND least(0.9, ent/5) >= 0.75", f"{SCORE['dga']} AS conf FROM le WHERE {SCORE['dga']} >= 0.75")
    start = sql.index("tn AS (SELECT")
    end = sql.index("queries_30s >= 3)", start) + len("queries_30s >= 3)")
    sql = sql[:start] + f"tn AS (SELECT *, {FLOW_ID_SQL} AS flow_id, {SCORE['dns_tunneling']} AS conf FROM lt WHERE {SCORE['dns_tunneling']} >= 0.75)" + sql[end:]
    sql = sql.replace("'dns_tunneling', 0.82 FROM tn", "'dns_tunneling', round(conf, 4) FROM tn")
    sql = sql.replace("bt AS (SELECT * FROM bs WHERE obs >= 4 AND m >= 2 AND CASE WHEN m > 0 THEN s/m ELSE 1 END <= 0.15)",
                      f"bt AS (SELECT *, {SCORE['beaconing']} AS conf_b, {SCORE['encrypted_malware']} AS conf_m FROM bs WHERE obs >= 4 AND {SCORE['beaconing']} >= 0.75)")
    sql = sql.replace("'beaconing', 0.85 FROM bt", "'beaconing', round(conf_b, 4) FROM bt")
    return sql.replace("'encrypted_malware', 0.75 FROM bt WHERE tls OR quic", f"'encrypted_malware', round(conf_m, 4) FROM bt WHERE (tls OR quic) AND conf_m >= 0.75 AND {SCORE['handshake']} < 0.9")


def score_tables(p):
    """Scores per packet and task, with a model's name."""
    return {task: p.select("packet_no", F.expr(text).alias("score"), F.lit(f"{task}-v1").alias("model_version")) for task, text in SCORE.items()}


@query("k11_with_scores", _scored_sql(), list(TRAFFIC))
def _k11_scored(*views):
    p = traffic(*views)
    found = th.detect_all(p.drop(*_DNS, *_TLS), p.filter("qname IS NOT NULL"), p.filter("tls OR quic").select("packet_no", *_TLS), scores=score_tables(p))
    return found.select("id", "timestamp", "flow_id", "threat_class", "confidence")


@query("t4_alert_feed", f"""WITH RECURSIVE {BEACON}, {cool('bt', 'flow_id')}
    SELECT concat('al_', substr(sha256(concat(flow_id, ':beaconing:', ts_us//1000000)), 1, 24)) AS id, ts_us/1e6 AS timestamp FROM kept ORDER BY 2 DESC, 1 DESC LIMIT 100""", ["beacon_fx"])
def _t4(p):
    from wiretally.operators.readmodels import alert_feed
    return alert_feed(th.to_alerts(th.detect_beaconing(p)), "beaconing").select("id", "timestamp")


query("a40_throughput_report", views=["packets_fx"])(lambda p: th.throughput_report(th.ddos_triggers(p), 1.0))
