"""SA and flow-window queries."""

from pyspark.sql import functions as F

from wiretally.operators import sa, windows
from wiretally.registry.base import query


query("a1_sa_tracks", """
    SELECT capture_id, spi, min(ts_us) AS first_us, max(ts_us) AS last_us, CAST(count(*) AS BIGINT) AS packet_count,
      bool_or(udp_encapsulated) AS udp_encapsulated, bool_or(seq > 4294967295) AS esn_suspected, min(packet_no) AS first_packet,
      arg_min(src, (packet_no, src, dst)) AS src, arg_min(dst, (packet_no, src, dst)) AS dst
    FROM esp_fx GROUP BY capture_id, spi""", ["esp_fx"])(sa.sa_tracks)


@query("a2_sa_lifetime", """
    SELECT capture_id, spi, CASE WHEN max(ts_us) - min(ts_us) >= 1000000
      THEN CAST(round_even((max(ts_us) - min(ts_us)) / 1e6, 0) AS BIGINT) END AS rekey_interval_s
    FROM esp_fx GROUP BY capture_id, spi""", ["esp_fx"])
def _a2(esp):
    return sa.sa_lifetime(sa.sa_tracks(esp)).select("capture_id", "spi", "rekey_interval_s")


@query("a3_esn_suspected", """
    SELECT capture_id, spi, bool_or(seq > 4294967295) AS esn_suspected FROM esp_fx GROUP BY 1, 2""", ["esp_fx"])
def _a3(esp):
    return sa.sa_tracks(esp).select("capture_id", "spi", "esn_suspected")


STRUCTURE_SQL = """
    flags AS (SELECT capture_id, spi, bool_or(udp_encapsulated) AS natt FROM esp_fx GROUP BY 1, 2),
    bodies AS (SELECT e.capture_id, e.spi, e.length - 20 - CASE WHEN natt THEN 8 ELSE 0 END AS body
               FROM esp_fx e JOIN flags USING (capture_id, spi)),
    hyp AS (SELECT mode, icv, CASE mode WHEN 'CBC' THEN 0 ELSE 1 END AS rank
            FROM (VALUES ('CBC'), ('GCM')) m(mode), (VALUES (12), (16), (24), (32)) i(icv)),
    shares AS (SELECT capture_id, spi, mode, icv, rank,
        avg(CASE WHEN mode = 'CBC' THEN CASE WHEN body - 24 - icv > 0 AND (body - 24 - icv) % 16 = 0 THEN 1.0 ELSE 0.0 END
                 ELSE CASE WHEN body - 20 - icv >= 0 AND (body - 20 - icv) % 16 = 0 THEN 1.0 ELSE 0.0 END END) AS share
      FROM bodies, hyp GROUP BY ALL),
    structure AS (SELECT capture_id, spi, mode AS cipher_mode, CAST(icv AS BIGINT) AS icv_len, share AS consistency FROM shares
      QUALIFY row_number() OVER (PARTITION BY capture_id, spi ORDER BY share DESC, rank, icv) = 1)"""

query("a4_esp_structure", f"WITH {STRUCTURE_SQL} SELECT capture_id, spi, cipher_mode, icv_len, round(consistency, 6) AS consistency FROM structure",
      ["esp_fx"])(sa.esp_structure)

SIZES_SQL = """
    lists AS (SELECT capture_id, spi, list_sort(list(length)) AS l, avg(length) AS mean_len, stddev_pop(length) AS std_len
              FROM esp_fx GROUP BY 1, 2),
    sizes AS (SELECT capture_id, spi, CAST(l[1] AS DOUBLE) AS min_len,
        CAST(l[1 + CAST(floor(0.1::DOUBLE*(len(l)-1)) AS INT)] AS DOUBLE) AS p10_len,
        CAST(l[1 + len(l)//2] AS DOUBLE) AS p50_len,
        CAST(l[1 + CAST(floor(0.9::DOUBLE*(len(l)-1)) AS INT)] AS DOUBLE) AS p90_len, mean_len, std_len FROM lists)"""

query("a5_size_offsets", f"""WITH {SIZES_SQL}
    SELECT capture_id, spi, min_len, p10_len, p50_len, p90_len, round(mean_len, 6) AS mean_len, round(std_len, 6) AS std_len FROM sizes""",
      ["esp_fx"])(sa.size_offsets)


@query("a11_sa_features", f"""WITH {STRUCTURE_SQL}, {SIZES_SQL},
    rk AS (SELECT capture_id, CAST(count(*) AS DOUBLE) AS c, CAST(min(msg_length) AS DOUBLE) AS lo, avg(msg_length) AS mean
           FROM ike_fx WHERE major = 2 AND exchange = 36 GROUP BY 1)
    SELECT s.capture_id, s.spi, CAST(count(*) AS DOUBLE) AS packet_count, any_value(z.min_len) AS min_len,
      any_value(z.p10_len) AS p10_len, any_value(z.p50_len) AS p50_len, any_value(z.p90_len) AS p90_len,
      round(any_value(z.mean_len), 6) AS mean_len, round(any_value(z.std_len), 6) AS std_len,
      round(any_value(s.consistency), 6) AS cbc_consistency, CAST(any_value(s.icv_len) AS DOUBLE) AS icv_len,
      CAST(bool_or(e.udp_encapsulated) AS DOUBLE) AS natt, CAST(0 AS DOUBLE) AS ip_v6,
      coalesce(any_value(rk.c), 0) AS rekey_count, coalesce(any_value(rk.lo), 0) AS rekey_len_min,
      coalesce(round(any_value(rk.mean), 6), 0) AS rekey_len_mean
    FROM structure s JOIN sizes z USING (capture_id, spi) JOIN esp_fx e USING (capture_id, spi)
    LEFT JOIN rk USING (capture_id) GROUP BY 1, 2""",
       ["esp_fx", "ike_fx"])
def _a11(esp, ike):
    from wiretally.operators.ike import rekey_stats
    return sa.sa_features(sa.sa_profile(esp), rekey_stats(ike))


# The oracle walks each SA packet by packet (recursive CTE over distinct times).
WINDOW_SQL = """
    stamps AS (SELECT capture_id, spi, list_sort(list(DISTINCT ts_us)) AS ts FROM esp_fx GROUP BY 1, 2),
    walk AS (SELECT capture_id, spi, ts, ts[1] AS win_us FROM stamps
      UNION ALL SELECT capture_id, spi, ts, list_filter(ts, lambda x: x >= win_us + 5000000)[1] FROM walk
      WHERE len(list_filter(ts, lambda x: x >= win_us + 5000000)) > 0),
    wins AS (SELECT capture_id, spi, win_us, coalesce(lead(win_us) OVER (PARTITION BY capture_id, spi ORDER BY win_us), 9e18) AS nxt FROM walk),
    placed AS (SELECT e.*, w.win_us FROM esp_fx e JOIN wins w ON e.capture_id = w.capture_id AND e.spi = w.spi
               AND e.ts_us >= w.win_us AND e.ts_us < w.nxt),
    seq AS (SELECT *, ts_us - lag(ts_us) OVER w AS gap FROM placed WINDOW w AS (PARTITION BY capture_id, spi, win_us ORDER BY ts_us, packet_no, length, src)),
    seq2 AS (SELECT *, lag(gap) OVER (PARTITION BY capture_id, spi, win_us ORDER BY ts_us, packet_no, length, src) AS gap_before,
      first_value(src) OVER (PARTITION BY capture_id, spi ORDER BY ts_us, packet_no, length, src) AS src0 FROM seq)"""

query("w2_anchored_windows", f"""WITH RECURSIVE {WINDOW_SQL.strip()}
    SELECT capture_id, spi, packet_no, ts_us, length, win_us FROM placed""")(
    lambda spark, d: windows.anchored_windows(_esp(spark, d)).select("capture_id", "spi", "packet_no", "ts_us", "length", "win_us"))


def _esp(spark, d):
    from wiretally.fixtures import view
    return view(spark, d, "esp_fx")


@query("w1_inter_arrival", f"""WITH RECURSIVE {WINDOW_SQL.strip()}
    SELECT capture_id, spi, win_us, ts_us, CAST(count(*) AS BIGINT) AS n,
      CAST(CASE WHEN ts_us > win_us THEN max(gap) END AS BIGINT) AS gap_us FROM seq GROUP BY 1, 2, 3, 4""", ["esp_fx"])
def _w1(esp):
    return windows.inter_arrival(esp)


query("w3_burst_count", f"""WITH RECURSIVE {WINDOW_SQL.strip()}
    SELECT capture_id, spi, win_us, CAST(count(*) FILTER (WHERE gap >= 20000 AND gap_before < 20000) AS BIGINT) AS bursts
    FROM seq2 GROUP BY 1, 2, 3""", ["esp_fx"])(windows.burst_count)


@query("w4_head_sequence", f"""WITH RECURSIVE {WINDOW_SQL.strip()},
    head AS (SELECT *, row_number() OVER (PARTITION BY capture_id, spi, win_us ORDER BY ts_us, packet_no, length, src) AS i FROM seq2)
    SELECT capture_id, spi, win_us, string_agg(CAST(length AS VARCHAR), ' ' ORDER BY i) AS head_sizes,
      string_agg(CASE WHEN src = src0 THEN '1' ELSE '0' END, ' ' ORDER BY i) AS head_dirs
    FROM head WHERE i <= 32 GROUP BY 1, 2, 3""", ["esp_fx"])
def _w4(esp):
    out = windows.head_sequence(esp)
    return out.withColumns({c: F.concat_ws(" ", F.col(c).cast("array<string>")) for c in ("head_sizes", "head_dirs")})


query("w5_window_offset", f"""WITH RECURSIVE {WINDOW_SQL.strip()}
    SELECT capture_id, spi, win_us, win_us - min(win_us) OVER (PARTITION BY capture_id, spi) AS t0_us FROM walk""",
      ["esp_fx"])(windows.window_offset)

query("w6_replay_resets", """
    WITH s AS (SELECT capture_id, spi, seq, lag(seq) OVER (PARTITION BY capture_id, spi ORDER BY packet_no, seq) AS prev FROM esp_fx)
    SELECT capture_id, spi, CAST(count(*) FILTER (WHERE prev - seq > 2147483647) AS BIGINT) AS replay_resets,
      CASE WHEN count(*) FILTER (WHERE prev - seq > 2147483647) > 0 THEN CAST(0 AS BIGINT) END AS replay_window
    FROM s GROUP BY 1, 2""", ["esp_fx"])(sa.replay_resets)

FLOW_SQL = f"""{WINDOW_SQL.strip()},
    flow AS (SELECT capture_id, spi, win_us, CAST(count(*) AS DOUBLE) AS n_packets, avg(length) AS len_mean,
      stddev_pop(length) AS len_std, list_sort(list(length)) AS l, coalesce(avg(gap)/1e6, 0) AS iat_mean,
      coalesce(stddev_pop(gap)/1e6, 0) AS iat_std,
      CAST(count(*) FILTER (WHERE gap >= 20000 AND gap_before < 20000) AS DOUBLE) AS bursts,
      coalesce(sum(length) FILTER (WHERE src = src0), 0) AS up, coalesce(sum(length) FILTER (WHERE src <> src0), 0) AS down,
      count(*) / greatest((max(ts_us) - min(ts_us))/1e6, 1e-6) AS packets_per_s
      FROM seq2 GROUP BY 1, 2, 3)"""


@query("a12_flow_window_features", f"""WITH RECURSIVE {FLOW_SQL}
    SELECT capture_id, spi, win_us, n_packets, round(len_mean, 6) AS len_mean, round(len_std, 6) AS len_std,
      CAST(l[1 + CAST(floor(0.1::DOUBLE*(len(l)-1)) AS INT)] AS DOUBLE) AS len_p10, CAST(l[1 + len(l)//2] AS DOUBLE) AS len_p50,
      CAST(l[1 + CAST(floor(0.9::DOUBLE*(len(l)-1)) AS INT)] AS DOUBLE) AS len_p90,
      round(iat_mean, 6) AS iat_mean, round(iat_std, 6) AS iat_std, bursts,
      CASE WHEN down = 0 THEN CAST(1000 AS DOUBLE) ELSE round(up/down, 6) END AS updown_ratio, round(packets_per_s, 6) AS packets_per_s
    FROM flow""", ["esp_fx"])
def _a12(esp):
    return windows.traffic_features(windows.flow_window_features(esp))


@query("p30_finite", """
    WITH r AS (SELECT capture_id, spi, src, sum(length) AS b FROM esp_fx GROUP BY 1, 2, 3),
    q AS (SELECT capture_id, spi, sum(b) FILTER (WHERE src <> '172.30.0.3') AS up, sum(b) FILTER (WHERE src = '172.30.0.3') AS down FROM r GROUP BY 1, 2)
    SELECT capture_id, spi, CASE WHEN down IS NULL THEN NULL ELSE round(CAST(up AS DOUBLE)/down, 6) END AS report_ratio,
      CASE WHEN down IS NULL THEN CAST(1000 AS DOUBLE) ELSE round(CAST(up AS DOUBLE)/down, 6) END AS feature_ratio FROM q""", ["esp_fx"])
def _p30(esp):
    from wiretally.functions.text import finite
    up = F.sum(F.when(F.col("src") != "172.30.0.3", F.col("length")).otherwise(0)).cast("double")
    down = F.sum(F.when(F.col("src") == "172.30.0.3", F.col("length")).otherwise(0)).cast("double")
    ratio = esp.groupBy("capture_id", "spi").agg(F.when(down == 0, float("inf")).otherwise(F.try_divide(up, down)).alias("ratio"))
    return ratio.select("capture_id", "spi", finite("ratio").alias("report_ratio"), finite("ratio", 1000.0).alias("feature_ratio"))


query("w15_link_rekeys", """
    WITH t AS (SELECT capture_id, spi, min(ts_us) AS f, max(ts_us) AS l, min(packet_no) AS p FROM esp_fx GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY f, p, spi) AS i,
            min(l) OVER (PARTITION BY capture_id ORDER BY f, p, spi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM t),
    roots AS (SELECT * FROM r WHERE ended IS NULL OR f < ended)
    SELECT r.capture_id, r.spi, arg_min(k.spi, k.i) AS rekey_of
    FROM r LEFT JOIN roots k ON k.capture_id = r.capture_id AND k.l <= r.f AND k.spi <> r.spi GROUP BY 1, 2""", ["esp_fx"])(
    lambda esp: sa.link_rekeys(sa.sa_tracks(esp)).select("capture_id", "spi", "rekey_of"))

query("j3_rekey_candidates", """
    WITH t AS (SELECT capture_id, spi, min(ts_us) AS f, max(ts_us) AS l FROM esp_fx GROUP BY 1, 2)
    SELECT a.capture_id, a.spi, arg_max(b.spi, (b.l, b.f, b.spi)) AS candidate
    FROM t a LEFT JOIN t b ON b.capture_id = a.capture_id AND b.l <= a.f AND b.spi <> a.spi GROUP BY 1, 2""", ["esp_fx"])(
    lambda esp: sa.rekey_candidates(sa.sa_tracks(esp)))
