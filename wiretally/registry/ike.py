"""IKE queries over messages decoded from derived frames and over the message view."""

from pyspark.sql import functions as F

from wiretally.functions.text import transform_name
from wiretally.operators import ike
from wiretally.registry.base import query
from wiretally.registry.packets import packets_from_frames
from wiretally.session import stage


def _messages(spark, d):
    return ike.ike_messages(packets_from_frames(spark, d))


FORM = "(event_id >> 2) % 3"
MSG_SQL = f"""msgs AS (SELECT event_id, user_id, event_id >> 6 AS init, {FORM} AS form, event_id % 8 = 3 AS response,
      concat('10.1.', CAST((user_id % 65536)//256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS src FROM events WHERE event_id % 4 = 3)"""

query("p5_ike_messages", f"""WITH {MSG_SQL}
    SELECT event_id AS packet_no, lpad(to_hex(init), 16, '0') AS initiator_spi, CAST(CASE WHEN form = 2 THEN 1 ELSE 2 END AS BIGINT) AS major,
      CAST(CASE form WHEN 0 THEN 34 WHEN 1 THEN 36 ELSE 4 END AS BIGINT) AS exchange, response AS is_response, event_id >> 2 AS msg_id,
      CAST(CASE form WHEN 0 THEN 28 + 40 + 72 + 8 + 12 WHEN 1 THEN 52 ELSE 28 END AS BIGINT) AS msg_length, form = 2 AS aggressive FROM msgs""")(
    lambda spark, d: _messages(spark, d).select("packet_no", "initiator_spi", "major", "exchange", "is_response", "msg_id", "msg_length", "aggressive"))

query("p6_ike_payloads", f"""WITH {MSG_SQL}
    SELECT event_id AS packet_no, CAST(n AS BIGINT) AS payload_no, CAST(t AS BIGINT) AS ptype, CAST(b AS BIGINT) AS body_bytes FROM msgs,
      (VALUES (0, 0, 33, 36), (0, 1, 34, 68), (0, 2, 41, 4), (0, 3, 43, 8), (1, 0, 46, 20)) v(f, n, t, b) WHERE f = form""")(
    lambda spark, d: ike.ike_payloads(_messages(spark, d)).select(
        "packet_no", "payload_no", "ptype", F.octet_length("body").alias("body_bytes")))

query("p7_ike_transforms", f"""WITH {MSG_SQL}
    SELECT event_id AS packet_no, CAST(n AS BIGINT) AS transform_no, CAST(t AS BIGINT) AS ttype,
      CAST(CASE WHEN t = 1 THEN CASE WHEN response THEN 20 ELSE 12 END ELSE id END AS BIGINT) AS tid,
      CAST(CASE WHEN t = 1 THEN CASE WHEN response THEN 256 ELSE 128 END END AS BIGINT) AS key_length,
      CASE t WHEN 1 THEN CASE WHEN response THEN 'AES-GCM-16-256' ELSE 'AES-CBC-128' END WHEN 3 THEN 'HMAC-SHA1-96' ELSE 'ECP-256' END AS name
    FROM msgs, (VALUES (0, 1, 0), (1, 3, 2), (2, 4, 19)) v(n, t, id) WHERE form = 0""")(
    lambda spark, d: ike.ike_transforms(ike.ike_payloads(_messages(spark, d))).select(
        "packet_no", "transform_no", "ttype", "tid", "key_length", "name"))

query("p9_payload_facts", f"""WITH {MSG_SQL}
    SELECT event_id AS packet_no, CAST(64 AS BIGINT) AS ke_size, true AS nat_detection, '4142434445464748' AS vendor_id FROM msgs WHERE form = 0""")(
    lambda spark, d: ike.payload_facts(ike.ike_payloads(_messages(spark, d))).groupBy("packet_no").agg(
        F.max("ke_size").alias("ke_size"), F.max("nat_detection").alias("nat_detection"), F.max("vendor_id").alias("vendor_id"))
    .filter("ke_size IS NOT NULL"))


def _sessions(spark, d):
    m = stage(_messages(spark, d))  # messages, payload facts and transforms are grouped apart; decoding takes longer than all three
    return ike.ike_sessions(m, ike.ike_payloads(m))


query("a6_ike_sessions", f"""WITH {MSG_SQL}
    SELECT lpad(to_hex(init), 16, '0') AS initiator_spi, src AS initiator, '203.0.113.7' AS responder,
      CAST(arg_min(CASE WHEN form = 2 THEN 1 ELSE 2 END, event_id) AS BIGINT) AS version, min(event_id) AS first_packet,
      array_to_string(list_sort(list(DISTINCT CASE form WHEN 0 THEN 34 WHEN 1 THEN 36 ELSE 4 END)), ',') AS exchanges,
      bool_or(form = 2) AS aggressive_mode, CAST(count(*) FILTER (WHERE form = 1) AS BIGINT) AS rekey_count,
      CAST(CASE WHEN bool_or(form = 0) THEN 64 END AS BIGINT) AS ke_size, bool_or(form = 0) AS nat_detection_seen,
      CASE WHEN bool_or(form = 0 AND NOT response) THEN 'AES-CBC-128,HMAC-SHA1-96,ECP-256' ELSE '' END AS offered,
      CASE WHEN bool_or(form = 0 AND response) THEN 'AES-GCM-16-256,HMAC-SHA1-96,ECP-256' ELSE '' END AS chosen
    FROM msgs GROUP BY init, src""")(
    lambda spark, d: _sessions(spark, d).select(
        "initiator_spi", "initiator", "responder", "version", "first_packet",
        F.concat_ws(",", F.col("exchanges").cast("array<string>")).alias("exchanges"), "aggressive_mode", "rekey_count", "ke_size",
        "nat_detection_seen", F.coalesce(F.concat_ws(",", "offered.name"), F.lit("")).alias("offered"),
        F.coalesce(F.concat_ws(",", "chosen.name"), F.lit("")).alias("chosen")))

query("a7_ike_summary", f"""WITH {MSG_SQL}
    SELECT lpad(to_hex(init), 16, '0') AS initiator_spi, least(src, '203.0.113.7') AS peer_a,
      CASE WHEN bool_or(form = 0 AND response) THEN 'AES-GCM-16-256' END AS enc_chosen,
      CASE WHEN bool_or(form = 0 AND NOT response) THEN 'AES-CBC-128' ELSE '' END AS enc_offered,
      CASE WHEN bool_or(form = 0 AND NOT response) THEN 'ECP-256' ELSE '' END AS dh_offered FROM msgs GROUP BY init, src""")(
    lambda spark, d: ike.ike_summary(_sessions(spark, d)).select(
        "initiator_spi", "peer_a", "enc_chosen", F.concat_ws(",", "enc_offered").alias("enc_offered"), F.concat_ws(",", "dh_offered").alias("dh_offered")))

query("p8_transform_name", """SELECT msg_no, CASE ttype
      WHEN 1 THEN concat(CASE tid WHEN 12 THEN 'AES-CBC' WHEN 20 THEN 'AES-GCM-16' ELSE concat('ENCR-', tid) END, CASE WHEN key_length > 0 THEN concat('-', key_length) ELSE '' END)
      WHEN 3 THEN CASE tid WHEN 2 THEN 'HMAC-SHA1-96' WHEN 12 THEN 'HMAC-SHA2-256-128' WHEN 14 THEN 'HMAC-SHA2-512-256' ELSE concat('INTEG-', tid) END
      WHEN 4 THEN CASE tid WHEN 2 THEN 'MODP-1024' WHEN 14 THEN 'MODP-2048' WHEN 19 THEN 'ECP-256' WHEN 20 THEN 'ECP-384' WHEN 31 THEN 'Curve25519' ELSE concat('DH-', tid) END
      ELSE concat('TYPE', ttype, '-', tid) END AS name FROM ike_fx""", ["ike_fx"])(
    lambda m: m.select("msg_no", transform_name().alias("name")))
query("p10_ke_group_check", """SELECT msg_no, CAST(CASE ke_size WHEN 256 THEN 14 WHEN 64 THEN 19 WHEN 96 THEN 20 END AS BIGINT) AS ke_group,
      CASE ke_size WHEN 256 THEN 14 WHEN 64 THEN 19 WHEN 96 THEN 20 END = tid AS ke_matches FROM ike_fx""", ["ike_fx"])(
    lambda m: ike.ke_group_check(m, dh_id="tid").select("msg_no", "ke_group", "ke_matches"))
query("p11_aggressive_mode", "SELECT session, bool_or(major = 1 AND exchange = 4) AS aggressive_mode FROM ike_fx GROUP BY 1", ["ike_fx"])(
    lambda m: m.groupBy("session").agg(F.max((F.col("major") == 1) & (F.col("exchange") == 4)).alias("aggressive_mode")))
query("a9_ike_version", """WITH s AS (SELECT capture_id, session, arg_min(major, msg_no) AS version FROM ike_fx GROUP BY 1, 2)
    SELECT capture_id, CAST(CASE WHEN min(version) = max(version) THEN min(version) END AS BIGINT) AS ike_version, CAST(count(*) AS BIGINT) AS sessions FROM s GROUP BY 1""",
      ["ike_fx"])(lambda m: ike.ike_version(m.groupBy("capture_id", "session").agg(F.min_by("major", "msg_no").alias("version"))))
query("a10_rekey_stats", """SELECT session, CAST(count(*) FILTER (WHERE major = 2 AND exchange = 36) AS BIGINT) AS rekey_count,
      CAST(coalesce(min(msg_length) FILTER (WHERE major = 2 AND exchange = 36), 0) AS DOUBLE) AS rekey_len_min,
      round(coalesce(avg(msg_length) FILTER (WHERE major = 2 AND exchange = 36), 0), 6) AS rekey_len_mean FROM ike_fx GROUP BY 1""",
      ["ike_fx"])(lambda m: ike.rekey_stats(m, ("session",)))


def _session_rows(m):
    return m.groupBy("capture_id", "session").agg(
        F.array_sort(F.collect_set("exchange")).alias("exchanges"), F.max_by("ke_size", F.when(F.col("ke_size").isNotNull(), F.col("msg_no"))).alias("ke_size"))


query("i6_pfs_rule", """WITH s AS (SELECT capture_id, session, bool_or(exchange = 36) AS r, arg_max(ke_size, msg_no) FILTER (WHERE ke_size IS NOT NULL) AS ke FROM ike_fx GROUP BY 1, 2),
    c AS (SELECT capture_id, bool_or(r) AS r, bool_or(coalesce(r AND ke >= 32, false)) AS k FROM s GROUP BY 1)
    SELECT capture_id, CASE WHEN r THEN k END AS pfs, CASE WHEN r THEN 'inferred' ELSE 'unknown' END AS pfs_tag,
      CAST(CASE WHEN NOT r THEN 0 WHEN k THEN 0.92 ELSE 0.08 END AS DOUBLE) AS pfs_confidence FROM c""", ["ike_fx"])(
    lambda m: ike.pfs_rule(_session_rows(m)))

query("i5_ike_suite", f"""WITH {MSG_SQL},
    s AS (SELECT init, src, min(event_id) AS first, bool_or(form = 0 AND response) AS ch, bool_or(form = 0 AND NOT response) AS offr, bool_or(form = 0) AS ke FROM msgs GROUP BY 1, 2)
    SELECT 'events' AS capture_id, CASE WHEN ch THEN 'AES-GCM-16-256' END AS ike_enc, CASE WHEN offr THEN 'HMAC-SHA1-96' END AS ike_integ,
      CASE WHEN offr THEN 'ECP-256' END AS ike_dh_group, CAST(CASE WHEN ke THEN 64 END AS BIGINT) AS ike_ke_size
    FROM s ORDER BY first, init LIMIT 1""")(lambda spark, d: ike.ike_suite(_sessions(spark, d)))
