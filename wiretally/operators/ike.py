"""IKE messages, payload chains, transforms and sessions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import constants as C
from wiretally.functions.binary import be_int, bind, byte_at, cut, size
from wiretally.functions.net import proto_class
from wiretally.functions.text import transform_name

SESSION = ("capture_id", "peer_a", "peer_b", "initiator_spi")


def ike_messages(packets: DataFrame) -> DataFrame:
    """One row per IKE datagram with a readable header; ``message`` is its bytes."""
    p = F.col("payload")
    natt = (F.col("sport") == 4500) | (F.col("dport") == 4500)
    marked = F.coalesce(natt & (F.hex(cut(p, 0, 4)) == "00000000"), F.lit(False))
    m = F.col("message")
    stated = be_int(m, 24, 4)
    rows = bind(packets.filter(proto_class() == "ike"),
                message=F.when(marked, cut(p, 4, size(p))).otherwise(p)).filter(size(m) >= 28)
    rows = bind(rows, major=F.shiftright(byte_at(m, 17), 4).cast("int")).filter(F.col("major").isin(1, 2))
    return bind(rows.select("capture_id", "packet_no", "ts_us", "src", "dst", "sport", "dport", "major", "message"),
                peer_a=F.least("src", "dst"), peer_b=F.greatest("src", "dst"),
                initiator_spi=F.hex(cut(m, 0, 8)), exchange=byte_at(m, 18).cast("int"),
                is_response=byte_at(m, 19).bitwiseAND(0x20) > 0, msg_id=be_int(m, 20, 4),
                msg_length=F.when(stated > 0, stated).otherwise(size(m)).cast("long"),
                first_payload=byte_at(m, 16).cast("int"),
                aggressive=(F.col("major") == 1) & (byte_at(m, 18) == 4))


def ike_payloads(messages: DataFrame) -> DataFrame:
    """One row per payload of the chain, in order; the chain ends at a type of 0 or a bad length."""
    m = F.col("message")
    limit = F.least(size(m).cast("long"), F.col("msg_length"))
    blank = F.array().cast("array<struct<ptype:int,at:bigint,len:bigint>>")
    start = F.struct(F.col("first_payload").cast("int").alias("np"), F.lit(28).cast("long").alias("off"),
                     blank.alias("out"))

    def step(acc, _):
        plen = be_int(m, acc["off"] + 2, 2)
        live = (acc["np"] != 0) & (acc["off"] + 4 <= limit) & F.coalesce(plen >= 4, F.lit(False))
        item = F.struct(acc["np"].alias("ptype"), (acc["off"] + 4).alias("at"), (plen - 4).alias("len"))
        return F.struct(
            F.when(live, byte_at(m, acc["off"]).cast("int")).otherwise(F.lit(0)).alias("np"),
            F.when(live, acc["off"] + plen).otherwise(acc["off"]).alias("off"),
            F.when(live, F.array_append(acc["out"], item)).otherwise(acc["out"]).alias("out"))

    chain = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.floor(limit / 4), F.lit(1).cast("long"))),
                        start, step, lambda acc: acc["out"])
    keep = [c for c in messages.columns if c not in ("message", "first_payload")]
    return (bind(messages, _chain=chain)
            .select(*keep, "message", F.posexplode("_chain").alias("payload_no", "_p"))
            .select(*keep, "payload_no", F.col("_p.ptype").alias("ptype"),
                    cut(F.col("message"), F.col("_p.at"), F.col("_p.len")).alias("body")))


def payload_facts(payloads: DataFrame, layout: str = "rfc") -> DataFrame:
    """KE size, NAT-detection and vendor id per payload.

    ``layout="rfc"`` uses the RFC 7296 offsets; ``"simple"`` the variant with
    eight bytes before key data and the notify type at bytes 6-8.
    """
    body = F.col("body")
    ke_head, notify_at, notify_min = (4, 2, 4) if layout == "rfc" else (8, 6, 8)
    notify = F.when(size(body) >= notify_min, be_int(body, notify_at, 2))
    return payloads.withColumns({
        "ke_size": F.when(F.col("ptype") == C.PAYLOAD_KE, size(body) - ke_head).cast("long"),
        "nat_detection": (F.col("ptype") == C.PAYLOAD_NOTIFY) & F.coalesce(notify.isin(*C.NAT_NOTIFY), F.lit(False)),
        "vendor_id": F.when(F.col("ptype") == C.PAYLOAD_VENDOR, F.hex(body))})


def _transform_chain(body: Column, layout: str) -> Column:
    """Transforms of an SA payload body as an array.

    RFC layout: proposals with their own header and SPI, then transforms
    (last, reserved, length, type, reserved, id, attributes of 0x8000|type).
    Simple layout: bare transforms (type, reserved, length, id, pad, attributes).
    """
    n = size(body).cast("long")
    blank = F.array().cast("array<struct<ttype:int,tid:int,key_length:int>>")
    start = F.struct(F.lit(0).cast("long").alias("off"),
                     (F.lit(0) if layout == "rfc" else n).cast("long").alias("inside"),
                     F.lit(True).alias("ok"), blank.alias("out"))
    attr_type = C.ATTR_KEY_LENGTH + (0x8000 if layout == "rfc" else 0)

    def key_length(off, end):
        spots = F.sequence(off + 8, F.greatest(end - 4, off + 8), F.lit(4).cast("long"))
        hits = F.filter(spots, lambda a: (a + 4 <= end) & (be_int(body, a, 2) == attr_type))
        last = F.try_element_at(hits, F.lit(-1))
        return be_int(body, last + 2, 2).cast("int")

    def step(acc, _):
        off, inside = acc["off"], acc["inside"]
        header = acc["ok"] & (off >= inside) & (off + 8 <= n)
        plen, spi = be_int(body, off + 2, 2), byte_at(body, off + 6)
        tlen = be_int(body, off + 2, 2)
        live = acc["ok"] & (off < inside) & (off + 8 <= n) & F.coalesce(tlen >= 8, F.lit(False))
        ttype = byte_at(body, off + 4) if layout == "rfc" else byte_at(body, off)
        tid = be_int(body, off + 6, 2) if layout == "rfc" else be_int(body, off + 4, 2)
        item = F.struct(ttype.cast("int").alias("ttype"), tid.cast("int").alias("tid"),
                        key_length(off, off + tlen).alias("key_length"))
        header = header & F.coalesce(plen >= 8, F.lit(False))
        return F.struct(
            F.when(header, off + 8 + spi).when(live, off + tlen).otherwise(off).alias("off"),
            F.when(header, off + plen).otherwise(inside).alias("inside"),
            (header | live).alias("ok"),
            F.when(live, F.array_append(acc["out"], item)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.floor(n / 4), F.lit(1).cast("long"))),
                       start, step, lambda acc: acc["out"])


def ike_transforms(payloads: DataFrame, layout: str = "rfc") -> DataFrame:
    sa = payloads.filter(F.col("ptype") == C.PAYLOAD_SA)
    keep = [c for c in payloads.columns if c not in ("body", "ptype")]
    return (bind(sa, _t=_transform_chain(F.col("body"), layout))
            .select(*keep, F.posexplode("_t").alias("transform_no", "_x"))
            .select(*keep, "transform_no", "_x.*").withColumn("name", transform_name()))


def ike_sessions(messages: DataFrame, payloads: DataFrame, layout: str = "rfc") -> DataFrame:
    """Sessions keyed by unordered peers and initiator SPI.

    Messages are pre-aggregated, so a session is bounded by the number of
    different exchanges and transforms, not by its messages. Offered comes from
    requests, chosen from responses; both keep first-seen order.
    """
    order = F.struct("packet_no")
    base = messages.groupBy(*SESSION).agg(
        F.min("packet_no").alias("first_packet"), F.min_by("major", order).alias("version"),
        F.min_by("src", order).alias("initiator"), F.min_by("dst", order).alias("responder"),
        F.array_sort(F.collect_set("exchange")).alias("exchanges"),
        F.max("aggressive").alias("aggressive_mode"),
        F.count_if(_is_rekey()).alias("rekey_count"),
        F.min(F.when(_is_rekey(), F.col("msg_length"))).alias("rekey_len_min"),
        F.avg(F.when(_is_rekey(), F.col("msg_length"))).alias("rekey_len_mean"))
    facts = payload_facts(payloads, layout).groupBy(*SESSION).agg(
        F.max_by("ke_size", F.when(F.col("ke_size").isNotNull(), F.struct("packet_no", "payload_no"))).alias("ke_size"),
        F.max("nat_detection").alias("nat_detection_seen"),
        F.count("vendor_id").alias("vendor_ids"))
    kinds = (ike_transforms(payloads, layout)
             .groupBy(*SESSION, "is_response", "ttype", "tid", "key_length", "name")
             .agg(F.min(F.struct("packet_no", "payload_no", "transform_no")).alias("_at")))
    item = F.struct("_at", "ttype", "tid", "key_length", "name")
    bare = lambda arr: F.transform(arr, lambda x: x.dropFields("_at"))
    lists = kinds.groupBy(*SESSION).agg(
        bare(F.array_sort(F.collect_list(F.when(~F.col("is_response"), item)))).alias("offered"),
        bare(F.array_sort(F.collect_list(F.when(F.col("is_response"), item)))).alias("chosen"))
    keys = list(SESSION)
    return (base.join(facts, keys, "left").join(lists, keys, "left")
            .withColumn("nat_detection_seen", F.coalesce("nat_detection_seen", F.lit(False))))


def _is_rekey():
    return (F.col("major") == 2) & (F.col("exchange") == 36)


def vendor_ids(payloads: DataFrame) -> DataFrame:
    return (payload_facts(payloads).filter(F.col("vendor_id").isNotNull())
            .select(*SESSION, "vendor_id").distinct())


def _names(arr, ttype):
    return F.transform(F.filter(arr, lambda t: t["ttype"] == ttype), lambda t: t["name"])


def ike_summary(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        *SESSION, F.col("version").alias("ike_version"), "aggressive_mode",
        F.col("nat_detection_seen").alias("nat_t_hint"), "ke_size",
        _names("offered", 1).alias("enc_offered"), _names("offered", 3).alias("integ_offered"),
        _names("offered", 4).alias("dh_offered"),
        F.get(_names("chosen", 1), F.lit(0)).alias("enc_chosen"), "first_packet")


def ike_version(sessions: DataFrame) -> DataFrame:
    """The single version all sessions of a capture agree on, else null."""
    return sessions.groupBy("capture_id").agg(
        F.when(F.min("version") == F.max("version"), F.min("version")).alias("ike_version"),
        F.count(F.lit(1)).alias("sessions"))


def rekey_stats(messages: DataFrame, by=("capture_id",)) -> DataFrame:
    m = F.when((F.col("major") == 2) & (F.col("exchange") == 36), F.col("msg_length"))
    return messages.groupBy(*by).agg(
        F.count(m).alias("rekey_count"), F.coalesce(F.min(m).cast("double"), F.lit(0.0)).alias("rekey_len_min"),
        F.coalesce(F.avg(m), F.lit(0.0)).alias("rekey_len_mean"))


def ke_group_check(df: DataFrame, ke_size="ke_size", dh_id="dh_id") -> DataFrame:
    """DH group that a KE size implies, and whether it fits the stated group."""
    pairs = [F.lit(x).cast("long") for group, n in C.KE_SIZES.items() for x in (n, group)]
    implied = F.try_element_at(F.create_map(*pairs), F.col(ke_size).cast("long"))
    return df.withColumn("ke_group", implied).withColumn(
        "ke_matches", F.when(implied.isNotNull(), implied == F.col(dh_id)))


def ike_suite(sessions: DataFrame) -> DataFrame:
    """Suite of the first session per capture: chosen cipher, first offered integrity and DH, KE size."""
    s = ike_summary(sessions)
    first = F.struct("first_packet", "initiator_spi")
    row = F.struct("enc_chosen", F.get("integ_offered", F.lit(0)).alias("integ"),
                   F.get("dh_offered", F.lit(0)).alias("dh_group"), "ke_size")
    return (s.groupBy("capture_id").agg(F.min_by(row, first).alias("_s"))
            .select("capture_id", F.col("_s.enc_chosen").alias("ike_enc"), F.col("_s.integ").alias("ike_integ"),
                    F.col("_s.dh_group").alias("ike_dh_group"), F.col("_s.ke_size").alias("ike_ke_size")))


def pfs_rule(sessions: DataFrame) -> DataFrame:
    """PFS from CREATE_CHILD_SA: unknown without one, on when a key exchange was carried.

    The confidence is the probability that PFS is on, so "off" carries 0.08.
    """
    rekeyed = F.array_contains("exchanges", 36)
    with_ke = rekeyed & (F.col("ke_size") >= min(C.KE_SIZES.values()))
    flags = sessions.groupBy("capture_id").agg(F.max(rekeyed).alias("_r"), F.max(F.coalesce(with_ke, F.lit(False))).alias("_k"))
    return flags.select(
        "capture_id", F.when(F.col("_r"), F.col("_k")).alias("pfs"),
        F.when(F.col("_r"), "inferred").otherwise("unknown").alias("pfs_tag"),
        F.when(~F.col("_r"), 0.0).when(F.col("_k"), C.PFS_ON_CONFIDENCE).otherwise(C.PFS_OFF_CONFIDENCE).alias("pfs_confidence"))
