"""Frames to packets, and packets to protocol records; Column expressions only.

``decode_packets`` is the one place that reads raw frames. Operators after it
should select ``payload`` away before any shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions.binary import be_int, bind, byte_at, cut, ipv4_text, ipv6_groups, ipv6_shorten, size
from wiretally.functions.net import is_internal, proto_class, quic_version

# Link types that carry a bare IP packet, VLAN tag types, IP types.
RAW_LINKTYPES = (12, 14, 101, 228, 229)
VLAN_TYPES = ("8100", "88A8", "9100")
ETHERTYPE_IPV4, ETHERTYPE_IPV6 = 0x0800, 0x86DD
FRAGMENT_PROTO = 44


def decode_packets(frames: DataFrame) -> DataFrame:
    """One row per IPv4/IPv6 packet; frames without IP are dropped."""
    frame = F.col("frame")
    raw = F.col("linktype").isin(*RAW_LINKTYPES)
    tag = "|".join(VLAN_TYPES)
    tags = F.when(
        F.hex(cut(frame, 12, 2)).isin(*VLAN_TYPES),
        F.length(F.regexp_extract(F.hex(cut(frame, 12, size(frame))), f"^(?:(?:{tag})[0-9A-F]{{4}})+", 0)) / 8,
    ).otherwise(F.lit(0)).cast("int")
    ethertype = be_int(frame, F.lit(12) + F.col("_tags") * 4, 2)
    nibble = F.shiftright(byte_at(frame, 0), 4)
    version = (F.when(raw, F.when(nibble.isin(4, 6), nibble))
               .when(ethertype == ETHERTYPE_IPV4, F.lit(4)).when(ethertype == ETHERTYPE_IPV6, F.lit(6)))
    df = bind(frames, _tags=F.when(raw, F.lit(0)).otherwise(tags))
    df = bind(df, ip_version=version.cast("int"))
    df = bind(df.filter(F.col("ip_version").isNotNull()),
              _ip=cut(frame, F.when(raw, F.lit(0)).otherwise(F.lit(14) + F.col("_tags") * 4), size(frame)))
    df = df.filter(size("_ip") >= F.when(F.col("ip_version") == 4, 20).otherwise(40))
    ip, v4 = F.col("_ip"), F.col("ip_version") == 4
    df = bind(df, _stated=F.when(v4, be_int(ip, 2, 2)).otherwise(be_int(ip, 4, 2)),
              _proto=F.when(v4, byte_at(ip, 9)).otherwise(byte_at(ip, 6)),
              _v6frag=~v4 & (size(ip) >= 48) & (byte_at(ip, 6) == FRAGMENT_PROTO))
    v6frag = F.col("_v6frag")
    df = bind(df, length=F.when(F.col("_stated") == 0, size(ip))
              .otherwise(F.least(F.col("_stated") + F.when(v4, 0).otherwise(40), size(ip))).cast("int"),
              _fragment=F.when(v4, be_int(ip, 6, 2).bitwiseAND(0x1FFF))
              .when(v6frag, F.shiftright(be_int(ip, 42, 2), 3)).otherwise(0),
              _head=F.when(v4, byte_at(ip, 0).bitwiseAND(15) * 4).when(v6frag, 48).otherwise(40))
    first = F.col("_fragment") == 0
    df = bind(df, ip_proto=F.when(v6frag, F.when(first, byte_at(ip, 40)).otherwise(F.lit(FRAGMENT_PROTO)))
              .otherwise(F.col("_proto")).cast("int"),
              _body=cut(ip, F.col("_head"), F.greatest(F.col("length") - F.col("_head"), F.lit(0))))
    body = F.col("_body")
    df = bind(df, _udp=(F.col("ip_proto") == 17) & first & (size(body) >= 8),
              _tcp=(F.col("ip_proto") == 6) & first & (size(body) >= 20))
    udp, tcp = F.col("_udp"), F.col("_tcp")
    opaque = F.col("ip_proto").isin(50, 51) | v6frag
    df = bind(df, _src6=F.when(~v4, ipv6_groups(ip, 8)), _dst6=F.when(~v4, ipv6_groups(ip, 24)))
    df = bind(df, src=F.when(v4, ipv4_text(ip, 12)).otherwise(ipv6_shorten(F.col("_src6"))),
              dst=F.when(v4, ipv4_text(ip, 16)).otherwise(ipv6_shorten(F.col("_dst6"))),
              sport=F.when(udp | tcp, be_int(body, 0, 2)).cast("int"),
              dport=F.when(udp | tcp, be_int(body, 2, 2)).cast("int"),
              payload=F.when(udp, cut(body, 8, size(body)))
              .when(tcp, cut(body, F.shiftright(byte_at(body, 12), 4) * 4, size(body)))
              .when(opaque, body).otherwise(F.lit(b"")),
              tcp_flags=F.when(tcp, byte_at(body, 13)).otherwise(F.lit(0)).cast("int"),
              ttl=F.when(v4, byte_at(ip, 8)).otherwise(byte_at(ip, 7)).cast("int"))
    return df.select("capture_id", F.col("frame_no").alias("packet_no"), "ts_us", F.timestamp_micros("ts_us").alias("ts"),
                     "src", "dst", "ip_proto", "sport", "dport", "payload", "ip_version", "length", "tcp_flags", "ttl")


def total_packets(packets: DataFrame) -> DataFrame:
    return packets.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packets"))


def with_proto_class(packets: DataFrame) -> DataFrame:
    return packets.withColumn("proto_class", proto_class())


def by_class(packets: DataFrame, cls: str) -> DataFrame:
    return packets.filter(proto_class() == cls)


def class_counts(packets: DataFrame) -> DataFrame:
    return (packets.groupBy("capture_id", proto_class().alias("proto_class"))
            .agg(F.count(F.lit(1)).alias("packets")))


def ipsec_present(packets: DataFrame) -> DataFrame:
    counts = with_proto_class(packets.drop("proto_class")).groupBy("capture_id").agg(
        F.count_if(F.col("proto_class") != "other").alias("_n"))
    return counts.select("capture_id", (F.col("_n") > 0).alias("ipsec_present"))


def union_esp(packets: DataFrame) -> DataFrame:
    """Plain and UDP-encapsulated ESP in one pass, as ESP records.

    ``length`` is body plus outer IP header; for UDP encapsulation the UDP
    header is not added, although the structure test later takes it off.
    """
    kind, body = proto_class(), F.col("payload")
    return (bind(packets, _kind=kind).filter(F.col("_kind").isin("esp", "esp_in_udp") & (size(body) >= 8))
            .select("capture_id", "packet_no", "ts_us", be_int(body, 0, 4).alias("spi"),
                    be_int(body, 4, 4).alias("seq"), "src", "dst",
                    (size(body) + F.when(F.col("ip_version") == 4, 20).otherwise(40)).cast("long").alias("length"),
                    (F.col("_kind") == "esp_in_udp").alias("udp_encapsulated")))


def esp_records(packets: DataFrame) -> DataFrame:
    return union_esp(packets)


def ah_records(packets: DataFrame) -> DataFrame:
    body = F.col("payload")
    return (by_class(packets, "ah").filter(size(body) >= 12)
            .select("capture_id", "packet_no", "ts_us", be_int(body, 4, 4).alias("spi"),
                    be_int(body, 8, 4).alias("seq"), byte_at(body, 0).cast("int").alias("next_header"),
                    ((byte_at(body, 1) + 2) * 4 - 12).cast("int").alias("icv_len")))


def with_direction(packets: DataFrame) -> DataFrame:
    """Adds ``direction``: out, in or null."""
    a, b = is_internal("src"), is_internal("dst")
    return packets.withColumn("direction", F.when(a & ~b, "out").when(b & ~a, "in"))


def tls_metadata(packets: DataFrame) -> DataFrame:
    """Public TLS handshake or QUIC long-header fields; other packets are dropped.

    A ClientHello is read only as far as its bytes go: what lies beyond a
    truncated field stays at zero.
    """
    p, n = F.col("payload"), size("payload")
    tls = (F.col("ip_proto") == 6) & (F.hex(cut(p, 0, 1)) == "16") & (n > 10)
    quic = (F.col("ip_proto") == 17) & quic_version("payload").isNotNull()
    rows = bind(packets, _tls=F.coalesce(tls, F.lit(False)), _quic=F.coalesce(quic, F.lit(False)))
    rows = rows.filter(F.col("_tls") | F.col("_quic"))
    hello = F.col("_tls") & (byte_at(p, 5) == 1) & (n >= 45)
    rows = bind(rows, _c=F.when(hello, F.lit(44) + byte_at(p, 43)))
    # Two bytes of cipher length may be cut short at the end; what is there counts.
    cipher_bytes = F.coalesce(F.conv(F.hex(cut(p, F.col("_c"), 2)), 16, 10).cast("long"), F.lit(0))
    rows = bind(rows, _cb=F.when(F.col("_c").isNotNull(), cipher_bytes))
    rows = bind(rows, _m=F.col("_c") + 2 + F.col("_cb"))
    rows = bind(rows, _e=F.when(F.col("_m") < n, F.col("_m") + 1 + byte_at(p, F.col("_m"))))
    ext_len = F.coalesce(F.conv(F.hex(cut(p, F.col("_e"), 2)), 16, 10).cast("long"), F.lit(0))
    rows = bind(rows, _end=F.least(n.cast("long"), F.col("_e") + 2 + ext_len))

    def step(acc, _):
        pos = acc["pos"]
        live = pos + 4 <= F.col("_end")
        kind, length = be_int(p, pos, 2), be_int(p, pos + 2, 2)
        has_sni = live & (kind == 0) & (F.least(length, n - pos - 4) >= 5)
        return F.struct(
            F.when(live, pos + 4 + length).otherwise(pos).alias("pos"),
            F.when(live, acc["count"] + 1).otherwise(acc["count"]).alias("count"),
            F.when(has_sni, be_int(p, pos + 7, 2)).otherwise(acc["sni"]).alias("sni"))

    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.floor((F.col("_end") - F.col("_e")) / 4), F.lit(1).cast("long")))
    walked = F.when(F.col("_e").isNotNull(), F.aggregate(
        steps, F.struct((F.col("_e") + 2).alias("pos"), F.lit(0).cast("long").alias("count"),
                        F.lit(0).cast("long").alias("sni")), step))
    rows = bind(rows, _x=walked)
    num = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    keep = [c for c in packets.columns if c != "payload"]
    return rows.select(
        *keep, F.col("_tls").alias("tls"), F.col("_quic").alias("quic"),
        num(F.when(F.col("_tls"), be_int(p, 1, 2))).alias("tls_version"),
        num(F.when(F.col("_quic"), quic_version("payload"))).alias("quic_version"), num(n).alias("handshake_len"),
        (num(F.col("_cb")) / 2).alias("cipher_count"), num(F.col("_x.sni")).alias("sni_length"),
        num(F.col("_x.count")).alias("extension_count"))


def _question(msg: bytes):
    """First question of a DNS message as (name, rcode or None, qtype); None when malformed."""
    if msg is None or len(msg) < 12 or int.from_bytes(msg[4:6], "big") == 0:
        return None
    flags, labels, at, end, hops = int.from_bytes(msg[2:4], "big"), [], 12, None, 0
    while True:
        if at >= len(msg) or hops > len(msg):
            return None
        n = msg[at]
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(msg):
                return None
            end = end if end is not None else at + 2
            at = (n & 0x3F) << 8 | msg[at + 1]
            hops += 1
        elif n & 0xC0:
            return None
        elif n == 0:
            end = end if end is not None else at + 1
            break
        else:
            if at + 1 + n > len(msg):
                return None
            labels.append(msg[at + 1:at + 1 + n])
            at += 1 + n
            hops += 1
    if end + 4 > len(msg):
        return None
    try:
        name = b".".join(labels).decode("utf-8").lower().rstrip(".")
    except UnicodeDecodeError:
        return None
    return name, (flags & 15 if flags & 0x8000 else None), int.from_bytes(msg[end:end + 2], "big")


def dns_queries(packets: DataFrame) -> DataFrame:
    """First question of every UDP/53 message; messages that do not parse are dropped."""
    import pandas as pd

    @F.pandas_udf("qname string, rcode long, qtype long")
    def parse(payload: pd.Series) -> pd.DataFrame:
        rows = [_question(bytes(x) if x is not None else None) or (None, None, None) for x in payload]
        out = pd.DataFrame(rows, columns=["qname", "rcode", "qtype"])
        return out.astype({"rcode": "Int64", "qtype": "Int64"})

    dns = packets.filter((F.col("ip_proto") == 17) & ((F.col("sport") == 53) | (F.col("dport") == 53)))
    keep = [c for c in packets.columns if c != "payload"]
    return (dns.withColumn("_q", parse("payload")).select(*keep, "_q.*")
            .filter(F.coalesce(F.col("qname") != "", F.lit(False))))
