"""Capture files in byte ranges: the frames are those of a walk from the first byte, wherever the cuts fall."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretally.sources import captures, ranges


def classic(frames, order="<", ticks=10**6, link=1):
    out = struct.pack(order + "IHHIIII", 0xA1B2C3D4 if ticks == 10**6 else 0xA1B23C4D, 2, 4, 0, 0, 65535, link)
    return out + b"".join(struct.pack(order + "IIII", us // 10**6, us % 10**6 * (ticks // 10**6), len(f), len(f)) + f for us, f in frames)


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(link, order="<", rate=None):
    return block(1, struct.pack(order + "HHI", link, 0, 0) + (b"" if rate is None else struct.pack(order + "HHB3xHH", 9, 1, rate, 0, 0)), order)


def packet(us, f, port=0, order="<"):
    return block(6, struct.pack(order + "IIIII", port, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f, order)


def old_packet(us, f, port=0, order="<"):
    return block(2, struct.pack(order + "HHIIII", port, 7, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f, order)


def simple(f, order="<"):
    return block(3, struct.pack(order + "I", len(f)) + f, order)


def files():
    rng = np.random.default_rng(8)
    some = [(1_000_000 * i + 37 * i, rng.bytes(int(rng.integers(1, 400)))) for i in range(60)]
    inner = classic([(5, b"inner" * 9)] * 25)[24:]
    # Frames that hold records of a capture of their own, where a guess must go wrong.
    traps = [(10 + i, inner + bytes(i % 5)) for i in range(6)]
    blocks = b"".join(packet(9, b"inner" * 7) for _ in range(30))
    ng = section() + interface(1) + interface(101, rate=9) + b"".join(packet(us, f, i % 3) for i, (us, f) in enumerate(some[:30]))
    two = ng + section(">") + interface(228, ">", rate=0x8A) + b"".join(packet(us, f, 0, ">") for us, f in some[30:]) + block(5, b"x" * 40, ">")
    kinds = section() + packet(1, b"no interface yet") * 20 + interface(1) + old_packet(2, b"old", 0) + simple(b"simple frame") + interface(12) + old_packet(3, b"old", 1) + block(99, b"?" * 300) + packet(4, b"new", 1)
    good = classic(some)
    spot = len(classic(some[:20]))  # the header of the 21st record
    hurt = good[:spot] + b"\xff" * 16 + good[spot + 16:]
    return {"a.pcap": good, "b.pcap": classic(some, ">", link=101), "c.pcap": classic(some, "<", 10**9), "traps.pcap": classic(traps), "cut.pcap": good[:-5],
            "hurt.pcap": hurt, "big.pcap": classic([(1, b"z" * 5000), (2, b"y"), (3, b"x" * 3000)] + some), "head.pcap": good[:24], "short.pcap": good[:9],
            "empty.pcap": b"", "text.txt": b"not a capture at all " * 40, "d.pcapng": ng, "e.pcapng": two, "kinds.pcapng": kinds, "nested.pcapng": section() + interface(1) + packet(1, blocks) * 4,
            "bare.pcapng": section() + packet(1, b"no interface") * 40, "cut.pcapng": two[:-30], "hurt.pcapng": ng[:2000] + b"\1" * 40 + ng[2040:]}


def walked(content):
    return [(i, *r) for i, r in enumerate(captures.records(content))]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("captures")
    for name, content in files().items():
        (out / name).write_bytes(content)
    return out


@pytest.mark.parametrize("size", [700, 4000, 1 << 20])
def test_frames_are_those_of_one_walk(spark, folder, size):
    got = {}
    for r in captures.read_frames(spark, str(folder), size).collect():
        got.setdefault(os.path.basename(r["capture_id"]), []).append((r["frame_no"], r["ts_us"], r["linktype"], bytes(r["frame"])))
    for name, content in files().items():
        assert sorted(got.get(name, [])) == walked(content), name
    assert len(got["a.pcap"]) == 60 and len(got["traps.pcap"]) == 6 and len(got["nested.pcapng"]) == 4 and len(got["kinds.pcapng"]) == 4


def test_walk_reads_all_kinds_of_blocks():
    rows = walked(files()["kinds.pcapng"])
    assert [r[1:3] for r in rows] == [(2, 1), (None, 1), (3, 12), (4, 12)] and bytes(rows[1][3]) == b"simple frame"
    ticks = [r[1] for r in walked(files()["e.pcapng"])[30:33]]
    assert ticks == [(1_000_037 * i) * 10**6 // 1024 for i in (30, 31, 32)]


@pytest.mark.parametrize("size", [900, 1 << 20])
def test_report_counts_unread_bytes(spark, folder, size):
    report = {os.path.basename(r["path"]): r for r in ranges.capture_report(ranges.read_index(spark, str(folder), size)).collect()}
    assert set(report) == set(files())
    for name, content in files().items():
        r = report[name]
        assert r["bytes"] == len(content) and r["frames"] == len(walked(content)) and r["ranges"] == max(1, -(-len(content) // size)), name
    assert report["a.pcap"]["unread"] == 0 and report["a.pcap"]["stopped"] is None
    last = 16 + len(walked(files()["a.pcap"])[-1][3])
    assert report["cut.pcap"]["unread"] == last - 5 and report["cut.pcap"]["stopped"] == "record cut off"
    assert report["hurt.pcap"]["frames"] == 20 and report["hurt.pcap"]["unread"] > 5000 and report["text.txt"]["unread"] == len(files()["text.txt"])
    assert report["text.txt"]["stopped"] == "no capture file" and report["short.pcap"]["stopped"] == "file header cut off"
    assert report["kinds.pcapng"]["untimed"] == 1


def test_packets_without_a_time_are_left_out(spark, folder):
    assert captures.read_packets(spark, str(folder / "kinds.pcapng")).count() == 0
    assert captures.read_frames(spark, str(folder / "kinds.pcapng")).filter(F.col("ts_us").isNull()).count() == 1


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """Written with holes: 11,000 records of 200,000 bytes."""
    path, size, count = tmp_path / "large.pcap", 200_000, 11_000
    with open(path, "wb") as f:
        f.write(classic([]))
        for i in range(count):
            f.seek(24 + i * (16 + size))
            f.write(struct.pack("<IIII", i, 5, size, size) + bytes([i % 251 + 1]))
        f.truncate(24 + count * (16 + size))
    assert path.stat().st_size > 2**31
    index = ranges.read_index(spark, str(path))
    frames = ranges.frames_of(index)
    assert index.count() == -(-path.stat().st_size // ranges.RANGE_BYTES) and frames.rdd.getNumPartitions() >= 30
    row = frames.agg(F.count("*").alias("n"), F.count_distinct("frame_no").alias("ids"), F.max("frame_no").alias("last"), F.sum(F.length("frame")).alias("bytes"),
                     F.count_if(F.conv(F.hex(F.substring("frame", 1, 1)), 16, 10).cast("long") == F.col("frame_no") % 251 + 1).alias("right")).first()
    assert tuple(row) == (count, count, count - 1, count * size, count)


def test_catalog_of_files(spark, folder):
    import hashlib
    rows = {r["sha256"]: r["bytes"] for r in captures.read_catalog(spark, str(folder)).collect()}
    assert rows == {hashlib.sha256(c).hexdigest(): len(c) for c in files().values()}


def test_no_files(spark, tmp_path):
    assert captures.read_frames(spark, str(tmp_path)).count() == 0


def test_small_ranges_share_tasks(spark, tmp_path):
    """A task costs a fixed time, so the tasks must not grow with ranges of a few hundred bytes."""
    rows = spark.range(2_000).select((F.col("id") * 1000).alias("ts_us"), F.lit(1).alias("linktype"), F.unhex(F.lit("AB" * 60)).alias("frame"))
    ranges.write_frames(rows.coalesce(1), str(tmp_path / "c")).collect()
    index = ranges.read_index(spark, str(tmp_path / "c"), 512)
    frames = ranges.frames_of(index)
    most = 3 * spark.sparkContext.defaultParallelism
    assert index.count() > 10 * most and frames.rdd.getNumPartitions() <= most
    assert len(ranges.RangeReader(str(tmp_path / "c"), 512, most).partitions()) <= 2 * most
    assert sorted(r.frame_no for r in frames.select("frame_no").collect()) == list(range(2_000))
