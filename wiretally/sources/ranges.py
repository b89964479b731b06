"""Capture files of any size: byte ranges that find their own first record.

``capture_ranges`` is a data source with one row per byte range of a file: where its first record
begins, where the record after its last one begins, how many frames lie between, and what it
learned about interfaces. A range in the middle of a file looks for a chain of plausible record
headers. That is a guess, so ``stitched`` holds it against the range before: the first record must
begin where the last one ended. A range that guessed wrong is walked again from the right place.
So the frames are those of a walk from the first byte, wherever the cuts fall, and each task reads
one range.

A record that can't be read ends its file, as in a walk from the first byte; the bytes behind it
are counted as unread.
"""

import json
import struct

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wiretally.session import stage

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
#: Header chains a guess must show, and the largest frame it takes for plausible.
CHAIN, PLAUSIBLE = 6, 1 << 18
PCAPNG = b"\x0a\x0d\x0d\x0a"
# File magic -> (byte order, ticks per second), and the byte-order mark of a section.
PCAP_MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xd4\xc3\xb2\xa1": ("<", 10**6),
              b"\xa1\xb2\x3c\x4d": (">", 10**9), b"\x4d\x3c\xb2\xa1": ("<", 10**9)}
SECTION_MARK = b"\x1a\x2b\x3c\x4d"
# Block types.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6

INDEX_SCHEMA = ("path string, bytes long, range_no int, begin long, end long, entry long, exit long, frames long, untimed long, "
                "state string, changes string, stopped string")
FRAME_SCHEMA = "capture_id string, frame_no long, ts_us long, linktype int, frame binary"


# --- bytes ------------------------------------------------------------------

class Local:
    """Bytes in memory, read like a file."""

    def __init__(self, data):
        self.data, self.size = memoryview(data), len(data)

    def get(self, at: int, n: int) -> bytes:
        return bytes(self.data[at:at + n])


class Remote:
    """A file read in blocks, forward or at any place."""

    def __init__(self, path: str):
        system, name = _system(path)
        self.file = system.open_input_file(name)
        self.size, self.begin, self.block = self.file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        lo = at - self.begin
        if lo < 0 or lo + n > len(self.block):
            self.begin, lo = at, 0
            self.block = self.file.read_at(max(n, min(BLOCK_BYTES, max(self.size - at, 0))), at) if at < self.size else b""
        return self.block[lo:lo + n]


def _system(path: str):
    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _listed(path: str) -> list:
    """(path, bytes) of all files under ``path``, in order of their names."""
    system, name = _system(path)
    scheme, _, rest = path.partition("://")
    root = "file:" if isinstance(system, fs.LocalFileSystem) else f"{scheme}://{rest.split('/')[0] if name.startswith('/') else ''}"
    info = system.get_file_info(name)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    hidden = lambda f: any(p[:1] in "._" and p not in (".", "..") for p in f.path[len(name):].split("/") if p)
    return sorted((root + f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f))


# --- walks ------------------------------------------------------------------
#
# A walk yields (offset, ts_us, linktype, begin, length) per frame, from ``at`` to the last record that
# begins before ``end``; then ``at`` is where the next one begins and ``stopped`` says why it ended early.

class Classic:
    def __init__(self, src, state=None):
        head = src.get(0, 24)
        self.src, self.stopped, self.changes = src, None, []
        self.order, self.ticks = PCAP_MAGIC[head[:4]]
        self.first = 24
        if len(head) < 24:
            self.link, self.stopped = 0, "file header cut off"
        else:
            self.link = struct.unpack_from(self.order + "I", head, 20)[0] & 0x0FFFFFFF

    def walk(self, at: int, end: int):
        unpack, get, size = struct.Struct(self.order + "IIII").unpack, self.src.get, self.src.size
        self.at = at = max(at, self.first)
        while at < end and at < size:
            head = get(at, 16)
            if len(head) < 16:
                self.stopped = "record header cut off"
                break
            sec, frac, kept, _ = unpack(head)
            if at + 16 + kept > size:
                self.stopped = "record cut off"
                break
            yield at, sec * 1_000_000 + frac * 1_000_000 // self.ticks, self.link, at + 16, kept
            self.at = at = at + 16 + kept

    def plausible(self, at: int) -> int:
        """Where the record after the one at ``at`` begins, or 0 where no record can begin there."""
        head = self.src.get(at, 16)
        if len(head) < 16:
            return 0
        _, frac, kept, whole = struct.unpack(self.order + "IIII", head)
        fits = frac < self.ticks and 0 < kept <= PLAUSIBLE and kept <= whole <= PLAUSIBLE and at + 16 + kept <= self.src.size
        return at + 16 + kept if fits else 0

    step = 1


class Blocks:
    """``state`` is the byte order and the (linktype, ticks) of each interface of the section at hand, or None in its place.

    Interfaces that are not known are taken to be there, so that frames are counted.
    """

    step = 4
    first = 0

    def __init__(self, src, state=None):
        self.src, self.stopped, self.changes = src, None, []
        self.order, links = state if state else (_order_of(src.get(0, 12)), None)
        self.guess = links is None
        self.links = [(0, 1)] if self.guess else [tuple(x) for x in links]

    def walk(self, at: int, end: int):
        get, size = self.src.get, self.src.size
        self.at = at
        while at < end and at < size:
            head = get(at, 12)
            if len(head) < 12:
                self.stopped = "block header cut off"
                break
            if head[:4] == PCAPNG:
                self.order, self.links = _order_of(head), []
                self.changes.append(["section", self.order])
            kind, length = struct.unpack(self.order + "II", head[:8])
            if length < 12 or at + length > size:
                self.stopped = "block length impossible" if length < 12 else "block cut off"
                break
            if kind == INTERFACE and length >= 16:
                body = get(at + 8, length - 12)
                self.links.append((struct.unpack_from(self.order + "H", body)[0], tick_rate(body[8:], self.order)))
                self.changes.append(["interface", *self.links[-1]])
            elif kind in (PACKET, OLD_PACKET) and self.links and length >= 32:
                port, high, low, kept, _ = struct.unpack(self.order + "IIIII", get(at + 8, 20))
                if kind == OLD_PACKET:  # two bytes of interface, two of a drop count
                    port = port >> 16 if self.order == ">" else port & 0xFFFF
                link, ticks = self.links[min(port, len(self.links) - 1)]
                yield at, (high << 32 | low) * 1_000_000 // ticks, link, at + 28, min(kept, length - 32)
            elif kind == SIMPLE_PACKET and self.links and length >= 16:
                whole = struct.unpack(self.order + "I", get(at + 8, 4))[0]
                yield at, None, self.links[0][0], at + 12, min(whole, length - 16)
            self.at = at = at + length

    def plausible(self, at: int) -> int:
        head = self.src.get(at, 12)
        if len(head) < 12:
            return 0
        order = _order_of(head) if head[:4] == PCAPNG else self.order
        length = struct.unpack(order + "I", head[4:8])[0]
        if length < 12 or length % 4 or length > PLAUSIBLE or at + length > self.src.size:
            return 0
        return at + length if self.src.get(at + length - 4, 4) == head[4:8] else 0


def _order_of(head: bytes) -> str:
    return ">" if head[8:12] == SECTION_MARK else "<"


def tick_rate(options: bytes, order: str) -> int:
    """Ticks per second of an interface, from its options."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1 and at + 4 < len(options):
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10 ** value
        at += 4 + (size + 3) // 4 * 4
    return 10**6


def walker(src, state=None):
    """The walk that fits a file's first bytes, or None for other files."""
    magic = src.get(0, 4)
    return Blocks(src, state) if magic == PCAPNG else Classic(src) if magic in PCAP_MAGIC else None


def guessed(walk, begin: int, end: int):
    """The first offset in ``begin`` to ``end`` from which a chain of plausible records follows, or None."""
    at = begin + -begin % walk.step
    while at < min(end, walk.src.size):
        here = at
        for _ in range(CHAIN):
            here = walk.plausible(here)
            if here == 0 or here == walk.src.size:
                break
        if here:
            return at
        at += walk.step
    return None


def indexed(path: str, src, range_no: int, begin: int, end: int, entry=None, state=None) -> tuple:
    """The index row of one range; ``entry`` and ``state`` are given where they are known."""
    walk = walker(src, state or (["<", []] if begin == 0 else None))  # a file begins with a section, which sets the order
    if walk is None or walk.stopped:
        return path, src.size, range_no, begin, end, 0, 0, 0, 0, None, "[]", "no capture file" if walk is None else walk.stopped
    entry = walk.first if begin == 0 else guessed(walk, begin, end) if entry is None else entry
    before = json.dumps([walk.order, None if walk.guess else walk.links]) if isinstance(walk, Blocks) else None
    if entry is None or entry >= max(end, 1):
        return path, src.size, range_no, begin, end, None, None, 0, 0, before, "[]", None
    frames = untimed = 0
    for _, ts, *_ in walk.walk(entry, end):
        frames, untimed = frames + 1, untimed + (ts is None)
    return path, src.size, range_no, begin, end, entry, walk.at, frames, untimed, before, json.dumps(walk.changes), walk.stopped


# --- the source -------------------------------------------------------------

class Piece(InputPartition):
    def __init__(self, ranges):
        self.ranges = ranges


class RangeReader(DataSourceReader):
    def __init__(self, path, size, tasks=None):
        self.path, self.size, self.tasks = path, size, tasks

    def partitions(self):
        """Ranges of large files stand alone; small files share a task, and small ranges do beyond ``tasks``."""
        out, held, weight = [], [], 0
        files = _listed(self.path)
        share = max(self.size, min(RANGE_BYTES, sum(length for _, length in files) // self.tasks)) if self.tasks else self.size
        for path, length in files:
            for no, begin in enumerate(range(0, max(length, 1), self.size)):
                end = min(begin + self.size, length)
                if held and weight + end - begin > share:
                    out.append(Piece(held))
                    held, weight = [], 0
                held.append((path, no, begin, end))
                weight += end - begin
        return out + [Piece(held)] if held else out

    def read(self, partition):
        for path, no, begin, end in partition.ranges if partition else ():
            yield indexed(path, Remote(path), no, begin, end)


class CaptureRanges(DataSource):
    """``spark.read.format("capture_ranges").option("range_bytes", n).load(path)``."""

    @classmethod
    def name(cls):
        return "capture_ranges"

    def schema(self):
        return INDEX_SCHEMA

    def reader(self, schema):
        return RangeReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("tasks", 0)))


# --- index and frames -------------------------------------------------------

def _checked(index: DataFrame) -> DataFrame:
    """Adds what the ranges before say: ``due`` (where the next record begins), ``ended`` (a stop before) and ``wrong``."""
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    out = index.withColumns({"due": F.coalesce(F.max("exit").over(before), F.lit(0)), "ended": F.coalesce(F.max(F.col("stopped").isNotNull()).over(before), F.lit(False)),
                             "_before": F.flatten(F.collect_list(F.from_json("changes", "array<array<string>>")).over(before))})
    # The last section before the range and the interfaces since then; a range that assumed another byte order was misread.
    cut = F.coalesce(F.array_max(F.transform("_before", lambda c, i: F.when(F.get(c, F.lit(0)) == "section", i + 1))), F.lit(0))
    since = F.filter("_before", lambda c, i: (i >= cut) & (F.get(c, F.lit(0)) == "interface"))
    order = F.get(F.get("_before", cut - 1), F.lit(1))
    links = F.array_join(F.transform(since, lambda c: F.concat(F.lit("["), F.get(c, F.lit(1)), F.lit(", "), F.get(c, F.lit(2)), F.lit("]"))), ", ")
    known = F.when(F.col("state").isNull() | (cut == 0), F.col("state")).otherwise(F.concat(F.lit('["'), order, F.lit('", ['), links, F.lit("]]")))
    misread = (F.substring("state", 1, 4) != F.substring(known, 1, 4)) | (F.endswith("state", F.lit("null]")) & (links == ""))
    due = F.when(F.col("due") < F.col("end"), F.col("due"))  # null: the range lies within a record that began before it
    amiss = ~F.col("entry").eqNullSafe(due) | (due.isNotNull() & F.coalesce(misread, F.lit(False)))
    return out.withColumns({"known": known, "wrong": ~F.col("ended") & (F.col("begin") > 0) & amiss}).drop("_before")


def _again(batches):
    for batch in batches:
        rows = [indexed(r["path"], Remote(r["path"]), r["range_no"], r["begin"], r["end"], r["due"], json.loads(r["known"]) if r["known"] else None) for r in batch.to_pylist()]
        if rows:
            columns = list(zip(*rows))
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
            names, types = zip(*[f.split() for f in INDEX_SCHEMA.split(", ")])
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def stitched(index: DataFrame) -> DataFrame:
    """The index with every range in place: ``entry`` to ``exit`` hold exactly the records of a walk from the first byte.

    Adds ``first_frame`` (frames before the range) and ``known`` (byte order and interfaces at its start). As
    long as a file has a range that began elsewhere than the one before it ended, the first such range
    is walked again; guesses are rarely wrong, so mostly one look is enough.
    """
    index = stage(index)
    names = index.columns
    while True:
        found = stage(_checked(index))
        bad = found.where("wrong").groupBy("path").agg(F.min("range_no").alias("range_no"))
        if not bad.head(1):
            break
        wrong = found.join(bad, ["path", "range_no"])
        repaired = wrong.repartition("path", "range_no").mapInArrow(_again, INDEX_SCHEMA)
        index = stage(index.join(bad, ["path", "range_no"], "left_anti").select(*names).unionByName(repaired))
    void = F.col("ended") | ((F.col("due") >= F.col("end")) & (F.col("begin") > 0))
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    kept = found.withColumns({c: F.when(void, F.lit(0)).otherwise(F.col(c)) for c in ("frames", "untimed")})
    kept = kept.withColumn("stopped", F.when(~void, F.col("stopped")))
    return kept.withColumn("first_frame", F.coalesce(F.sum("frames").over(before), F.lit(0))).select(*names, "first_frame", "known")


def _tasks(spark: SparkSession) -> int:
    """Tasks that keep all cores busy; a task costs a fixed time, so ranges far below ``RANGE_BYTES`` don't get one each."""
    return 3 * spark.sparkContext.defaultParallelism


def read_index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The stitched index of all files under ``path``."""
    spark.dataSource.register(CaptureRanges)
    return stitched(spark.read.format("capture_ranges").option("range_bytes", range_bytes).option("tasks", _tasks(spark)).load(path))


def _frames(batches, rows: int = 20_000, limit: int = 16 << 20):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    names = [f.split()[0] for f in FRAME_SCHEMA.split(", ")]

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        for r in batch.to_pylist():
            src = Remote(r["path"])
            walk = walker(src, json.loads(r["known"]) if r["known"] else None)
            out, weight, no = [], 0, r["first_frame"]
            for _, ts, link, begin, length in walk.walk(r["entry"], r["end"]):
                out.append((r["path"], no, ts, link, src.get(begin, length)))
                no, weight = no + 1, weight + length
                if len(out) >= rows or weight >= limit:
                    yield made(out)
                    out, weight = [], 0
            if out:
                yield made(out)


def frames_of(index: DataFrame) -> DataFrame:
    """Frames of a stitched index, one task per range or for several small ones; ``capture_id`` is the file's path, ``frame_no`` counts from its first frame."""
    held = stage(index.where("frames > 0"))
    size = held.agg(F.count(F.lit(1)).alias("ranges"), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0)).alias("bytes")).first()
    count = max(1, min(size["ranges"], max(_tasks(index.sparkSession), -(-size["bytes"] // RANGE_BYTES))))
    spread = held.repartitionByRange(count, "path", "range_no") if count > 1 else held
    return spread.select("path", "entry", "end", "first_frame", "known").mapInArrow(_frames, FRAME_SCHEMA)


def capture_report(index: DataFrame) -> DataFrame:
    """(path, bytes, ranges, frames, untimed, unread, stopped) per file: what was read, what was not, and why."""
    last = F.max(F.when(F.col("stopped").isNotNull(), F.col("exit")))
    return index.groupBy("path").agg(
        F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("ranges"), F.sum("frames").alias("frames"), F.sum("untimed").alias("untimed"),
        F.coalesce(F.max("bytes") - last, F.lit(0)).alias("unread"), F.max("stopped").alias("stopped"))


# --- writing ----------------------------------------------------------------

def _block(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    size = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + size + body + size


def write_frames(frames: DataFrame, folder: str) -> DataFrame:
    """Frames (ts_us, linktype, frame) as one block file per task under ``folder``: (path, frames).

    A file is written under a name of its own attempt and then renamed, so a repeated task leaves one
    whole file. Frames without a time become simple blocks, which belong to the file's first interface;
    frames with a time keep their link type.
    """
    def body(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        system, root = _system(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():05d}.pcapng"
        links, count = {}, 0
        with system.open_output_stream(f"{name}.{task.taskAttemptId()}") as out:
            out.write(_block(SECTION, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
            for batch in batches:
                for ts, link, frame in zip(*(batch.column(c).to_pylist() for c in ("ts_us", "linktype", "frame"))):
                    if link not in links:
                        links[link] = len(links)
                        out.write(_block(INTERFACE, struct.pack("<HHI", link, 0, 0)))
                    size = len(frame)
                    out.write(_block(SIMPLE_PACKET, struct.pack("<I", size) + frame) if ts is None else
                              _block(PACKET, struct.pack("<IIIII", links[link], ts >> 32, ts & 0xFFFFFFFF, size, size) + frame))
                    count += 1
        if count:
            system.move(f"{name}.{task.taskAttemptId()}", name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["path", "frames"])
        else:
            system.delete_file(f"{name}.{task.taskAttemptId()}")

    return frames.select("ts_us", "linktype", "frame").mapInArrow(body, "path string, frames long")
