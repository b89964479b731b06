"""Throughput and latency of running streams, from their own progress reports."""

import json
import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Buckets of the latency sketch lie this factor apart, so a quantile is off by at most half of it.
STEP = 1.02


class Sketch:
    """Counts per logarithmic bucket: a quantile sketch of fixed relative error whose parts merge by adding counts."""

    def __init__(self, counts=None, zero: int = 0):
        self.counts, self.zero = Counter(counts or {}), zero

    def add(self, value: float, weight: int = 1) -> None:
        if value <= 0:
            self.zero += weight
        else:
            self.counts[math.floor(math.log(value, STEP))] += weight

    def merge(self, other: "Sketch") -> "Sketch":
        return Sketch(self.counts + other.counts, self.zero + other.zero)

    def quantile(self, q: float):
        """The value below or at which a share ``q`` of the weight lies; None without any."""
        total = self.zero + sum(self.counts.values())
        if not total:
            return None
        need, seen = math.ceil(q * total), self.zero
        if seen >= need:
            return 0.0
        for bucket in sorted(self.counts):
            seen += self.counts[bucket]
            if seen >= need:
                return STEP ** (bucket + 0.5)


class Throughput(StreamingQueryListener):
    """Per query: records, busy seconds, late drops and a sketch of the time a record waits for its batch.

    ``spark.streams.addListener(listener)`` starts it. A record's latency is the time its micro-batch
    took; batches without records count towards neither.
    """

    def __init__(self, q: float = 0.95):
        self.q, self.queries = q, {}

    def onQueryStarted(self, event):
        self.queries.setdefault(str(event.runId), {"name": event.name, "records": 0, "seconds": 0.0, "late": 0, "batches": 0, "sketch": Sketch()})

    def onQueryProgress(self, event):
        self.take(json.loads(event.progress.json))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def take(self, progress: dict) -> None:
        """Adds one progress report."""
        state = self.queries.setdefault(progress["runId"], {"name": progress.get("name"), "records": 0, "seconds": 0.0, "late": 0, "batches": 0, "sketch": Sketch()})
        state["late"] += sum(op.get("numRowsDroppedByWatermark", 0) for op in progress.get("stateOperators", []))
        rows, ms = progress.get("numInputRows", 0), progress.get("durationMs", {}).get("triggerExecution", 0)
        if rows:
            state["records"] += rows
            state["seconds"] += ms / 1000
            state["batches"] += 1
            state["sketch"].add(float(ms), rows)

    def report(self, spark: SparkSession) -> DataFrame:
        """(run_id, name, batches, records, records_per_second, p95_ms, late) per query that ran; p95 is that of ``q``."""
        rows = [(run, s["name"], s["batches"], s["records"], s["records"] / s["seconds"] if s["seconds"] else None, s["sketch"].quantile(self.q), s["late"])
                for run, s in self.queries.items()]
        return spark.createDataFrame(rows, "run_id string, name string, batches long, records long, records_per_second double, p95_ms double, late long")
