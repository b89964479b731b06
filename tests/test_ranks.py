"""Ranks over a whole table, training gates, the alert store and stream progress."""

import random

import pytest
from pyspark.sql import functions as F

from wiretally.operators import metrics as mt, scan
from wiretally.plans import datasets, training
from wiretally.sources import tables
from wiretally.streaming import progress


def test_running_sums_where_values_crowd(spark):
    """Nearly all values within 0.001 of 0 or 1: sums are exact, and no range holds over twice the mean."""
    rnd = random.Random(1)
    rows = [(rnd.random() ** 8 * 0.001 if i % 2 else 1 - rnd.random() ** 8 * 0.001, i, rnd.randrange(9)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "v double, no long, n long")
    got = {r["no"]: r["s"] for r in scan.running_over_all(df, ["v", "no"], {"s": "n"}).collect()}
    total = 0
    for v, no, n in sorted(rows):
        total += n
        assert got[no] == total
    sizes = [r["count"] for r in df.repartitionByRange(8, "v", "no").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * len(rows) / 8
    assert scan.running_over_all(df.limit(0), ["v"], {"s": "n"}).count() == 0


def test_metrics_of_crowded_scores(spark):
    rnd = random.Random(2)
    data = [(rnd.random() ** 6, int(rnd.random() < 0.4)) for _ in range(2000)]
    df = spark.createDataFrame(data, "p1 double, label int")
    ranked, tp, want = sorted(data, reverse=True), 0, 0.0
    for i, (_, y) in enumerate(ranked):
        tp += y
        want += y * tp / (i + 1)
    assert abs(mt.average_precision(df).first()["pr_auc"] - want / tp) < 1e-9
    import numpy as np
    scores = np.array([p for p, _ in data])
    level = min(1, np.ceil((len(scores) + 1) * 0.9) / len(scores))
    assert abs(mt.conformal_q(df.withColumnRenamed("p1", "score"), alpha=0.1).first()["q"] - np.quantile(scores, level, method="higher")) < 1e-12


def test_head_gate_wants_profiles(spark):
    make = lambda spread: spark.createDataFrame([(i % 2, f"p{spread(i)}") for i in range(400)], "label int, profile string")
    assert mt.head_gate(make(lambda i: i % 14)).first()["trainable"]
    few = mt.head_gate(make(lambda i: i % 4)).first()
    assert not few["trainable"] and few["profiles"] == 4
    narrow = mt.head_gate(make(lambda i: i % 3 * 2 if i % 2 else 1 + i % 14)).first()
    assert narrow["least_profiles"] == 3 and not narrow["trainable"]


def test_threat_gate_wants_both_labels_in_every_part(spark):
    make = lambda both: spark.createDataFrame([(f"s{i % 10}", (i // 10) % 2 if both else int(i % 10 < 1)) for i in range(400)], "scenario_id string, label int")
    for both in (True, False):
        df = make(both)
        assert mt.threat_gate(df, folds=datasets.scenario_folds(df)).first()["trainable"] == both
        assert mt.threat_gate(df).first()["trainable"]


def test_training_stops_at_the_gate(spark):
    rows = spark.range(60).select(F.concat(F.lit("p"), (F.col("id") % 9).cast("string")).alias("profile"), (F.col("id") % 2).alias("y"), F.rand(1).alias("x"), F.lit(1).alias("rekey_count"))
    split = rows.select("profile", F.lit("train").alias("part")).distinct()
    with pytest.raises(ValueError, match="not enough"):
        training.fit_and_gate(rows, "pfs", "y", ["x"], split)


def test_an_append_reads_only_its_days(spark, tmp_path):
    path, day = str(tmp_path / "alerts"), 86400.0
    make = lambda rows: spark.createDataFrame(rows, "id string, timestamp double")
    assert tables.append_alerts(make([("a", 5.0), ("b", 6.0), ("a", 5.0), ("c", day + 1)]), path).count() == 3
    for broken in (tmp_path / "alerts" / "day=0").glob("*.parquet"):
        broken.write_bytes(b"not a table")
    again = make([("c", day + 1), ("d", day + 2), ("e", 2 * day)])
    assert {r["id"] for r in tables.append_alerts(again, path).collect()} == {"d", "e"}
    assert tables.append_alerts(again, path).count() == 0
    assert {r["id"] for r in tables.read_alerts(spark, path, [1, 2, 7]).collect()} == {"c", "d", "e"}


def test_sketches_merge(spark):
    rnd = random.Random(4)
    values = [rnd.expovariate(0.01) for _ in range(5000)] + [0.0] * 10
    parts = [progress.Sketch() for _ in range(3)]
    for i, v in enumerate(values):
        parts[i % 3].add(v)
    whole = parts[0].merge(parts[1]).merge(parts[2])
    for q in (0.05, 0.5, 0.95, 0.999):
        exact = sorted(values)[max(0, -(-int(q * 1e9) * len(values) // 10**9) - 1)]
        assert abs(whole.quantile(q) - exact) <= 0.011 * exact + 1e-9
    assert progress.Sketch().quantile(0.5) is None


def test_listener_reports_a_stream(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "in"))
    seen = progress.Throughput()
    spark.streams.addListener(seen)
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    import time
    for _ in range(50):
        if any(s["records"] for s in seen.queries.values()):
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    row = seen.report(spark).filter("records > 0").first()
    assert row["records"] == 1000 and row["p95_ms"] > 0 and row["records_per_second"] > 0 and row["late"] == 0
