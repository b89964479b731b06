"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("entry_esp_posture", "a4_esp_structure", "a12_flow_window_features", "w2_anchored_windows", "w6_replay_resets",
            "w15_link_rekeys", "j1_evaluate_rules", "a17_threat_matrix", "a19_analysis_summary", "k1_detect_ddos",
            "k2_detect_port_scan", "k3_detect_dga", "k4_detect_dns_tunneling", "k5_detect_exfiltration", "k6_detect_beaconing",
            "k11_detect_all", "s2_decode_packets", "a27_session_accuracy", "j5_label_intervals")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from wiretally.registry import QUERIES
    from wiretally.session import local_session
    spark = local_session(cpus, "wiretally-bench", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["p1_proto_class"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name in QUERIES:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    from wiretally.fixtures import view
    from wiretally.registry.threats import TRAFFIC
    packets = sum(view(spark, sf_dir, name).count() for name in TRAFFIC)  # all of them pass all seven detectors
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "detector_records_per_second": round(packets / times["k11_detect_all"]) if times.get("k11_detect_all") else None}))
    spark.stop()


if __name__ == "__main__":
    main()
