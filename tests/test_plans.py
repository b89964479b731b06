"""Plans: no cross joins, no window without keys, filters and columns reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

from wiretally.fixtures import view
from wiretally.operators import sa
from wiretally.plans import posture, threats as th
from wiretally.registry import QUERIES

SF = "/root/testdata/sf0.001"
# Training runs Spark jobs of its own when it is declared.
PLANNED = sorted(n for n in QUERIES if not n.startswith(("m6", "m9", "i10", "t8")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Python is allowed where bytes must be walked per record, in the anchor walk and in model training.
PYTHON = ("s1_", "p17_", "w1_", "w2_", "w3_", "w4_", "w5_", "w14_", "a12_", "a20_", "k", "t4_", "r1_")


@pytest.mark.parametrize("name", PLANNED)
def test_plan(spark, name):
    text = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if not name.startswith(PYTHON):
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"windowspecdefinition\((\S+ (ASC|DESC)|specifiedwindowframe)", line), line


def test_scan_reads_only_needed_columns(spark):
    text = plan_of(sa.esp_structure(view(spark, SF, "esp_fx")))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def test_filter_reaches_the_scan(spark):
    from wiretally.fixtures import table
    from wiretally.operators.readmodels import findings_by
    rows = table(spark, SF, "lineitem").withColumnRenamed("l_returnflag", "severity")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_returnflag,A\)", plan_of(findings_by(rows, severity="A")))


def test_rules_need_no_shuffle(spark):
    sas = view(spark, SF, "sa_fx").withColumns({f"{f}_conf": F.lit(1.0) for f in posture.RULE_FIELDS})
    assert "Exchange" not in plan_of(posture.evaluate_rules(sas, posture.load_pack("baseline")))


def test_trailing_windows_are_cut_in_time(spark):
    text = plan_of(th.rolling_count(view(spark, SF, "packets_fx"), "dst"))
    assert re.search(r"hashpartitioning\(dst#\d+, _chunk#\d+", text)
    assert "RangeFrame" not in text


def test_served_scores_read_the_packets_no_more_than_the_evidence_does(spark):
    """Heads score staged windows and SAs, not packets in a scan for each use."""
    assert plan_of(QUERIES["i9_with_scores"](spark, SF)).count("FileScan parquet") <= 2


def test_window_features_deal_packets_twice(spark):
    """Once by chunk and once by window; both readers of the second share it (the plan before it runs lists it for each)."""
    text = plan_of(QUERIES["a12_flow_window_features"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 4


def test_port_scans_make_flow_ids_after_packets_are_dealt(spark):
    """Ids are longer than what they are made of, so they are not shuffled with every packet."""
    text = plan_of(th.port_scan_triggers(view(spark, SF, "packets_fx")))
    assert text.rindex("sha2(") < text.rindex("Exchange hashpartitioning")  # the last one named is the first to run
