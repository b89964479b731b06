"""Plans of the fingerprint join: an exploded side is never broadcast."""

import pytest

from wiretally.llm import simhash


@pytest.mark.parametrize("distance", [3, 5])  # op10, and the near-duplicate stage of the pipeline
def test_exploded_fingerprints_are_not_broadcast(spark, distance):
    fps = spark.range(200).withColumnRenamed("id", "fp")
    text = simhash.links(fps, distance)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in text and "SortMergeJoin" in text and "BroadcastHashJoin" not in text
