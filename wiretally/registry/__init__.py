"""Registered queries: every inventory operator applied to the stored tables.

A query takes (spark, sf_dir); where SQL can state the same result, the oracle
text sits next to it.
"""

from wiretally.registry.base import ORACLES, QUERIES  # noqa: F401
from wiretally.registry import features, ike, packets, posture, evaluation, readmodels, threats, models, sources, streams  # noqa: F401
