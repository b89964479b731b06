"""Served heads in analysis and detection: from scored windows and SAs to evidence and alerts.

A head turns rows into class probabilities. Heads are looked up in the registry of promoted
versions; a task without one is simply not there, and the evidence falls back to structure or stays
unknown. Scoring adds columns to one plan: no head needs a join of its own.
"""

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.operators.sa import KEY
from wiretally.plans import inference, training

#: Head of the registry -> evidence field it speaks for.
FIELDS = {"mode": "mode", "cipher": "enc", "integ": "integ", "pfs": "pfs", "dh_group": "dh_group"}


@dataclass
class Head:
    """``scorer`` adds ``probs``, in the order of ``classes``; ``q`` is the conformal threshold."""

    scorer: object
    classes: list
    q: float = 0.0
    version: str = "unknown"
    needs: tuple = field(default=())

    def __call__(self, df: DataFrame) -> DataFrame:
        """Adds probs, prediction, p_top, prediction_set and set_confidence."""
        return inference.conformal_sets(self.scorer(df), self.q, self.classes)


def head_of(model: PipelineModel, curve=None, q: float = 0.0, version: str = "unknown") -> Head:
    """A trained head, with its calibration where there is one."""
    def scorer(df):
        out = training.score_head(df, model).drop("prediction", "p_top")
        return out if curve is None else curve.transform(out)
    return Head(scorer, training.classes_of(model), q or 0.0, version)


def load_heads(registry: DataFrame, path: str, tasks) -> dict:
    """Heads of the registered versions of ``tasks``; ``registry`` has task, version and perhaps q. A task without a version has no head."""
    out = {}
    for row in registry.filter(F.col("task").isin(*tasks) & F.col("version").isNotNull()).collect():  # one row per task
        model = PipelineModel.load(f"{path}/{row['task']}/{row['version']}")
        out[row["task"]] = head_of(model, None, row["q"] if "q" in registry.columns else 0.0, row["version"])
    return out


def score_sas(features: DataFrame, heads: dict) -> DataFrame:
    """Per SA the prediction and confidence of every served head, named as ``inference.sa_evidence`` reads them."""
    out, names = features, []
    for task, field_ in FIELDS.items():
        if task in heads:
            value = F.lower("prediction") == "true" if field_ == "pfs" else F.col("prediction")
            out = heads[task](out).withColumns({f"{field_}_pred": value, f"{field_}_p": F.col("set_confidence")})
            out = out.drop("probs", "prediction", "p_top", "prediction_set", "set_confidence")
            names += [f"{field_}_pred", f"{field_}_p"]
    return out.select(*KEY, *names)


def score_windows(windows: DataFrame, heads: dict) -> DataFrame:
    """Windows with the traffic head's prediction, set and confidence; without a head the columns are null."""
    if "traffic" not in heads:
        null = lambda kind: F.lit(None).cast(kind)
        return windows.withColumns({"prediction": null("string"), "p_top": null("double"), "prediction_set": null("array<string>"), "set_confidence": null("double")})
    return heads["traffic"](windows).drop("probs")


def traffic_of(scored: DataFrame, order: str = "win_us") -> DataFrame:
    """Votes of an SA's windows and the union of their sets: traffic_top, traffic_confidence, conformal_set."""
    seen = scored.filter(F.col("prediction").isNotNull())
    votes = inference.aggregate_votes(seen.select(*KEY, order, F.col("prediction").alias("pred"), F.col("set_confidence").alias("p")), KEY, order)
    return votes.join(inference.union_of_sets(seen, KEY), KEY, "left")


def threat_scorer(model: PipelineModel, task: str, version: str, curve=None):
    """A function from detector features to scores, as ``threats.detect_all`` takes it; the score is that of class 1."""
    head, classes = head_of(model, curve, version=version), training.classes_of(model)
    spot = next((i for i, c in enumerate(classes) if c in ("1", "true", "True")), len(classes) - 1)

    def score(features: DataFrame) -> DataFrame:
        ids = [c for c in ("capture_id", "packet_no") if c in features.columns]
        return head.scorer(features).select(*ids, F.get("probs", F.lit(spot)).alias("score"), F.lit(f"{task}-{version}").alias("model_version"))
    return score
