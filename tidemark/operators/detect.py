"""Detection in batch: each feature of each agent is a key of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tracks import track
from ..plans.config import Config
from .keyed import fold_by_key

EVALUATION = (
    "agent_id string, seq long, ts timestamp, feature string, feature_ord int, learning boolean, z double, deviation double, finding string, direction string, score double, observed double, "
    "expected double, shift string, moved string, frozen boolean, severity string, summary string"
)


def millis(ts) -> int:
    return int(ts.timestamp() * 1000)


def evaluate(features: DataFrame, cfg: Config, only: list[str] | None = None) -> DataFrame:
    """Every observation of every feature, judged against what its agent did before: rows as ``EVALUATION``.

    ``features``: as ``features.long`` gives them; of ``only`` some if named, chosen before they are dealt. The warm-up is
    the agent's first ``cfg.warmup`` turns, known from ``seq`` alone, which is what lets features of one agent be separate
    keys. Forecasts and scores need all features of a turn: ``report.observed`` has them.
    """

    def make(agent, feature):
        state = track(feature, cfg, quantiles=False)

        def step(row):
            learning = row["seq"] <= cfg.warmup
            found = state.step(row["samples"] if row["value"] is None else row["value"], millis(row["ts"]), learning)
            yield {**row, "learning": learning, **found, "frozen": state.frozen, "severity": state.severity}

        return step

    rows = features.filter(F.col("feature").isin(only)) if only else features
    return fold_by_key(rows, ["agent_id", "feature"], ["seq"], make, EVALUATION)


def findings(evaluated: DataFrame) -> DataFrame:
    """What is reported: (``agent_id``, ``seq``, ``ts``, ``feature``, ``feature_ord``, ``severity``, ``direction``, ``score``, ``observed``, ``expected``, ``summary``)."""
    return evaluated.filter("finding is not null").select("agent_id", "seq", "ts", "feature", "feature_ord", F.col("finding").alias("severity"), "direction", "score", "observed", "expected", "summary")


def transitions(evaluated: DataFrame) -> DataFrame:
    """Where a feature's severity moved: (``agent_id``, ``seq``, ``feature``, ``severity``)."""
    return evaluated.filter("moved is not null").select("agent_id", "seq", "feature", F.col("moved").alias("severity"))


SNAPSHOT = "agent_id string, feature string, feature_ord int, count long, mean double, std_dev double, ewma_mean double, ewma_std_dev double, p50 double, p95 double, p99 double, min double, max double, baseline map<string,double>, recent map<string,double>, divergence double, frozen boolean, state string"


def snapshot(features: DataFrame, cfg: Config, absorb: bool = False, restore: DataFrame | None = None) -> DataFrame:
    """The state of each feature after its last observation, as ``SNAPSHOT``; ``state`` is JSON that ``restore`` takes.

    ``absorb``: the window has become the baseline. ``restore``: rows (``agent_id``, ``feature``, ``state``) to go on from.
    """
    import json

    from ..functions.tracks import Categorical, Numeric, divergence

    rows = features.withColumn("last", F.lit(False)).withColumn("restored", F.lit(None).cast("string"))
    ends = features.groupBy("agent_id", "feature", "feature_ord").agg(F.max("seq").alias("seq"))
    marks = ends.select("agent_id", (F.col("seq") + 1).alias("seq"), F.lit(None).cast("timestamp").alias("ts"), "feature", "feature_ord", F.lit(None).cast("double").alias("value"), F.lit(None).cast("array<string>").alias("samples"), F.lit(True).alias("last"), F.lit(None).cast("string").alias("restored"))
    rows = rows.unionByName(marks)
    if restore is not None:
        old = restore.join(ends.select("agent_id", "feature", "feature_ord"), ["agent_id", "feature"])
        rows = rows.unionByName(old.select("agent_id", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), "feature", "feature_ord", F.lit(None).cast("double").alias("value"), F.lit(None).cast("array<string>").alias("samples"), F.lit(False).alias("last"), F.col("state").alias("restored")))

    def make(agent, feature):
        state = track(feature, cfg)

        def step(row):
            nonlocal state
            if row["restored"] is not None:
                state = type(state).restored(feature, json.loads(row["restored"]), cfg)
                return
            if not row["last"]:
                state.step(row["samples"] if row["value"] is None else row["value"], millis(row["ts"]), row["seq"] <= cfg.warmup)
                return
            if absorb:
                state.absorb()
            out = {"agent_id": agent, "feature": feature, "feature_ord": row["feature_ord"], "frozen": state.frozen, "state": json.dumps(state.state())}
            if isinstance(state, Numeric):
                m = state.moments
                out |= {"count": m.n, "mean": m.mean, "std_dev": m.std, "ewma_mean": state.ewma.mean, "ewma_std_dev": state.ewma.std, "p50": state.quantiles[0].value, "p95": state.quantiles[1].value, "p99": state.quantiles[2].value, "min": m.low or 0.0, "max": m.high or 0.0}
            elif isinstance(state, Categorical):
                out |= {"count": sum(state.counts.values()), "baseline": list(state.baseline().items()), "recent": list(state.recent().items()), "divergence": divergence(state.baseline(), state.recent())}
            yield out

        return step

    return fold_by_key(rows, ["agent_id", "feature"], ["seq", "last"], make, SNAPSHOT)
