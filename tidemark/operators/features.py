"""From turns to features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import CATEGORICAL, NUMERIC

TURN = (
    "agent_id string, ts timestamp, latency_ms double, cost_usd double, input_tokens double, output_tokens double, context_tokens double, "
    "retrieval_chunks double, turn_index double, tool_calls array<struct<name:string,ok:boolean,latency_ms:double>>, task_id string, "
    "finish_reason string, error_flag boolean, error_class string, metadata map<string,string>, tie bigint"
)


def valid(turns: DataFrame) -> DataFrame:
    """Turns with a non-empty agent. One without a time has that of its arrival: the run's, or the micro-batch's."""
    return turns.filter(F.coalesce(F.col("agent_id"), F.lit("")) != "").withColumn("ts", F.coalesce("ts", F.current_timestamp()))


def quarantined(turns: DataFrame) -> DataFrame:
    """Turns that no agent can be given."""
    return turns.filter(F.coalesce(F.col("agent_id"), F.lit("")) == "")


def sequenced(turns: DataFrame) -> DataFrame:
    """Turns numbered per agent in the total order (``ts``, ``tie``), from 1: what arrival order is elsewhere."""
    return valid(turns).withColumn("seq", F.row_number().over(Window.partitionBy("agent_id").orderBy("ts", "tie")).cast("long"))


def finite(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def wide(turns: DataFrame) -> DataFrame:
    """One row per turn with the numeric features, null where a turn has none, and samples of the categorical ones;
    and what goes along with a turn: its metadata, and its place among those of one time."""
    n = {c: finite(F.col(c)) for c in ("latency_ms", "cost_usd", "input_tokens", "output_tokens", "context_tokens", "retrieval_chunks", "turn_index")}
    total = F.when(n["input_tokens"].isNotNull() | n["output_tokens"].isNotNull(), F.coalesce(n["input_tokens"], F.lit(0.0)) + F.coalesce(n["output_tokens"], F.lit(0.0)))
    snr = F.when(n["context_tokens"] > 0, n["output_tokens"] / n["context_tokens"])
    calls = F.when(F.col("tool_calls").isNotNull(), F.size("tool_calls").cast("double"))
    failed = F.size(F.filter("tool_calls", lambda c: ~c["ok"])).cast("double")
    error = F.when(F.coalesce(F.col("error_flag"), F.lit(False)) | F.col("error_class").isNotNull(), 1.0).otherwise(0.0)
    return turns.select(
        "agent_id",
        "seq",
        "ts",
        n["latency_ms"].alias("latencyMs"),
        n["cost_usd"].alias("costUsd"),
        n["input_tokens"].alias("inputTokens"),
        n["output_tokens"].alias("outputTokens"),
        total.alias("totalTokens"),
        n["context_tokens"].alias("contextTokens"),
        snr.alias("contextSnr"),
        n["retrieval_chunks"].alias("retrievalChunks"),
        n["turn_index"].alias("turnIndex"),
        calls.alias("toolCallCount"),
        F.when(calls > 0, failed / calls).alias("toolFailureRate"),
        error.alias("errorRate"),
        F.transform("tool_calls", lambda c: c["name"]).alias("toolSelection"),
        F.when(F.col("finish_reason").isNotNull(), F.array("finish_reason")).alias("finishReason"),
        "metadata",
        "tie",
    )


def long(features: DataFrame) -> DataFrame:
    """One row per turn and feature that it has: (``agent_id``, ``seq``, ``ts``, ``feature``, ``feature_ord``, ``value``,
    ``samples``), in the order in which features are reported."""
    numeric = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("feature_ord"), F.col(f).alias("value"), F.lit(None).cast("array<string>").alias("samples")) for i, f in enumerate(NUMERIC)]
    mixes = [F.struct(F.lit(f).alias("feature"), F.lit(len(NUMERIC) + i).alias("feature_ord"), F.lit(None).cast("double").alias("value"), F.col(f).alias("samples")) for i, f in enumerate(CATEGORICAL)]
    rows = features.select("agent_id", "seq", "ts", F.explode(F.array(*numeric, *mixes)).alias("f")).select("agent_id", "seq", "ts", "f.*")
    return rows.filter("value is not null or size(samples) > 0")


def tool_samples(turns: DataFrame) -> DataFrame:
    """One row per tool call: (``agent_id``, ``seq``, ``at``, ``tool``, ``ok``)."""
    return turns.select("agent_id", "seq", F.posexplode("tool_calls").alias("at", "c")).select("agent_id", "seq", "at", F.col("c.name").alias("tool"), F.col("c.ok").alias("ok"))


def admitted(turns: DataFrame, max_agents: int) -> DataFrame:
    """Turns with ``admitted``: whether their agent is among the first ``max_agents`` to appear. Each task keeps the first
    agents it has, and no more than ``max_agents`` of a task meet; batch only, as a stream has no first appearance across
    partitions."""
    first = turns.groupBy("agent_id").agg(F.min(F.struct("ts", "tie")).alias("first"))
    rank = first.orderBy("first", "agent_id").limit(max_agents).select(F.col("agent_id").alias("__agent"))
    both = turns.join(rank, turns["agent_id"] == F.col("__agent"), "left")
    return both.withColumn("admitted", F.col("__agent").isNotNull()).drop("__agent")
