"""Alerts, decided on, and the log of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def governed(seen: DataFrame, enrich: Callable[[Column], Column] | None = None) -> DataFrame:
    """The alerts of ``report.observed``, each with the governor's decision: (``alert_id``, ``agent_id``, ``seq``, ``ts``, ``at``,
    ``kind``, ``severity``, ``title``, ``message``, ``behavior_score``, ``attributions``, ``top_feature``, ``metadata`` of the turn,
    ``allowed``, ``reason``).

    In a canary run none goes out (``canary``); a drift alert below the least severity doesn't (``below-min-severity``); nor
    does one within the cooldown after the last of its agent, kind and top feature, unless its severity is higher
    (``cooldown``). Time is event time. Suppressed alerts don't start a cooldown. ``enrich``: from the message to the one
    that is sent, as columns.
    """
    rows = seen.select("agent_id", "seq", "ts", "behavior_score", "attributions", "metadata", F.explode("alerts").alias("a"))
    message = enrich(F.col("a.message")) if enrich else F.col("a.message")
    return rows.select("a.alert_id", "agent_id", "seq", "ts", "a.at", "a.kind", "a.severity", "a.title", message.alias("message"), "behavior_score", "attributions", "a.top_feature", "metadata", "a.allowed", "a.reason")


def deliveries(alerts: DataFrame, channels: list[str]) -> DataFrame:
    """One row per allowed alert and channel; without channels none."""
    names = F.array(*map(F.lit, channels)).cast("array<string>") if channels else F.array().cast("array<string>")
    return alerts.filter("allowed").withColumn("channel", F.explode(names))


#: The place of a delivery, and of saving the state, in the log of a turn.
DELIVERED, PERSISTED = 1000, 10_000


def telemetry(seen: DataFrame, sent: DataFrame | None = None, persisted: DataFrame | None = None) -> DataFrame:
    """The log of a run: (``agent_id``, ``seq``, ``event_ord``, ``ts``, ``kind``, ``feature``, ``severity``, ``message``).

    ``sent``: what became of deliveries, with the alert's columns and (``channel``, ``ok``, ``error``), as ``dispatched`` and
    ``failed`` events. ``persisted``: (``agent_id``, ``seq``, ``ts``) of turns after which the state was saved.
    """
    log = seen.select("agent_id", "seq", "ts", F.explode("events").alias("e")).select("agent_id", "seq", "e.event_ord", "ts", "e.kind", "e.feature", "e.severity", "e.message")
    none = F.lit(None).cast("string")
    if sent is not None:
        kind = F.when(F.col("ok"), "alert.dispatched").otherwise("alert.failed")
        said = F.when(F.col("ok"), F.col("channel")).otherwise(F.concat_ws(": ", "channel", "error"))
        log = log.unionByName(sent.select("agent_id", "seq", (F.col("at") + DELIVERED).alias("event_ord"), "ts", kind.alias("kind"), none.alias("feature"), "severity", said.alias("message")))
    if persisted is not None:
        log = log.unionByName(persisted.select("agent_id", "seq", F.lit(PERSISTED).alias("event_ord"), "ts", F.lit("state.persisted").alias("kind"), none.alias("feature"), none.alias("severity"), none.alias("message")))
    return log
