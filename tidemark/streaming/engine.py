"""The streaming twin: the same steps, with the state of an agent kept between micro-batches."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.agents import Agent, Desk
from ..operators.features import valid, wide
from ..operators.report import REPORT
from ..plans.config import CATEGORICAL, NUMERIC, Config

STATE = "state string"


def stream_observed(turns: DataFrame, cfg: Config, watermark: str | None = None) -> DataFrame:
    """Turns of a stream, as ``report.REPORT`` has them: reports, alerts decided on, and the log. Keyed on the agent, whose
    warm-up, score and cooldowns span its features.

    The rows of an agent in a micro-batch are taken in order of (``ts``, ``tie``); rows of later micro-batches come after,
    whatever their time. State is JSON in the state store, so a run goes on from its checkpoint.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = wide(valid(turns).withColumn("seq", F.lit(0).cast("long"))).drop("seq")
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    target = to_arrow_schema(StructType.fromDDL(REPORT))

    def run(key, frames, state):
        import pandas as pd

        kept = json.loads(state.get[0]) if state.exists else None
        agent = Agent.restored(kept["agent"], cfg) if kept else Agent(cfg)
        desk = Desk.restored(key[0], kept["desk"], cfg.alerts) if kept else Desk(key[0], cfg.alerts)
        frame = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "tie"], kind="stable")
        out = []
        for row in frame.to_dict("records"):
            values = {k: row[k] for k in NUMERIC if row[k] is not None and not math.isnan(row[k])}
            samples = {k: [s for s in row[k]] for k in CATEGORICAL if row[k] is not None and not isinstance(row[k], float)}
            at = row["ts"].value // 1_000_000
            r = agent.observe(values, samples, at)
            r["alerts"], r["events"] = desk.take(r, at)
            out.append({"agent_id": key[0], "ts": row["ts"], "metadata": row["metadata"], **r})
        state.update((json.dumps({"agent": agent.state(), "desk": desk.state()}),))
        # lists and structs as the strings that the sink's schema has
        yield pd.DataFrame({f.name: [json.dumps(r[f.name]) if f.name in NESTED and r[f.name] is not None else r[f.name] for r in out] for f in target})

    told = ", ".join(f"{f.name} {'string' if f.name in NESTED else f.dataType.simpleString()}" for f in StructType.fromDDL(REPORT))
    rows = rows.groupBy("agent_id").applyInPandasWithState(run, told, STATE, "append", GroupStateTimeout.NoTimeout)
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(REPORT)}
    return rows.select(*(F.from_json(n, kinds[n]).alias(n) if n in NESTED else F.col(n) for n in kinds))


#: Columns of a report that are more than a number or a string.
NESTED = ("findings", "attributions", "forecasts", "alerts", "events", "metadata")


def stream_reports(turns: DataFrame, cfg: Config, watermark: str | None = None) -> DataFrame:
    """The reports of a stream, without what they give rise to."""
    return stream_observed(turns, cfg, watermark).drop("alerts", "events", "metadata", "instant")


def deliver(send: Callable, channels: list[str], sent: str, log: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on ``stream_observed``: sends the alerts that may go out, and adds what became of them, and the
    log, to the tables of files ``sent`` and ``log``, by micro-batch, so that one taken again replaces itself.

    ``send(channel, alert_id, payload)`` raises if it fails. A micro-batch is written once and read from there, so its
    fold isn't run again for each table.
    """
    from ..operators import alerts as A
    from ..sinks import payloads as P

    def batch(seen: DataFrame, number: int) -> None:
        seen = seen.persist()
        try:
            going = A.governed(seen).filter("allowed")
            told = P.publish(going, send, channels)
            folder = f"{sent}/batch={number}"
            told.write.mode("overwrite").parquet(folder)
            if log is not None:
                done = seen.sparkSession.read.parquet(folder).join(going, "alert_id")
                A.telemetry(seen, done).write.mode("overwrite").parquet(f"{log}/batch={number}")
        finally:
            seen.unpersist()

    return batch
