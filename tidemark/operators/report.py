"""From turns to reports: score, severity, findings, attributions, forecasts, alerts and the log, in one fold by agent."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.agents import Agent, Desk
from ..plans.config import CATEGORICAL, NUMERIC, Config

TURN = ["agent_id", "seq"]
FINDING = "struct<feature:string,severity:string,direction:string,score:double,observed:double,expected:double,summary:string>"
SHARE = "struct<feature:string,contribution:double,score:double,direction:string,observed:double,expected:double,summary:string>"
FORECAST = "struct<feature:string,slope:double,hourly:double,steps:long,hours:double,summary:string>"
ALERT = "struct<alert_id:string,at:int,kind:string,severity:string,title:string,message:string,top_feature:string,allowed:boolean,reason:string>"
EVENT = "struct<event_ord:int,kind:string,feature:string,severity:string,message:string>"
REPORT = (
    f"agent_id string, seq long, ts timestamp, status string, severity string, instant double, behavior_score int, findings array<{FINDING}>, attributions array<{SHARE}>, "
    f"forecasts array<{FORECAST}>, alerts array<{ALERT}>, events array<{EVENT}>, metadata map<string,string>"
)


def observed(features: DataFrame, cfg: Config, forecasts: bool = True) -> DataFrame:
    """One row per turn, as ``REPORT``: its report, the alerts that it gives rise to with the governor's decision on each,
    and its part of the log. ``features``: rows of ``features.wide``.

    The one fold behind everything that spans the features of an agent. Rows are dealt by agent, sorted on disk if need
    be, and streamed through one machine, so memory doesn't depend on the length of a history. ``forecasts``: whether
    to look ahead, which fits a line a feature and turn.
    """
    target = to_arrow_schema(StructType.fromDDL(REPORT))
    given = ("agent_id", "seq", "ts", "metadata")
    names = [f.name for f in target]

    def run(batches):
        current, agent, desk = None, None, None
        for batch in batches:
            line = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c not in given}
            numbers, mixes = [(f, line[f]) for f in NUMERIC], [(f, line[f]) for f in CATEGORICAL]
            said: list[dict] = []
            times = batch.column(2).cast(pa.int64())
            for k, (name, at) in enumerate(zip(batch.column(0).to_pylist(), times.to_pylist(), strict=True)):
                if name != current:
                    current, agent, desk = name, Agent(cfg, quantiles=False, forecasts=forecasts), Desk(name, cfg.alerts)
                out = agent.observe({f: x[k] for f, x in numbers if x[k] is not None}, {f: x[k] for f, x in mixes if x[k]}, at // 1000)
                out["alerts"], out["events"] = desk.take(out, at // 1000)
                said.append(out)
            made = {n: pa.array([r[n] for r in said], target.field(n).type) for n in names if n not in given}
            yield pa.RecordBatch.from_arrays([batch.column(given.index(n)).cast(target.field(n).type) if n in given else made[n] for n in names], schema=target)

    rows = features.select(*given, *NUMERIC, *CATEGORICAL)
    return rows.repartition("agent_id").sortWithinPartitions("agent_id", "seq").mapInArrow(run, REPORT)


def reports(seen: DataFrame) -> DataFrame:
    """The reports: (``agent_id``, ``seq``, ``ts``, ``status``, ``severity``, ``behavior_score``, ``findings``,
    ``attributions``, ``forecasts``), arrays in the order of reporting."""
    return seen.select(*TURN, "ts", "status", "severity", "behavior_score", "findings", "attributions", "forecasts")


def scores(seen: DataFrame) -> DataFrame:
    """(``agent_id``, ``seq``, ``ts``, ``instant``, ``behavior_score`` 0 to 100): the root mean square of all deviations of a
    turn, zeros too, smoothed over turns and turned into a score."""
    return seen.select(*TURN, "ts", "instant", "behavior_score")


def attributions(seen: DataFrame) -> DataFrame:
    """What a turn's deviation comes from: the features that deviate or have findings, at most five, with their share of
    the squared deviation: (``agent_id``, ``seq``, ``rank``, ``feature``, ``contribution``, ``score``, ``direction``,
    ``observed``, ``expected``, ``summary``)."""
    return seen.select(*TURN, F.posexplode("attributions").alias("at", "a")).select(*TURN, (F.col("at") + 1).alias("rank"), "a.*")


def forecasts(seen: DataFrame) -> DataFrame:
    """The forecasts in force at each turn, of features that it lacks too: (``agent_id``, ``seq``, ``ts``, ``feature``, ...)."""
    return seen.select(*TURN, "ts", F.explode("forecasts").alias("f")).select(*TURN, "ts", "f.*")


def fresh_forecasts(found: DataFrame) -> DataFrame:
    """Forecasts of features for which the agent's turn before had none."""
    before = F.lag("seq").over(Window.partitionBy("agent_id", "feature").orderBy("seq"))
    return found.withColumn("before", before).filter("before is null or before < seq - 1").drop("before")


def latest(reported: DataFrame) -> DataFrame:
    """Each agent's last report."""
    best = F.max_by(F.struct(*[c for c in reported.columns if c != "agent_id"]), "seq").alias("r")
    return reported.groupBy("agent_id").agg(best).select("agent_id", "r.*")


def recoveries(reported: DataFrame) -> DataFrame:
    """Reports without a finding, after one with: (``agent_id``, ``seq``, ``ts``, ``behavior_score``)."""
    before = F.lag("severity").over(Window.partitionBy("agent_id").orderBy("seq"))
    return reported.withColumn("before", before).filter("severity = 'none' and before <> 'none'").select("agent_id", "seq", "ts", "behavior_score")
