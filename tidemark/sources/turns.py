"""Turns from tables, spans, provider events and a simulator."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.features import TURN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_turns(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` as turns: the given columns, null for the others."""
    return rows.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TURN)))


def read_turns(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Turns in JSON lines, of files that are there or that arrive; lines that don't parse come with a null agent, which
    ``features.quarantined`` holds back."""
    reader = (spark.readStream if streaming else spark.read).schema(TURN).option("mode", "PERMISSIVE")
    return reader.json(path)


def events_by_type(events: DataFrame) -> DataFrame:
    """A few agents with long histories."""
    return as_turns(events, agent_id=F.col("event_type"), ts=F.col("ts").cast("timestamp"), latency_ms=F.col("value"), retrieval_chunks=F.get_json_object("props", "$.k").cast("double"), tie=F.col("event_id"))


def events_on_a_ramp(events: DataFrame) -> DataFrame:
    """A few agents whose latency climbs for some hundred turns, falls back, and climbs again."""
    climb = F.lit(500.0) + F.col("value") + F.lit(0.4) * (F.col("event_id") % 2000)
    return as_turns(events, agent_id=F.col("event_type"), ts=F.col("ts").cast("timestamp"), latency_ms=climb, tie=F.col("event_id"))


def events_by_user(events: DataFrame) -> DataFrame:
    """Many agents with short histories, with a mix of categories and errors."""
    return as_turns(events, agent_id=F.col("user_id").cast("string"), ts=F.col("ts").cast("timestamp"), latency_ms=F.col("value"), finish_reason=F.col("event_type"), error_flag=F.col("event_type") == "error", tie=F.col("event_id"))


def lineitem_by_supplier(lineitem: DataFrame) -> DataFrame:
    """Many agents, several numeric features, a category and an error rate."""
    tie = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    return as_turns(
        lineitem, agent_id=F.col("l_suppkey").cast("string"), ts=F.col("l_shipdate").cast("timestamp"), cost_usd=F.col("l_extendedprice"), input_tokens=F.col("l_quantity"),
        context_tokens=F.col("l_discount") * 100, finish_reason=F.col("l_returnflag"), error_flag=F.col("l_returnflag") == "R", tie=tie,
    )


def orders_as_turns(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Turns with tool calls: one per line of an order, none for orders without lines."""
    call = F.struct(F.col("l_returnflag").alias("name"), (F.col("l_linestatus") == "F").alias("ok"), F.lit(None).cast("double").alias("latency_ms"))
    calls = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(call)).alias("calls"))
    none = F.array().cast("array<struct<name:string,ok:boolean,latency_ms:double>>")
    both = orders.join(calls, "o_orderkey", "left")
    return as_turns(both, agent_id=F.col("o_orderpriority"), ts=F.col("o_orderdate").cast("timestamp"), cost_usd=F.col("o_totalprice"), tool_calls=F.coalesce("calls", none), finish_reason=F.col("o_orderstatus"), tie=F.col("o_orderkey"))


def conversations_as_turns(conversations: DataFrame) -> DataFrame:
    """Turns by role; of a text only its length counts."""
    tie = F.col("conv_id") * 100_000 + F.col("turn")
    return as_turns(conversations, agent_id=F.col("role"), ts=F.timestamp_seconds(tie), turn_index=F.col("turn"), output_tokens=F.length("text"), tie=tie)


# -- spans -----------------------------------------------------------------------------------------------------------

# fixed values: attribute keys here and below, as spans carry them
AGENT_KEYS = ("gen_ai.agent.id", "gen_ai.agent.name", "agent.id", "service.name")
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def string_attribute(attributes: Column, *keys: str) -> Column:
    """The first non-empty attribute; of a JSON array the first string."""
    found = []
    for k in keys:
        v = F.try_element_at(attributes, F.lit(k))
        first = F.when(v.startswith("["), F.get_json_object(v, "$[0]")).otherwise(v)
        found.append(F.when(first != "", first))
    return F.coalesce(*found)


def number_attribute(attributes: Column, *keys: str) -> Column:
    """The first attribute that is a finite number."""
    found = (F.try_element_at(attributes, F.lit(k)) for k in keys)
    return F.coalesce(*(F.when(v.rlike(NUMBER), F.trim(v).cast("double")) for v in found))


def turns_from_spans(spans: DataFrame, agent_id: str | None = None, tool_prefix: str = "tool:", agent_keys: tuple[str, ...] = AGENT_KEYS) -> DataFrame:
    """Turns of spans (``name``, ``attributes`` map of strings, ``start_unix_nano``, ``end_unix_nano`` string,
    ``start_hr``, ``end_hr`` array of seconds and nanoseconds, ``start_ms``, ``end_ms`` double, ``duration_ms`` double,
    ``status`` string, ``span_id`` long). One projection; spans without an agent are dropped."""
    a = F.col("attributes")
    number = lambda c: F.when(F.col(c).rlike(NUMBER), F.col(c).cast("double"))
    hr = lambda c: F.col(c)[0] * 1000.0 + F.col(c)[1] / 1e6
    start = F.coalesce(number("start_unix_nano") / 1e6, hr("start_hr"), F.col("start_ms"))
    end = F.coalesce(number("end_unix_nano") / 1e6, hr("end_hr"), F.col("end_ms"))
    epoch = F.coalesce(number("end_unix_nano") / 1e6, F.when(F.col("end_hr").isNull(), F.col("end_ms")))
    duration = F.when(~F.isnan("duration_ms"), F.col("duration_ms"))
    tokens_in = number_attribute(a, "gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens")
    tokens_out = number_attribute(a, "gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens")
    tool = string_attribute(a, "gen_ai.tool.name", "tool.name")
    is_tool = string_attribute(a, "gen_ai.operation.name").isin("execute_tool", "tool") | (tool.isNotNull() & tokens_in.isNull() & tokens_out.isNull())
    is_tool = F.coalesce(is_tool, F.lit(False))
    error = F.upper("status").isin("2", "ERROR", "STATUS_CODE_ERROR")
    name = F.coalesce(tool, F.when(F.col("name") != "", F.col("name")))
    fixed = F.lit(agent_id) if agent_id else F.lit(None).cast("string")
    agent = F.coalesce(fixed, F.when(is_tool, F.concat(F.lit(tool_prefix), name)).otherwise(string_attribute(a, *agent_keys)))
    ok = F.coalesce(~error, F.lit(True))
    call = F.array(F.struct(name.alias("name"), ok.alias("ok"), F.coalesce(duration, end - start).alias("latency_ms")))
    rows = spans.withColumns({"__agent": F.when(~is_tool | name.isNotNull(), agent), "__tool": is_tool})
    turn = lambda c: F.when(~F.col("__tool"), c)
    out = as_turns(
        rows, agent_id=F.col("__agent"), ts=F.timestamp_millis(F.floor(epoch).cast("long")), latency_ms=F.coalesce(duration, end - start), input_tokens=turn(tokens_in), output_tokens=turn(tokens_out),
        cost_usd=turn(number_attribute(a, "gen_ai.usage.cost", "llm.usage.total_cost")), finish_reason=turn(string_attribute(a, "gen_ai.response.finish_reasons", "gen_ai.response.finish_reason")),
        tool_calls=F.when(F.col("__tool"), call), error_flag=F.when(error, F.lit(True)), tie=F.col("span_id"),
    )
    return out.filter("agent_id is not null")


def spans_from_events(events: DataFrame) -> DataFrame:
    """Spans of five shapes, made of events."""
    i, v = F.col("event_id"), F.col("value")
    shape = i % 5
    end = F.unix_micros(F.col("ts").cast("timestamp"))
    entry = lambda when, k, value: F.when(when, F.struct(F.lit(k).alias("k"), value.cast("string").alias("v")))
    entries = F.array(
        entry(shape.isin(0, 4), "gen_ai.agent.id", F.concat(F.lit("agent-"), F.col("user_id") % 7)),
        entry(shape == 0, "gen_ai.usage.input_tokens", i % 1000),
        entry(shape == 0, "gen_ai.usage.output_tokens", F.col("user_id")),
        entry(shape == 0, "gen_ai.response.finish_reasons", F.concat(F.lit('["'), F.col("event_type"), F.lit('"]'))),
        entry(shape == 1, "service.name", F.col("event_type")),
        entry(shape == 1, "gen_ai.usage.prompt_tokens", v),
        entry(shape == 1, "gen_ai.usage.input_tokens", F.lit("  ")),
        entry(shape == 1, "llm.usage.total_cost", v / 1000),
        entry(shape == 2, "gen_ai.operation.name", F.lit("execute_tool")),
        entry(shape.isin(2, 4), "gen_ai.tool.name", F.lit("search")),
        entry(shape == 3, "gen_ai.usage.input_tokens", F.lit("12")),
        entry(shape == 4, "gen_ai.usage.output_tokens", F.lit("5")),
    )
    return events.select(
        i.alias("span_id"), F.col("event_type").alias("name"), F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("attributes"),
        F.when(shape.isin(0, 2), ((end - (v * 1000).cast("long")) * 1000).cast("string")).alias("start_unix_nano"), F.when(shape.isin(0, 2), (end * 1000).cast("string")).alias("end_unix_nano"),
        F.when(shape == 4, F.array(F.lit(10), F.lit(0))).cast("array<long>").alias("start_hr"), F.when(shape == 4, F.array(F.lit(10), F.lit(250000000))).cast("array<long>").alias("end_hr"),
        F.lit(None).cast("double").alias("start_ms"), F.lit(None).cast("double").alias("end_ms"), F.when(shape == 1, v).alias("duration_ms"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"),
    )


# -- provider events ---------------------------------------------------------------------------------------------------


def turns_from_key_events(events: DataFrame, agent_id: str | None = None, per_key: bool = True) -> DataFrame:
    """Turns of a key pool's events (``type``, ``ts``, ``key_id``, ``elapsed_ms``, ``tie``)."""
    kind, key = F.col("type"), F.col("key_id")
    pool = F.lit(agent_id or "keymesh:pool")
    agent = pool if agent_id or not per_key else F.when(key.isNotNull() & (kind != "all.exhausted"), F.concat(F.lit("keymesh:"), key)).otherwise(pool)
    call = kind.isin("request.success", "request.fail")
    rows = events.filter(kind.isin("request.success", "request.fail", "circuit.open", "all.exhausted"))
    calls = F.array(F.struct(F.concat(F.lit("key:"), key).alias("name"), (kind == "request.success").alias("ok"), F.lit(None).cast("double").alias("latency_ms")))
    return as_turns(rows, agent_id=agent, ts=F.col("ts"), latency_ms=F.when(call, F.col("elapsed_ms")), tool_calls=F.when(call & key.isNotNull(), calls), error_flag=F.when(kind != "request.success", F.lit(True)), finish_reason=F.when(~call, kind), tie=F.col("tie"))


def turns_from_model_events(events: DataFrame, agent_id: str | None = None, per_model: bool = True) -> DataFrame:
    """Turns of a model router's events (``type``, ``ts``, ``model_id``, ``latency_ms``, ``cost_usd``, ``input_tokens``,
    ``output_tokens``, ``finish_reason``, ``tie``)."""
    kind, model = F.col("type"), F.col("model_id")
    router = F.lit(agent_id or "modelchain:router")
    agent = router if agent_id or not per_model else F.when(model.isNotNull(), F.concat(F.lit("modelchain:"), model)).otherwise(router)
    done = kind.isin("request.success", "stream.finish")
    rows = events.filter(done | (kind == "request.fail"))
    good = {c: F.when(done, F.col(c)) for c in ("latency_ms", "cost_usd", "input_tokens", "output_tokens", "finish_reason")}
    return as_turns(rows, agent_id=agent, ts=F.col("ts"), error_flag=F.when(~done, F.lit(True)), tie=F.col("tie"), **good)


def key_events(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("request.success", "request.fail", "circuit.open", "all.exhausted", "key.rotated"))), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select(kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("k"), F.col("user_id") % 4)).alias("key_id"), F.col("value").alias("elapsed_ms"), F.col("event_id").alias("tie"))


def model_events(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("request.success", "request.fail", "stream.finish", "model.skipped"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("m"), F.col("user_id") % 3)).alias("model_id"), F.col("value").alias("latency_ms"), (F.col("value") / 1000).alias("cost_usd"), (F.col("user_id") * 10).cast("double").alias("input_tokens"), F.col("user_id").cast("double").alias("output_tokens"), F.lit("stop").alias("finish_reason"), F.col("event_id").alias("tie"))


# -- simulator ---------------------------------------------------------------------------------------------------------


class Uniform:
    """A linear congruential generator of uniform and normal numbers."""

    def __init__(self, seed: int):
        self.state = seed % (1 << 32)

    def __call__(self) -> float:
        self.state = (self.state * 1664525 + 1013904223) % (1 << 32)
        return self.state / (1 << 32)

    def normal(self) -> float:
        a = max(self(), 1e-12)
        return math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * self())

    def pick(self, names, weights) -> str:
        u, total = self(), 0.0
        for name, w in zip(names, weights, strict=True):
            total += w
            if u < total:
                return name
        return names[-1]


# fixed values: clock, tools, shares and the order of draws of the simulated run, whose published figures depend on them
CLOCK, STEP, TOOLS = 1_750_000_000_000, 30_000, ("web_search", "db_query", "calculator")


def simulated_turns(seed: int, turns: int, drift_at: int, agent: str = "sim-agent"):
    """Healthy turns, and from ``drift_at`` on slower ones over a ramp of 50, with other tools, errors and endings."""
    u = Uniform(seed)
    for turn in range(1, turns + 1):
        bad = turn > drift_at
        slow = 1 + 0.8 * min(1, (turn - drift_at) / 50) if bad else 1
        latency = max(1.0, (800 + u.normal() * 120) * slow)
        cost = 0.002 + u() * 0.0005
        tokens = [math.floor(1200 + (u() * 2 - 1) * 200 + 0.5), math.floor(300 + (u() * 2 - 1) * 80 + 0.5)]
        ok = u() > (0.15 if bad else 0.02)
        tool = u.pick(TOOLS, (0.1, 0.2, 0.7) if bad else (0.5, 0.3, 0.2))
        finish = "length" if u() < (0.4 if bad else 0.05) else "stop"
        yield {
            "agent_id": agent, "ts": datetime.fromtimestamp((CLOCK + (turn - 1) * STEP) / 1000, timezone.utc), "latency_ms": latency, "cost_usd": cost, "input_tokens": float(tokens[0]),
            "output_tokens": float(tokens[1]), "tool_calls": [{"name": tool, "ok": ok, "latency_ms": None}], "finish_reason": finish, "error_flag": not ok, "tie": turn,
        }


def simulate(spark: SparkSession, seeds: list[int], turns: int = 200, drift_at: int | None = None) -> DataFrame:
    """Simulated turns, one agent per seed; seeds are dealt out over tasks."""
    import pyarrow as pa

    after = turns * 6 // 10 if drift_at is None else drift_at
    target = to_arrow_schema(StructType.fromDDL(TURN))
    one = len(seeds) == 1

    def run(batches):
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(list(simulated_turns(seed, turns, after, "sim-agent" if one else f"sim-{seed}")), target)

    return spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(max(1, min(len(seeds), 64))).mapInArrow(run, TURN)
