"""Named queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native
from ..operators import alerts as A
from ..operators import detect as D
from ..operators import features as X
from ..operators import report as R
from ..plans import engine_sql as E
from ..plans.config import AlertPolicy, Config
from ..sinks import payloads as P
from ..sources import turns as S

TYPE = Config(warmup=50, window=50)
USER = Config(warmup=20, window=10)
RAMP = Config(warmup=50, window=30, alerts=AlertPolicy(cooldown_ms=6 * 3_600_000))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def by_type(spark: SparkSession, sf: str) -> DataFrame:
    return X.sequenced(S.events_by_type(S.table(spark, sf, "events")))


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    return X.sequenced(S.events_by_user(S.table(spark, sf, "events")))


def by_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return X.sequenced(S.lineitem_by_supplier(S.table(spark, sf, "lineitem")))


def by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return X.sequenced(S.orders_as_turns(S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem")))


def by_ramp(spark: SparkSession, sf: str) -> DataFrame:
    return X.sequenced(S.events_on_a_ramp(S.table(spark, sf, "events")))


def judged(turns: DataFrame, cfg: Config, *only: str) -> DataFrame:
    return D.evaluate(X.long(X.wide(turns)), cfg, list(only) or None)


def seen(turns: DataFrame, cfg: Config, forecasts: bool = True) -> DataFrame:
    return R.observed(X.wide(turns), cfg, forecasts)


def ramp(spark, sf) -> DataFrame:
    return seen(by_ramp(spark, sf), RAMP)


TYPED = "SELECT *, event_type AS agent_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"
USERS = "SELECT *, CAST(user_id AS VARCHAR) AS agent_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"


@query(
    "SELECT CAST(l_suppkey AS VARCHAR) AS agent_id, count(*) AS turns, round(sum(l_extendedprice), 2) AS cost, round(sum(l_quantity), 2) AS input_tokens, round(sum(l_quantity), 2) AS total_tokens, "
    "round(sum(l_discount * 100), 4) AS context_tokens, count(*) FILTER (l_returnflag = 'R') * 1.0::DOUBLE AS errors, CAST(0 AS BIGINT) AS with_snr FROM lineitem GROUP BY ALL"
)
def feature_wide(spark, sf):
    w = X.wide(S.lineitem_by_supplier(S.table(spark, sf, "lineitem")).withColumn("seq", F.lit(0)))
    return w.groupBy("agent_id").agg(F.count("*").alias("turns"), F.round(F.sum("costUsd"), 2).alias("cost"), F.round(F.sum("inputTokens"), 2).alias("input_tokens"), F.round(F.sum("totalTokens"), 2).alias("total_tokens"), F.round(F.sum("contextTokens"), 4).alias("context_tokens"), F.sum("errorRate").alias("errors"), F.count("contextSnr").alias("with_snr"))


@query(
    "SELECT CAST(l_suppkey AS VARCHAR) AS agent_id, count(*) FILTER (l_discount > 0) AS n, round(avg(l_quantity / (l_discount * 100)) FILTER (l_discount > 0), 6) AS mean, round(max(l_quantity / (l_discount * 100)) FILTER (l_discount > 0), 6) AS high FROM lineitem GROUP BY 1"
)
def context_snr(spark, sf):
    rows = S.table(spark, sf, "lineitem")
    t = S.as_turns(rows, agent_id=F.col("l_suppkey").cast("string"), output_tokens=F.col("l_quantity"), context_tokens=F.col("l_discount") * 100)
    w = X.wide(t.withColumn("seq", F.lit(0).cast("long")))
    return w.groupBy("agent_id").agg(F.count("contextSnr").alias("n"), r6(F.avg("contextSnr")).alias("mean"), r6(F.max("contextSnr")).alias("high"))


@query(
    f"WITH t AS ({TYPED}) SELECT agent_id, seq, 'latencyMs' AS feature, 0 AS feature_ord, value FROM t UNION ALL SELECT agent_id, seq, 'retrievalChunks', 7, k FROM t WHERE k IS NOT NULL "
    "UNION ALL SELECT agent_id, seq, 'errorRate', 11, 0.0::DOUBLE FROM t"
)
def feature_long(spark, sf):
    return X.long(X.wide(by_type(spark, sf))).select("agent_id", "seq", "feature", "feature_ord", "value")


@query(
    "WITH c AS (SELECT o_orderpriority AS agent_id, l_returnflag AS tool, l_linestatus = 'F' AS ok FROM orders JOIN lineitem ON o_orderkey = l_orderkey) "
    "SELECT agent_id, tool, ok, count(*) AS n FROM c GROUP BY ALL"
)
def tool_explode(spark, sf):
    return X.tool_samples(by_priority(spark, sf)).groupBy("agent_id", "tool", "ok").agg(F.count("*").alias("n"))


@query(
    "WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus <> 'F') AS bad FROM lineitem GROUP BY 1) SELECT o_orderpriority AS agent_id, count(*) AS turns, "
    "CAST(sum(coalesce(n, 0)) AS DOUBLE) AS calls, round(avg(bad::DOUBLE / n), 6) AS failure_rate, count(*) FILTER (n IS NULL) AS without FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1"
)
def tool_features(spark, sf):
    w = X.wide(by_priority(spark, sf))
    return w.groupBy("agent_id").agg(F.count("*").alias("turns"), F.sum("toolCallCount").alias("calls"), r6(F.avg("toolFailureRate")).alias("failure_rate"), F.count(F.when(F.col("toolCallCount") == 0, 1)).alias("without"))


@query(
    "WITH e AS (SELECT *, event_id % 5 AS s FROM events) SELECT CASE s WHEN 0 THEN 'agent-' || (user_id % 7) WHEN 1 THEN event_type WHEN 2 THEN 'tool:search' WHEN 4 THEN 'agent-' || (user_id % 7) END AS agent_id, event_id AS tie, "
    "CASE s WHEN 0 THEN CAST(trunc(value * 1000) AS BIGINT) / 1000.0::DOUBLE WHEN 1 THEN value WHEN 2 THEN CAST(trunc(value * 1000) AS BIGINT) / 1000.0::DOUBLE ELSE 250.0::DOUBLE END AS raw_latency, "
    "CASE s WHEN 0 THEN (event_id % 1000)::DOUBLE WHEN 1 THEN value END AS input_tokens, CASE s WHEN 0 THEN user_id::DOUBLE WHEN 4 THEN 5.0::DOUBLE END AS output_tokens, "
    "CASE s WHEN 0 THEN event_type END AS finish_reason, CASE WHEN event_type = 'error' THEN true END AS error_flag, s = 2 AS is_tool, s NOT IN (0, 2) AS undated FROM e WHERE s <> 3"
)
def otel_turns(spark, sf):
    t = S.turns_from_spans(S.spans_from_events(S.table(spark, sf, "events")))
    return t.select("agent_id", "tie", F.round("latency_ms", 3).alias("raw_latency"), "input_tokens", "output_tokens", "finish_reason", "error_flag", F.col("tool_calls").isNotNull().alias("is_tool"), F.col("ts").isNull().alias("undated"))


@query(
    "WITH e AS (SELECT *, event_id % 5 AS s, CASE WHEN user_id % 4 > 0 THEN 'k' || (user_id % 4) END AS key_id FROM events WHERE event_id % 5 < 4) "
    "SELECT CASE WHEN key_id IS NOT NULL AND s <> 3 THEN 'keymesh:' || key_id ELSE 'keymesh:pool' END AS agent_id, event_id AS tie, CASE WHEN s < 2 THEN value END AS latency_ms, "
    "CASE WHEN s > 0 THEN true END AS error_flag, CASE s WHEN 2 THEN 'circuit.open' WHEN 3 THEN 'all.exhausted' END AS finish_reason, CASE WHEN s < 2 AND key_id IS NOT NULL THEN 'key:' || key_id END AS tool FROM e"
)
def key_event_turns(spark, sf):
    t = S.turns_from_key_events(S.key_events(S.table(spark, sf, "events")))
    return t.select("agent_id", "tie", "latency_ms", "error_flag", "finish_reason", F.try_element_at(F.transform("tool_calls", lambda c: c["name"]), F.lit(1)).alias("tool"))


@query(
    "WITH e AS (SELECT *, event_id % 4 AS s, CASE WHEN user_id % 3 > 0 THEN 'm' || (user_id % 3) END AS model FROM events WHERE event_id % 4 < 3) "
    "SELECT CASE WHEN model IS NOT NULL THEN 'modelchain:' || model ELSE 'modelchain:router' END AS agent_id, event_id AS tie, CASE WHEN s <> 1 THEN value END AS latency_ms, CASE WHEN s <> 1 THEN value / 1000 END AS cost_usd, "
    "CASE WHEN s <> 1 THEN user_id * 10.0::DOUBLE END AS input_tokens, CASE WHEN s = 1 THEN true END AS error_flag, CASE WHEN s <> 1 THEN 'stop' END AS finish_reason FROM e"
)
def model_event_turns(spark, sf):
    return S.turns_from_model_events(S.model_events(S.table(spark, sf, "events"))).select("agent_id", "tie", "latency_ms", "cost_usd", "input_tokens", "error_flag", "finish_reason")


@query(
    "SELECT CAST(user_id AS VARCHAR) AS agent_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, min(value) AS low, max(value) AS high FROM events GROUP BY user_id"
)
def welford_baseline(spark, sf):
    rows = S.events_by_user(S.table(spark, sf, "events"))
    return rows.groupBy("agent_id").agg(*native.moments("latency_ms")).select("agent_id", "n", r6("mean").alias("mean"), r6("std_dev").alias("std_dev"), "low", "high")


@query(
    f"WITH t AS ({USERS}) SELECT agent_id, seq, round(avg(value) OVER w + 1e-8, 6) AS mean, round(stddev_pop(value) OVER w, 4) AS std_dev, min(value) OVER w AS low, max(value) OVER w AS high FROM t "
    "WINDOW w AS (PARTITION BY agent_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
)
def welford_running(spark, sf):
    w = Window.partitionBy("agent_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n, mean, std, low, high = (c.over(w) for c in (F.count("latency_ms"), F.avg("latency_ms"), F.stddev_pop("latency_ms"), F.min("latency_ms"), F.max("latency_ms")))
    return by_user(spark, sf).select("agent_id", "seq", r6(mean + 1e-8).alias("mean"), F.round(std, 4).alias("std_dev"), low.alias("low"), high.alias("high"))


@query(
    "WITH v AS (SELECT CAST(user_id AS VARCHAR) AS agent_id, list(value ORDER BY ts, event_id) AS xs FROM events GROUP BY user_id), f AS (SELECT agent_id, "
    "list_reduce(xs, lambda a, x: {'n': a.n + 1, 'mean': CASE WHEN a.n = 0 THEN x.mean ELSE a.mean + (x.mean - a.mean) * 0.05::DOUBLE END, "
    "'variance': CASE WHEN a.n = 0 THEN 0.0::DOUBLE ELSE (a.variance + (x.mean - a.mean) * ((x.mean - a.mean) * 0.05::DOUBLE)) * 0.95::DOUBLE END}, {'n': 0, 'mean': 0.0::DOUBLE, 'variance': 0.0::DOUBLE}) AS e "
    "FROM (SELECT agent_id, list_transform(xs, lambda x: {'n': 0, 'mean': x, 'variance': 0.0::DOUBLE}) AS xs FROM v)) SELECT agent_id, CAST(e.n AS BIGINT) AS n, round(e.mean, 6) AS mean, round(sqrt(e.variance), 6) AS std_dev FROM f"
)
def ewma_final(spark, sf):
    rows = native.ewma_running(by_user(spark, sf), ["agent_id"], ["seq"], "latency_ms", 0.05)
    last = rows.groupBy("agent_id").agg(F.count("*").alias("n"), F.max_by(F.struct("mean", "std_dev"), "seq").alias("e"))
    return last.select("agent_id", "n", r6("e.mean").alias("mean"), r6("e.std_dev").alias("std_dev"))


@query(
    f"WITH RECURSIVE t AS ({USERS}), r AS (SELECT agent_id, seq, value AS mean, 0.0::DOUBLE AS variance FROM t WHERE seq = 1 UNION ALL "
    "SELECT t.agent_id, t.seq, r.mean + (t.value - r.mean) * 0.05::DOUBLE, (r.variance + (t.value - r.mean) * ((t.value - r.mean) * 0.05::DOUBLE)) * 0.95::DOUBLE "
    "FROM r JOIN t ON t.agent_id = r.agent_id AND t.seq = r.seq + 1) SELECT agent_id, seq, round(mean + 1e-8, 6) AS mean, round(sqrt(variance) + 1e-8, 6) AS std_dev FROM r"
)
def ewma_running(spark, sf):
    out = native.ewma_running(by_user(spark, sf), ["agent_id"], ["seq"], "latency_ms", 0.05)
    # ties at the last digit that is kept would fall either way
    return out.select("agent_id", "seq", r6(F.col("mean") + 1e-8).alias("mean"), r6(F.col("std_dev") + 1e-8).alias("std_dev"))


@query("SELECT event_type AS agent_id, count(*) AS n, quantile_cont(value, 0.5) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def exact_quantiles(spark, sf):
    rows = S.table(spark, sf, "events").groupBy(F.col("event_type").alias("agent_id"))
    return rows.agg(F.count("*").alias("n"), F.percentile("value", 0.5).alias("p50"), r6(F.percentile("value", 0.95)).alias("p95"), r6(F.percentile("value", 0.99)).alias("p99"))


@query()
def p2_quantiles(spark, sf):
    return native.p2_quantiles(S.events_by_type(S.table(spark, sf, "events")), "agent_id", ["ts", "tie"], "latency_ms")


@query(f"WITH t AS ({USERS}) SELECT agent_id, seq, len(xs) AS n, xs[1] AS oldest, xs[len(xs)] AS newest, round(list_sum(xs), 6) AS total FROM (SELECT agent_id, seq, list(value) OVER (PARTITION BY agent_id ORDER BY seq ROWS 9 PRECEDING) AS xs FROM t)")
def ring_window(spark, sf):
    ring = F.collect_list("latency_ms").over(Window.partitionBy("agent_id").orderBy("seq").rowsBetween(-9, 0))
    rows = by_user(spark, sf).select("agent_id", "seq", ring.alias("xs"))
    return rows.select("agent_id", "seq", F.size("xs").cast("long").alias("n"), F.element_at("xs", 1).alias("oldest"), F.element_at("xs", -1).alias("newest"), r6(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    f"WITH RECURSIVE v AS ({TYPED}), t AS (SELECT agent_id, seq, event_id AS tie, (value - avg(value) OVER p) / greatest(stddev_pop(value) OVER p, 1e-9) AS z FROM v WINDOW p AS (PARTITION BY agent_id)), "
    "r AS (SELECT DISTINCT agent_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS tie, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS up, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS dn, 0.0::DOUBLE AS hi, NULL::VARCHAR AS shift FROM t UNION ALL "
    "SELECT agent_id, seq, tie, mean, CASE WHEN fired IS NULL THEN up ELSE 0 END, CASE WHEN fired IS NULL THEN lo ELSE 0 END, CASE WHEN fired IS NULL THEN dn ELSE 0 END, CASE WHEN fired IS NULL THEN hi ELSE 0 END, fired FROM ("
    "SELECT agent_id, seq, tie, mean, up, least(lo, up) AS lo, dn, greatest(hi, dn) AS hi, CASE WHEN up - least(lo, up) > 10 THEN 'up' WHEN greatest(hi, dn) - dn > 10 THEN 'down' END AS fired FROM ("
    "SELECT agent_id, seq, tie, mean, lo, hi, 0.999::DOUBLE * up + (z - mean - 0.02::DOUBLE) AS up, 0.999::DOUBLE * dn + (z - mean + 0.02::DOUBLE) AS dn FROM ("
    "SELECT t.agent_id, t.seq, t.tie, t.z, r.up, r.lo, r.dn, r.hi, r.mean + (t.z - r.mean) / t.seq AS mean FROM r JOIN t ON t.agent_id = r.agent_id AND t.seq = r.seq + 1) a) b) c) "
    "SELECT agent_id, tie, shift FROM r WHERE shift IS NOT NULL"
)
def page_hinkley_fires(spark, sf):
    return native.shift_fires(S.events_by_type(S.table(spark, sf, "events")), "agent_id", ["ts", "tie"], "latency_ms", 0.02, 10.0).drop("ts")


@query(f"WITH t AS ({USERS}) SELECT agent_id, event_type AS category, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY agent_id), 6) AS share FROM t WHERE seq <= 20 GROUP BY 1, 2")
def categorical_baseline(spark, sf):
    n = by_user(spark, sf).filter("seq <= 20").groupBy("agent_id", F.col("finish_reason").alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("agent_id"))))


MIXES = (
    f"WITH t AS ({USERS}), p AS (SELECT agent_id, event_type AS c, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY agent_id) AS p FROM t WHERE seq <= 20 GROUP BY 1, 2), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY seq DESC) AS back FROM t), q AS (SELECT agent_id, event_type AS c, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY agent_id) AS q FROM l WHERE back <= 10 GROUP BY 1, 2), "
    "b AS (SELECT agent_id, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL JOIN q USING (agent_id, c)), "
    "d AS (SELECT agent_id, least(1, greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2))) AS jsd, count(*) AS k FROM b GROUP BY 1) "
)


def mixes(spark, sf):
    t = by_user(spark, sf)
    back = F.row_number().over(Window.partitionBy("agent_id").orderBy(F.desc("seq")))
    share = lambda rows, name: rows.groupBy("agent_id", "finish_reason").agg(F.count("*").alias("n")).select("agent_id", "finish_reason", (F.col("n") / F.sum("n").over(Window.partitionBy("agent_id"))).alias(name))
    p, q = share(t.filter("seq <= 20"), "p"), share(t.withColumn("back", back).filter("back <= 10"), "q")
    return p.join(q, ["agent_id", "finish_reason"], "full").groupBy("agent_id").agg(native.divergence().alias("jsd"), F.count("*").alias("k"))


@query(MIXES + "SELECT agent_id, round(jsd, 6) AS jsd FROM d")
def jsd(spark, sf):
    return mixes(spark, sf).select("agent_id", r6("jsd").alias("jsd"))


@query(MIXES + "SELECT agent_id, round(greatest(0, jsd - (k - 1) / (4 * 10 * ln(2))), 6) AS jsd FROM d")
def jsd_corrected(spark, sf):
    return mixes(spark, sf).select("agent_id", r6(F.greatest(F.lit(0.0), F.col("jsd") - (F.col("k") - 1) / (F.lit(40.0) * F.log(F.lit(2.0))))).alias("jsd"))


COUNTS = "WITH c AS (SELECT CAST(user_id AS VARCHAR) AS agent_id, CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS k, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY user_id) "
TAILSQL = "list_sum(list_transform(range(greatest(k, 1), n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1::DOUBLE) + (n - i) * ln(0.9::DOUBLE))))"


def error_counts(spark, sf):
    return S.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("agent_id")).agg(F.count(F.when(F.col("event_type") == "error", 1)).cast("int").alias("k"), F.count("*").cast("int").alias("n"))


@query(COUNTS + f"SELECT agent_id, k, n, round(CASE WHEN k <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {TAILSQL}) END, 6) AS tail FROM c")
def binomial_tail(spark, sf):
    return error_counts(spark, sf).select("agent_id", "k", "n", r6(native.binomial_tail(F.col("k"), F.col("n"), F.lit(0.1))).alias("tail"))


@query("WITH p AS (SELECT event_id, (event_id % 9999 + 1) / 10001.0::DOUBLE AS p FROM events) SELECT event_id, round(" + E.inverse_normal("p") + ", 6) AS z FROM p")
def inv_norm(spark, sf):
    p = (F.col("event_id") % 9999 + 1) / F.lit(10001.0)
    return S.table(spark, sf, "events").select("event_id", r6(native.inverse_normal(p)).alias("z"))


@query(COUNTS + f", t AS (SELECT *, CASE WHEN k <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {TAILSQL}) END AS tail FROM c) SELECT agent_id, round(CASE WHEN k <= n * 0.1::DOUBLE OR tail >= 0.5 THEN 0 ELSE greatest(0, -({E.inverse_normal('tail')})) END, 6) AS z FROM t")
def rate_z(spark, sf):
    return error_counts(spark, sf).select("agent_id", r6(native.rate_z(F.col("k").cast("double"), F.col("n"), F.lit(0.1))).alias("z"))


TREND = (
    f"WITH t AS ({USERS}), w AS (SELECT agent_id, seq, count(*) OVER f AS n, regr_slope(value, seq) OVER f AS slope, regr_intercept(value, seq) OVER f AS base, (epoch_ms(max(ts) OVER f) - epoch_ms(min(ts) OVER f))::DOUBLE AS span "
    "FROM t WINDOW f AS (PARTITION BY agent_id ORDER BY seq ROWS 9 PRECEDING)) "
)


@query(TREND + "SELECT agent_id, seq, round(slope, 6) AS slope, round(base + slope * (seq + 1), 4) AS next_value, round(slope * (n - 1) * 3600000 / span, 4) AS slope_hour FROM w WHERE n >= 3")
def trend_fit(spark, sf):
    rows = by_user(spark, sf).withColumn("ms", F.unix_millis("ts"))
    out = native.line(rows.select("agent_id", "seq", "latency_ms", "ms"), ["agent_id"], ["seq"], "latency_ms", "ms", 10)
    return out.select("agent_id", "seq", r6("slope").alias("slope"), F.round("next_value", 4).alias("next_value"), F.round("slope_hour", 4).alias("slope_hour"))


@query(
    TREND + ", v AS (SELECT agent_id, seq, value FROM t), x AS (SELECT w.agent_id, w.seq, CASE WHEN slope <> 0 AND (500 - value) / slope > 0 THEN (500 - value) / slope END AS steps FROM w JOIN v ON w.agent_id = v.agent_id AND w.seq = v.seq WHERE n >= 3) "
    "SELECT agent_id, seq, CAST(floor(log10(steps)) AS INTEGER) AS power, CAST(floor(steps / pow(10.0::DOUBLE, floor(log10(steps))) * 1e6 + 0.5) AS BIGINT) AS digits FROM x"
)
def steps_to_threshold(spark, sf):
    """Steps to 500, none if the trend leads away from it, as seven digits and a power of ten: slopes may be near zero."""
    rows = by_user(spark, sf).withColumn("ms", F.unix_millis("ts"))
    out = native.line(rows.select("agent_id", "seq", "latency_ms", "ms"), ["agent_id"], ["seq"], "latency_ms", "ms", 10)
    steps = F.try_divide(F.lit(500.0) - F.col("latency_ms"), F.col("slope"))
    out = out.select("agent_id", "seq", F.when(steps > 0, steps).alias("steps"))
    power = F.floor(F.log10("steps"))
    return out.select("agent_id", "seq", power.cast("int").alias("power"), F.floor(F.col("steps") / F.pow(F.lit(10.0), power) * 1e6 + 0.5).cast("long").alias("digits"))


@query(f"WITH t AS ({USERS}) SELECT agent_id, seq, CASE WHEN seq <= 20 THEN 'learning' ELSE 'ready' END AS status FROM t")
def warmup_status(spark, sf):
    return by_user(spark, sf).select("agent_id", "seq", F.when(F.col("seq") <= USER.warmup, "learning").otherwise("ready").alias("status"))


UNGATED = (
    f"WITH RECURSIVE t AS ({TYPED}), r AS (SELECT agent_id, seq, value, value AS mean, 0.0::DOUBLE AS variance, NULL::DOUBLE AS z FROM t WHERE seq = 1 UNION ALL "
    "SELECT t.agent_id, t.seq, t.value, r.mean + (t.value - r.mean) * 0.05::DOUBLE, (r.variance + (t.value - r.mean) * ((t.value - r.mean) * 0.05::DOUBLE)) * 0.95::DOUBLE, "
    "CASE WHEN t.seq > 50 THEN least(50, greatest(-50, (t.value - r.mean) / greatest(sqrt(r.variance), 1e-9))) END FROM r JOIN t ON t.agent_id = r.agent_id AND t.seq = r.seq + 1) "
)


def ungated(spark, sf):
    from ..functions.tracks import Ewma
    from ..operators.keyed import fold_by_key

    def make(_):
        e = Ewma(0.05)

        def step(row):
            z = min(50.0, max(-50.0, (row["latency_ms"] - e.mean) / max(e.std, 1e-9))) if row["seq"] > TYPE.warmup else None
            e.push(row["latency_ms"])
            yield {"agent_id": row["agent_id"], "seq": row["seq"], "z": z, "mean": e.mean}

        return step

    return fold_by_key(by_type(spark, sf).select("agent_id", "seq", "latency_ms"), ["agent_id"], ["seq"], make, "agent_id string, seq long, z double, mean double")


@query(UNGATED + "SELECT agent_id, seq, round(mean, 6) AS mean, round(z, 6) AS z FROM r")
def z_ungated(spark, sf):
    return ungated(spark, sf).select("agent_id", "seq", r6("mean").alias("mean"), r6("z").alias("z"))


@query(UNGATED + ", o AS (SELECT *, abs(z) >= 2.5 AS bad FROM r WHERE seq > 50) SELECT agent_id, seq, round(z, 6) AS z FROM (SELECT *, lag(bad) OVER (PARTITION BY agent_id ORDER BY seq) AS before FROM o) WHERE bad AND before")
def confirm_streak(spark, sf):
    out = ungated(spark, sf).filter(F.col("seq") > TYPE.warmup).withColumn("bad", F.abs("z") >= 2.5)
    before = F.lag("bad").over(Window.partitionBy("agent_id").orderBy("seq"))
    return out.withColumn("before", before).filter("bad and before").select("agent_id", "seq", r6("z").alias("z"))


TYPES = E.evaluated(TYPED, [("latencyMs", 0, "value"), ("retrievalChunks", 7, "k")], [("errorRate", 11, "0.0")], [], TYPE)
MIXED = E.evaluated(USERS, [("latencyMs", 0, "value")], [("errorRate", 11, "CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END")], [("finishReason", 13, "event_type")], USER)
RAMPED = E.evaluated(
    "SELECT event_type AS agent_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, ts, 500.0::DOUBLE + value + 0.4::DOUBLE * (event_id % 2000) AS x FROM events",
    [("latencyMs", 0, "x")], [("errorRate", 11, "0.0")], [], RAMP,
) + E.reported(RAMP)
ALERTED = RAMPED + E.alerted(RAMP.alerts)
SEVERITY = E.NAMED


@query(TYPES + f" SELECT agent_id, seq, round(z, 6) AS z, CASE WHEN finding > 0 THEN {SEVERITY.format('finding')} END AS finding, {SEVERITY.format('sev')} AS severity, sev > 0 AS frozen, fired AS shift FROM ev WHERE feature = 'latencyMs'")
def numeric_drift(spark, sf):
    return judged(by_type(spark, sf), TYPE, "latencyMs").select("agent_id", "seq", r6("z").alias("z"), "finding", "severity", "frozen", "shift")


@query(MIXED + f" SELECT agent_id, seq, round(z, 6) AS z, CASE WHEN finding > 0 THEN {SEVERITY.format('finding')} END AS finding, {SEVERITY.format('sev')} AS severity, round(observed, 6) AS observed, round(expected, 6) AS expected FROM ev WHERE feature = 'errorRate'")
def rate_drift(spark, sf):
    return judged(by_user(spark, sf), USER, "errorRate").select("agent_id", "seq", r6("z").alias("z"), "finding", "severity", r6("observed").alias("observed"), r6("expected").alias("expected"))


@query(MIXED + f" SELECT agent_id, seq, round(z, 6) AS z, CASE WHEN finding > 0 THEN {SEVERITY.format('finding')} END AS finding, {SEVERITY.format('sev')} AS severity, summary FROM ev WHERE feature = 'finishReason'")
def categorical_drift(spark, sf):
    return judged(by_user(spark, sf), USER, "finishReason").select("agent_id", "seq", r6("z").alias("z"), "finding", "severity", "summary")


@query(MIXED + " SELECT agent_id, seq, feature, round(deviation, 6) AS deviation FROM ev")
def deviations(spark, sf):
    return judged(by_user(spark, sf), USER).select("agent_id", "seq", "feature", r6("deviation").alias("deviation"))


@query(MIXED + f" SELECT agent_id, seq, feature, {SEVERITY.format('moved')} AS severity FROM ev WHERE moved IS NOT NULL")
def transitions(spark, sf):
    return D.transitions(judged(by_user(spark, sf), USER))


@query(MIXED + E.reported(USER) + " SELECT agent_id, seq, round(instant, 6) AS instant, behavior_score FROM rep")
def behavior_score(spark, sf):
    return R.scores(seen(by_user(spark, sf), USER, False)).select("agent_id", "seq", r6("instant").alias("instant"), "behavior_score")


@query(MIXED + E.reported(USER) + " SELECT agent_id, seq, CAST(rank AS INTEGER) AS rank, feature, round(contribution, 4) AS contribution, round(score, 6) AS score, direction, round(observed, 6) AS observed, round(expected, 6) AS expected, summary FROM shares")
def attributions(spark, sf):
    out = R.attributions(seen(by_user(spark, sf), USER, False))
    return out.select("agent_id", "seq", "rank", "feature", F.round("contribution", 4).alias("contribution"), r6("score").alias("score"), "direction", r6("observed").alias("observed"), r6("expected").alias("expected"), "summary")


@query(RAMPED + " SELECT agent_id, seq, feature, round(slope, 6) AS slope, round(hourly, 4) AS hourly, steps, round(hours, 2) AS hours, summary FROM ahead")
def forecasts(spark, sf):
    return R.forecasts(ramp(spark, sf)).select("agent_id", "seq", "feature", r6("slope").alias("slope"), F.round("hourly", 4).alias("hourly"), "steps", F.round("hours", 2).alias("hours"), "summary")


@query(RAMPED + " SELECT agent_id, seq, feature FROM (SELECT *, lag(seq) OVER (PARTITION BY agent_id, feature ORDER BY seq) AS before FROM ahead) WHERE before IS NULL OR before < seq - 1")
def fresh_forecasts(spark, sf):
    return R.fresh_forecasts(R.forecasts(ramp(spark, sf))).select("agent_id", "seq", "feature")


@query(MIXED + E.reported(USER) + " SELECT agent_id, seq, status, severity, behavior_score, CAST(n_findings AS INTEGER) AS n_findings FROM rep")
def report_severity(spark, sf):
    return R.reports(seen(by_user(spark, sf), USER, False)).select("agent_id", "seq", "status", "severity", "behavior_score", F.size("findings").alias("n_findings"))


@query(MIXED + E.reported(USER) + " SELECT agent_id, seq, behavior_score FROM rep WHERE top = 0 AND top_before > 0")
def engine_recovery(spark, sf):
    return R.recoveries(R.reports(seen(by_user(spark, sf), USER, False))).drop("ts")


@query(MIXED + E.reported(USER) + " SELECT agent_id, max(seq) AS seq, max_by(severity, seq) AS severity, max_by(behavior_score, seq) AS behavior_score FROM rep GROUP BY 1")
def latest_reports(spark, sf):
    return R.latest(R.reports(seen(by_user(spark, sf), USER, False))).select("agent_id", "seq", "severity", "behavior_score")


@query(ALERTED + " SELECT alert_id, agent_id, kind, named AS severity, title, message, lead AS top_feature, behavior_score FROM gov")
def alerts(spark, sf):
    return A.governed(ramp(spark, sf)).select("alert_id", "agent_id", "kind", "severity", "title", "message", "top_feature", "behavior_score")


@query(ALERTED + " SELECT alert_id, agent_id, kind, named AS severity, allowed, reason FROM gov")
def governor_decisions(spark, sf):
    return A.governed(ramp(spark, sf)).select("alert_id", "agent_id", "kind", "severity", "allowed", "reason")


@query(ALERTED + E.LOG)
def telemetry_log(spark, sf):
    return A.telemetry(ramp(spark, sf)).drop("ts")


@query(ALERTED + " SELECT alert_id, channel, named AS severity FROM gov, (VALUES ('slack'), ('email')) AS c(channel) WHERE allowed")
def deliveries(spark, sf):
    return A.deliveries(A.governed(ramp(spark, sf)), ["slack", "email"]).select("alert_id", "channel", "severity")


@query("SELECT event_type AS agent_id, count(*) AS observations, epoch_us(min(ts)) // 1000 AS first_seen, epoch_us(max(ts)) // 1000 AS last_seen, CASE WHEN count(*) >= 50 THEN 'ready' ELSE 'learning' END AS status FROM events GROUP BY 1")
def agents(spark, sf):
    t = by_type(spark, sf)
    n = F.count("*")
    return t.groupBy("agent_id").agg(n.alias("observations"), F.unix_millis(F.min("ts")).alias("first_seen"), F.unix_millis(F.max("ts")).alias("last_seen"), F.when(n >= TYPE.warmup, "ready").otherwise("learning").alias("status"))


LAST = "(SELECT *, row_number() OVER (PARTITION BY agent_id, feature ORDER BY k DESC) AS back FROM {})"


@query(
    MIXED + f" SELECT agent_id, feature, CAST(n AS BIGINT) AS count, round(wm, 6) AS mean, round(CASE WHEN n > 1 THEN sqrt(m2 / n) ELSE 0 END, 6) AS std_dev, round(em, 6) AS ewma_mean, round(sqrt(ev), 6) AS ewma_std_dev, sev > 0 AS frozen FROM {LAST.format('judged')} WHERE back = 1 "
    f"UNION ALL SELECT agent_id, feature, CAST(list_sum(counts) AS BIGINT), NULL, NULL, NULL, NULL, sev > 0 FROM {LAST.format('mixing')} WHERE back = 1"
)
def fingerprint_snapshot(spark, sf):
    return D.snapshot(X.long(X.wide(by_user(spark, sf))), USER).select("agent_id", "feature", "count", r6("mean").alias("mean"), r6("std_dev").alias("std_dev"), r6("ewma_mean").alias("ewma_mean"), r6("ewma_std_dev").alias("ewma_std_dev"), "frozen")


@query()
def snapshot_quantiles(spark, sf):
    return D.snapshot(X.long(X.wide(by_user(spark, sf))), USER).select("agent_id", "feature", r6("p50").alias("p50"), r6("p95").alias("p95"), r6("p99").alias("p99"), r6("divergence").alias("divergence"))


@query(
    f"WITH t AS ({USERS}), l AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY seq DESC) AS back FROM t) "
    "SELECT agent_id, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, min(value) AS low, max(value) AS high FROM l WHERE back <= 10 GROUP BY 1"
)
def absorb_rebuild(spark, sf):
    out = D.snapshot(X.long(X.wide(by_user(spark, sf))), USER, absorb=True).filter("feature = 'latencyMs'")
    return out.select("agent_id", "count", r6("mean").alias("mean"), r6("std_dev").alias("std_dev"), F.col("min").alias("low"), F.col("max").alias("high"))


@query(
    "WITH f AS (SELECT user_id, min({'ts': ts, 'id': event_id}) AS f FROM events GROUP BY 1), k AS (SELECT user_id, row_number() OVER (ORDER BY f, CAST(user_id AS VARCHAR)) <= 10 AS ok FROM f) "
    "SELECT CAST(user_id AS VARCHAR) AS agent_id, ok AS admitted, count(*) AS turns FROM events JOIN k USING (user_id) GROUP BY ALL"
)
def max_agents_guard(spark, sf):
    return X.admitted(S.events_by_user(S.table(spark, sf, "events")), 10).groupBy("agent_id", "admitted").agg(F.count("*").alias("turns"))


def plain_alerts(spark, sf):
    """Alerts made of error events, for what renders them."""
    why = F.array(F.struct(F.lit("latencyMs").alias("feature"), F.concat(F.lit("latencyMs is "), F.col("value").cast("decimal(10,2)").cast("string")).alias("summary")))
    e = S.table(spark, sf, "events").filter("event_type = 'error'")
    severity = F.when(F.col("event_id") % 3 == 0, "critical").when(F.col("event_id") % 3 == 1, "warning").otherwise("info")
    return e.select(F.concat(F.lit("a-"), "event_id").alias("alert_id"), F.col("user_id").cast("string").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit("drift").alias("kind"), severity.alias("severity"), F.concat(F.lit("Behavioral drift detected: "), "user_id").alias("title"), F.repeat(F.concat(F.lit("value "), F.col("event_id"), F.lit(" ")), 20).alias("message"), (F.col("event_id") % 100).cast("int").alias("behavior_score"), why.alias("attributions"), F.lit("latencyMs").alias("top_feature"))


RENDERED = (
    "WITH a AS (SELECT 'a-' || event_id AS alert_id, CAST(user_id AS VARCHAR) AS agent_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, "
    "CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, 'Behavioral drift detected: ' || user_id AS title, repeat('value ' || event_id || ' ', 20) AS message, event_id % 100 AS score, "
    "'latencyMs is ' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) AS why FROM events WHERE event_type = 'error') "
)


@query(RENDERED + "SELECT alert_id, title || chr(10) || 'Agent: ' || agent_id || chr(10) || 'Severity: ' || severity || chr(10) || 'Kind: drift' || chr(10) || 'Behavior score: ' || score || '/100' || chr(10) || iso || chr(10) || chr(10) || message || chr(10) || '- ' || why AS body FROM a")
def alert_text(spark, sf):
    return plain_alerts(spark, sf).select("alert_id", P.text().alias("body"))


@query(RENDERED + ", c AS (SELECT alert_id, '[' || upper(severity) || '] ' || title || ': ' || message AS s FROM a) SELECT alert_id, CASE WHEN length(s) <= 240 THEN s ELSE substr(s, 1, 237) || '...' END AS body FROM c")
def alert_compact(spark, sf):
    return plain_alerts(spark, sf).select("alert_id", P.compact().alias("body"))


@query(RENDERED + "SELECT iso AS at, agent_id, severity, 'drift' AS kind, CAST(score AS INTEGER) AS behavior_score, 'latencyMs' AS top_feature, message FROM a")
def sheets_row(spark, sf):
    return plain_alerts(spark, sf).select(*P.sheet_row())


@query()
def channel_payloads(spark, sf):
    return P.payloads(plain_alerts(spark, sf))


@query()
def simulate(spark, sf):
    turns = X.sequenced(S.simulate(spark, [7, 42, 101], 200))
    return seen(turns, Config(warmup=30)).select("agent_id", "seq", "severity", "behavior_score")


LINES = "SELECT *, CAST(l_suppkey AS VARCHAR) AS agent_id, l_shipdate AS ts, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 1000 + l_linenumber) AS seq FROM lineitem"
SUPPLIED = E.evaluated(
    LINES, [("costUsd", 1, "l_extendedprice"), ("inputTokens", 2, "l_quantity"), ("totalTokens", 4, "l_quantity"), ("contextTokens", 5, "l_discount * 100")],
    [("errorRate", 11, "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END")], [("finishReason", 13, "l_returnflag")], TYPE,
)


@query(SUPPLIED + E.reported(TYPE) + " SELECT agent_id, count(*) AS turns, min(behavior_score) AS worst, max_by(behavior_score, seq) AS last FROM rep GROUP BY 1")
def supplier_drift(spark, sf):
    return R.scores(seen(by_supplier(spark, sf), TYPE, False)).groupBy("agent_id").agg(F.count("*").alias("turns"), F.min("behavior_score").alias("worst"), F.max_by("behavior_score", "seq").alias("last"))


@query(
    "WITH t AS (SELECT role AS agent_id, row_number() OVER (PARTITION BY role ORDER BY conv_id * 100000 + turn) AS seq, length(text)::DOUBLE AS n, turn::DOUBLE AS turn FROM conversations WHERE role <> '') "
    "SELECT agent_id, seq, 'outputTokens' AS feature, n AS value FROM t WHERE n IS NOT NULL UNION ALL SELECT agent_id, seq, 'totalTokens', n FROM t WHERE n IS NOT NULL "
    "UNION ALL SELECT agent_id, seq, 'turnIndex', turn FROM t WHERE turn IS NOT NULL UNION ALL SELECT agent_id, seq, 'errorRate', 0.0::DOUBLE FROM t"
)
def conversation_turns(spark, sf):
    return X.long(X.wide(X.sequenced(S.conversations_as_turns(S.table(spark, sf, "conversations"))))).select("agent_id", "seq", "feature", "value")


SAID = "(SELECT agent_id, seq, string_agg(summary, ' | ' ORDER BY ord) AS findings FROM ev WHERE finding > 0 GROUP BY 1, 2)"


def flagship(spark, sf):
    """The report of every turn of the events of each type."""
    r = R.reports(seen(by_type(spark, sf), TYPE, False))
    return r.select("agent_id", "seq", "status", "severity", "behavior_score", F.array_join(F.transform("findings", lambda f: f["summary"]), " | ").alias("findings"))


@query(TYPES + f" SELECT agent_id, seq, feature, {SEVERITY.format('finding')} AS severity, direction, round(z, 6) AS score, summary FROM ev WHERE finding > 0")
def drift_findings(spark, sf):
    return D.findings(judged(by_type(spark, sf), TYPE)).select("agent_id", "seq", "feature", "severity", "direction", r6("score").alias("score"), "summary")


QUERIES["drift_reports"] = flagship
ORACLES["drift_reports"] = TYPES + E.reported(TYPE) + f" SELECT agent_id, seq, status, severity, behavior_score, coalesce(findings, '') AS findings FROM rep LEFT JOIN {SAID} USING (agent_id, seq)"
