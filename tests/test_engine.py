import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import native
from tidemark.functions import tracks as T
from tidemark.functions.agents import Agent, Desk
from tidemark.functions.tracks import P2
from tidemark.operators import detect, features, report
from tidemark.plans import queries as Q
from tidemark.plans.config import CATEGORICAL, NUMERIC, AlertPolicy, Config
from tidemark.sources import turns as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, con, name):
    df, want = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, x if isinstance(x, (str, int)) else 0) for x in r)
    a = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert all(all(map(same, x, y)) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).collect()


def test_reports_equal_a_replay_in_order(spark):
    cfg = Config(warmup=20, window=10)
    t = features.wide(features.sequenced(S.events_by_user(S.table(spark, SF, "events"))))
    got = {(r.agent_id, r.seq): r for r in report.observed(t, cfg).collect()}
    agents: dict = {}
    for row in sorted(t.collect(), key=lambda r: (r.agent_id, r.seq)):
        agent, desk = agents.setdefault(row.agent_id, (Agent(cfg), Desk(row.agent_id, cfg.alerts)))
        ms = detect.millis(row.ts)
        r = agent.observe({f: row[f] for f in NUMERIC if row[f] is not None}, {f: row[f] for f in CATEGORICAL if row[f]}, ms)
        alerts, log = desk.take(r, ms)
        x = got.pop((row.agent_id, row.seq))
        assert (x.status, x.severity, x.behavior_score) == (r["status"], r["severity"], r["behavior_score"])
        for name in ("findings", "attributions", "forecasts"):
            assert [y.asDict() for y in x[name]] == [{k: v for k, v in y.items()} for y in r[name]]
        assert [y.asDict() for y in x.alerts] == alerts and [y.asDict() for y in x.events] == log
    assert not got


def test_p2_in_spark_is_that_of_a_replay(spark):
    rows = S.events_by_type(S.table(spark, SF, "events")).orderBy("ts", "tie").collect()
    for r in Q.QUERIES["p2_quantiles"](spark, SF).collect():
        marks = [P2(p) for p in (0.5, 0.95, 0.99)]
        for x in (x.latency_ms for x in rows if x.agent_id == r.agent_id):
            for m in marks:
                m.push(x)
        assert (r.n, r.p50, r.p95, r.p99) == (marks[0].n, *(m.value for m in marks))


def test_a_line_keeps_its_digits_on_long_histories(spark):
    values = [1e6 + 0.25 * i for i in range(200)]
    frame = spark.createDataFrame([("a", i, i * 60_000, v) for i, v in enumerate(values)], "k string, i long, ms long, v double")
    got = native.line(frame, ["k"], ["i"], "v", "ms", 20).filter("i >= 19").collect()
    assert all(abs(r.slope - 0.25) < 1e-9 and abs(r.next_value - (1e6 + 0.25 * (r.i + 1))) < 1e-6 and abs(r.slope_hour - 15) < 1e-6 for r in got)
    k, n = range(0, 41, 5), 40
    rows = spark.createDataFrame([(i, n) for i in k], "k int, n int").select("k", native.binomial_tail(F.col("k"), F.col("n"), F.lit(0.3)).alias("t")).collect()
    assert all(math.isclose(r.t, T.binomial_tail(r.k, n, 0.3), rel_tol=1e-9) for r in rows)


def test_steps_on_a_tie_of_the_last_digit_are_those_of_sql(spark, tmp_path):
    """The exact steps are 62372.625, so the seventh digit is a tie that only the same sums let fall the same way."""
    values = [18.9, 60.35, 86.13, 91.55, 68.17, 22.4, 95.16, 24.78]
    con, events = duckdb.connect(), tmp_path / "events.parquet"
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i) AS ts, u AS user_id, 'view' AS event_type, v AS value, '{}' AS props FROM (SELECT unnest(range(8)) AS i, unnest($1::DOUBLE[]) AS v), range(3) r(u)", [values])
    con.execute(f"COPY events TO '{events}' (FORMAT parquet)")
    got = Q.steps_to_threshold(spark, str(tmp_path)).select("agent_id", "seq", "power", "digits").collect()
    want = con.execute(f"SELECT agent_id, seq, power, digits FROM ({Q.ORACLES['steps_to_threshold']})").fetchall()
    assert ("0", 8, 4, 6237262) in want and sorted(map(tuple, got)) == sorted(want)


def test_steps_on_ties_of_ten_values_are_those_of_sql(spark, tmp_path):
    """regr_slope adds each product to its sum with one rounding; with two, the last digit of each of these fell the other way."""
    frames = [
        [12.1, 12.1, 49.5, 49.5, 49.5, 49.5, 49.5, 49.5, 49.5, 49.5],
        [15.82, 15.82, 15.82, 15.82, 15.82, 180.94, 180.94, 180.94, 180.94, 180.94],
        [103.63, 103.63, 103.63, 103.63, 103.63, 103.63, 103.63, 103.63, 142.63, 142.63],
        [6.68, 6.68, 28.68, 28.68, 28.68, 28.68, 28.68, 28.68, 28.68, 28.68],
    ]
    con, events = duckdb.connect(), tmp_path / "events.parquet"
    con.execute("CREATE TABLE events AS SELECT u * 100 + i AS event_id, TIMESTAMP '2024-01-01' + to_hours(i) AS ts, u AS user_id, 'view' AS event_type, v AS value, '{}' AS props FROM (SELECT u, unnest(range(10)) AS i, unnest(vs) AS v FROM (SELECT unnest(range(4)) AS u, unnest($1::DOUBLE[][]) AS vs))", [frames])
    con.execute(f"COPY events TO '{events}' (FORMAT parquet)")
    got = Q.steps_to_threshold(spark, str(tmp_path)).select("agent_id", "seq", "power", "digits").collect()
    want = con.execute(f"SELECT agent_id, seq, power, digits FROM ({Q.ORACLES['steps_to_threshold']})").fetchall()
    assert [(a, d) for a, s, _, d in sorted(want) if s == 10] == [("0", 1242188), ("1", 1275313), ("2", 9449687), ("3", 2209312)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_fold_over_a_join_has_each_key_whole(spark):
    """The join is planned with a shuffle and turned into a broadcast as it runs, as it is for large tables."""
    dice = random.Random(4)
    rows = [("ab"[i % 2], i, dice.expovariate(1.0)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k string, i long, v double")
    planned = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in planned}
    for name, value in planned.items():
        spark.conf.set(name, value)
    try:
        fires = {tuple(r) for r in native.shift_fires(frame, "k", ["i"], "v", 0.02, 10.0).collect()}
        ends = {r.k: (r.n, r.p50) for r in native.p2_quantiles(frame, "k", ["i"], "v").collect()}
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    want = set()
    for k in "ab":
        own = [(i, v) for key, i, v in rows if key == k]
        mean = math.fsum(v for _, v in own) / len(own)
        dev = math.sqrt(math.fsum((v - mean) ** 2 for _, v in own) / len(own))
        test, median = T.Shift(0.02, 10.0), P2(0.5)
        for i, v in own:
            median.push(v)
            if fired := test.push((v - mean) / dev):
                test.reset()
                want.add((k, i, fired))
        assert ends[k] == (len(own), median.value)
    assert want and fires == want


def test_feature_rules(spark):
    rows = spark.createDataFrame([("a", 1.0, float("nan"), 5.0, 0.0, None), ("a", None, None, None, None, "boom"), ("", 1.0, 1.0, 1.0, 1.0, None)], "agent string, latency double, i double, o double, c double, error string")
    t = S.as_turns(rows, agent_id=rows.agent, latency_ms=rows.latency, input_tokens=rows.i, output_tokens=rows.o, context_tokens=rows.c, error_class=rows.error)
    assert features.quarantined(t).count() == 1
    w = features.wide(features.sequenced(t)).orderBy("errorRate").collect()
    assert len(w) == 2 and w[0].totalTokens == 5 and w[0].contextSnr is None and w[0].inputTokens is None and w[0].toolCallCount is None
    assert w[1].errorRate == 1 and w[1].latencyMs is None


def test_simulated_run(spark):
    t = features.sequenced(S.simulate(spark, [7], 160))
    seen = report.observed(features.wide(t), Config(warmup=30)).cache()
    r = {x.seq: x for x in report.reports(seen).collect()}
    assert r[30].status == "learning" and r[31].status == "ready" and r[160].behavior_score == 74
    assert min(s for s, x in r.items() if x.severity != "none" and s > 96) == 139
    first = report.fresh_forecasts(report.forecasts(seen)).filter("seq > 96").orderBy("seq").first()
    assert first.seq == 113 and "(1438.64) in about 0.78 h (94 observations)" in first.summary
    top = r[160].attributions
    assert [a.feature for a in top] == ["toolFailureRate", "errorRate"] and top[0].summary == "toolFailureRate is above baseline: observed 0.26 vs expected 0.09 (z=3.47)"


def test_restore_goes_on_where_it_stopped(spark):
    cfg = Config(warmup=30)
    rows = features.long(features.wide(features.sequenced(S.simulate(spark, [3], 120)))).cache()
    whole = {r.feature: r for r in detect.snapshot(rows, cfg).collect()}
    half = detect.snapshot(rows.filter("seq <= 60"), cfg)
    rest = {r.feature: r for r in detect.snapshot(rows.filter("seq > 60"), cfg, restore=half.select("agent_id", "feature", "state")).collect()}
    assert {k: r.state for k, r in whole.items()} == {k: r.state for k, r in rest.items()}


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.operators import alerts
    from tidemark.streaming.engine import deliver, stream_observed

    cfg = Config(warmup=20, window=10, alerts=AlertPolicy(cooldown_ms=6 * 3_600_000))
    t = S.events_by_user(S.table(spark, SF, "events")).withColumn("metadata", F.create_map(F.lit("k"), F.col("tie").cast("string")))
    # turns of one time, in the order of their ties
    t = t.withColumn("ts", F.date_trunc("day", "ts"))
    batch = report.observed(features.wide(features.sequenced(t)), cfg).cache()
    ordered = t.orderBy("ts").toPandas()
    for part in (ordered[ordered.ts < "2024-01-13"], ordered[ordered.ts >= "2024-01-13"]):
        spark.createDataFrame(part.sample(frac=1, random_state=1), t.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def send(channel, ident, payload):
        if channel == "email":
            raise OSError("no way out")

    batches = deliver(send, ["slack", "email"], str(tmp_path / "sent"), str(tmp_path / "log"))

    def both(seen, number):
        seen.write.mode("append").parquet(str(tmp_path / "seen"))
        batches(seen, number)

    q = stream_observed(stream, cfg).writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(str, df.collect()))
    got = spark.read.parquet(str(tmp_path / "seen"))
    assert key(got.select(*batch.columns)) == key(batch)
    allowed = {r.alert_id for r in alerts.governed(batch).filter("allowed").collect()}
    sent = spark.read.parquet(str(tmp_path / "sent")).collect()
    assert allowed and {(r.alert_id, r.channel, r.ok) for r in sent} == {(i, c, c == "slack") for i in allowed for c in ("slack", "email")}
    log = spark.read.parquet(str(tmp_path / "log")).drop("batch")
    counts = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert counts["alert.dispatched"] == counts["alert.failed"] == len(allowed)
    plain = log.filter(~F.col("kind").isin("alert.dispatched", "alert.failed"))
    assert key(plain.select(*alerts.telemetry(batch).columns)) == key(alerts.telemetry(batch))


def test_turns_without_a_time_have_that_of_their_arrival(spark, tmp_path):
    from tidemark.streaming.engine import stream_reports

    t = S.events_by_user(S.table(spark, SF, "events")).limit(20).withColumn("ts", F.when(F.col("tie") % 2 == 0, F.col("ts")))
    assert report.observed(features.wide(features.sequenced(t)), Config()).filter("ts is null").count() == 0
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = stream_reports(stream, Config()).writeStream.format("memory").queryName("untimed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("untimed").filter("ts is not null").count() == 20


def test_alerts_carry_the_metadata_of_their_turn(spark):
    import json

    from tidemark.operators import alerts
    from tidemark.sinks import payloads

    t = features.sequenced(S.simulate(spark, [7], 160)).withColumn("metadata", F.create_map(F.lit("build"), F.col("seq").cast("string")))
    made = alerts.governed(report.observed(features.wide(t), Config(warmup=30)), enrich=lambda m: F.concat(m, F.lit(" See the log.")))
    rows = payloads.payloads(made).filter("channel = 'webhook'").collect()
    assert rows and all(json.loads(r.payload)["metadata"]["build"] for r in rows) and all(json.loads(r.payload)["message"].endswith("See the log.") for r in rows)


def test_payloads_are_json(spark):
    import json

    from tidemark.sinks import payloads

    rows = payloads.payloads(Q.plain_alerts(spark, SF)).collect()
    assert {r.channel for r in rows} == set(payloads.CHANNELS)
    for r in rows:
        if r.channel != "email":
            json.loads(r.payload)
    card = next(json.loads(r.payload) for r in rows if r.channel == "teams")
    assert card["attachments"][0]["content"]["body"][2]["type"] == "FactSet"
    sent = payloads.publish(Q.plain_alerts(spark, SF).limit(3), lambda c, i, p: 1 / 0 if c == "x" else None).collect()
    assert all(r.ok == (r.channel != "x") for r in sent)
