"""What each channel is sent, as columns. Formats are fixed by the channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("slack", "discord", "teams", "googlechat", "telegram", "pagerduty", "webhook", "notion", "reddit", "x", "googlesheets", "googledocs", "email")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 3)), F.lit("..."[: min(3, most)])))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc1123(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def color(severity: Column) -> Column:
    return F.when(severity == "info", "#439fe0").when(severity == "warning", "#f2c744").otherwise("#e01e5a")


def text() -> Column:
    """An alert as lines."""
    lines = F.array("title", F.concat(F.lit("Agent: "), "agent_id"), F.concat(F.lit("Severity: "), "severity"), F.concat(F.lit("Kind: "), "kind"), F.format_string("Behavior score: %d/100", "behavior_score"), iso(F.col("ts")), F.lit(""), "message")
    return F.array_join(F.concat(lines, F.transform(F.slice("attributions", 1, 5), lambda a: F.concat(F.lit("- "), a["summary"]))), "\n")


def compact() -> Column:
    """An alert in one line of at most 240 characters."""
    return truncated(F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title", F.lit(": "), "message"), 240)


def sheet_row() -> list[Column]:
    return [iso(F.col("ts")).alias("at"), F.col("agent_id"), F.col("severity"), F.col("kind"), F.col("behavior_score"), F.col("top_feature"), truncated(F.col("message"), 500).alias("message")]


def email(sender: str, recipients: list[str], prefix: str = "[drift]") -> Column:
    """A message for SMTP: headers without line breaks, CRLF ends, and dots at the start of a line doubled."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"[\r\n]+", " "))
    head = [F.lit(f"From: {sender}"), F.lit(f"To: {', '.join(recipients)}"), F.concat(F.lit(f"Subject: {prefix} "), clean(F.col("title"))), F.concat(F.lit("Date: "), rfc1123(F.col("ts"))), F.concat(F.lit("Message-ID: <"), clean(F.col("alert_id")), F.lit("@tidemark>")), F.lit("MIME-Version: 1.0"), F.lit("Content-Type: text/plain; charset=utf-8"), F.lit("Content-Transfer-Encoding: 8bit"), F.lit(""), text()]
    lines = F.split(F.array_join(F.array(*head), "\n"), r"\r\n|\r|\n")
    return F.array_join(F.transform(lines, lambda s: F.when(s.startswith("."), F.concat(F.lit("."), s)).otherwise(s)), "\r\n")


def payloads(alerts: DataFrame, sender: str = "alerts@example.com", recipients: tuple[str, ...] = ("oncall@example.com",)) -> DataFrame:
    """(``alert_id``, ``channel``, ``payload``): what would be sent, JSON or text. Credentials are the sender's affair.
    ``sender`` and ``recipients`` are those of e-mail."""
    S = lambda **x: F.struct(*(v.alias(k.rstrip("_")) for k, v in x.items()))
    L, C, J = F.lit, F.col, F.to_json
    score = F.format_string("%d/100", "behavior_score")
    why = F.slice("attributions", 1, 5)
    made = {
        "slack": J(S(text=compact(), blocks=F.array(S(type=L("section"), text=S(type=L("mrkdwn"), text=F.format_string("*%s*\n%s", "title", "message")), elements=L(None).cast("array<struct<type:string,text:string>>")), S(type=L("context"), text=L(None).cast("struct<type:string,text:string>"), elements=F.array(S(type=L("mrkdwn"), text=F.format_string("agent %s | severity %s | score %s", "agent_id", "severity", score))))))),
        "discord": J(S(content=compact(), embeds=F.array(S(title=truncated(C("title"), 256), description=truncated(C("message"), 4000), color=F.conv(F.substring(color(C("severity")), 2, 6), 16, 10).cast("int"), fields=F.transform(why, lambda a: S(name=truncated(a["feature"], 256), value=truncated(a["summary"], 1024))), timestamp=iso(C("ts")))))),
        "teams": J(S(type=L("message"), attachments=F.array(S(contentType=L("application/vnd.microsoft.card.adaptive"), content=F.struct(L("AdaptiveCard").alias("type"), L("1.4").alias("version"), L("http://adaptivecards.io/schemas/adaptive-card.json").alias("$schema"), F.array(J(S(type=L("TextBlock"), text=C("title"), weight=L("Bolder"), size=L("Medium"), color=F.when(C("severity") == "info", "Good").when(C("severity") == "warning", "Warning").otherwise("Attention"), wrap=L(True))), J(S(type=L("TextBlock"), text=C("message"), wrap=L(True))), J(S(type=L("FactSet"), facts=F.array(S(title=L("Agent"), value=C("agent_id")), S(title=L("Severity"), value=C("severity")), S(title=L("Score"), value=score))))).alias("body")))))),
        "googlechat": J(S(text=text())),
        "telegram": J(S(text=truncated(text(), 4000), disable_web_page_preview=L(True))),
        "pagerduty": J(S(event_action=L("trigger"), dedup_key=C("alert_id"), payload=S(summary=truncated(compact(), 1024), source=C("agent_id"), severity=C("severity"), timestamp=iso(C("ts")), custom_details=S(behaviorScore=C("behavior_score"), kind=C("kind"), attributions=F.transform("attributions", lambda a: a["summary"]))))),
        "webhook": J(S(id=C("alert_id"), agentId=C("agent_id"), kind=C("kind"), severity=C("severity"), title=C("title"), message=C("message"), behaviorScore=C("behavior_score"), attributions=C("attributions"), timestamp=F.unix_millis("ts"), **({"metadata": C("metadata")} if "metadata" in alerts.columns else {}))),
        "notion": J(S(properties=S(Name=S(title=F.array(S(text=S(content=truncated(C("title"), 200))))), Severity=S(select=S(name=C("severity"))), Agent=S(rich_text=F.array(S(text=S(content=C("agent_id"))))), Score=S(number=C("behavior_score")), Message=S(rich_text=F.array(S(text=S(content=truncated(C("message"), 1900)))))))),
        "reddit": J(S(kind=L("self"), title=truncated(C("title"), 300), text=text())),
        "x": J(S(text=truncated(compact(), 280))),
        "googlesheets": J(S(values=F.array(F.array(iso(C("ts")), C("agent_id"), C("severity"), C("kind"), C("behavior_score").cast("string"), C("top_feature"), truncated(C("message"), 500))))),
        "googledocs": J(S(requests=F.array(S(insertText=S(text=F.concat(L("\n"), text(), L("\n"))))))),
        "email": email(sender, list(recipients)),
    }
    rows = F.array(*(F.struct(L(k).alias("channel"), v.alias("payload")) for k, v in made.items()))
    out = alerts.select("alert_id", F.explode(rows).alias("p")).select("alert_id", "p.*")
    # blocks of a card differ in shape, so they are rendered one by one and put in as they are
    card = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("payload"), r'"body":\["\{', '"body":[{'), r'\}","\{', "},{"), r'\}"\]', "}]")
    return out.withColumn("payload", F.when(F.col("channel") == "teams", F.regexp_replace(card, r'\\(["\\])', "$1")).otherwise(F.col("payload")))


def publish(alerts: DataFrame, send, channels: list[str] | None = None, **options) -> DataFrame:
    """Sends each payload with ``send(channel, alert_id, payload)``, such as a ``senders.Sender``, from the executors and returns what became of it:
    (``alert_id``, ``channel``, ``ok``, ``error``). A failure is a row, never an exception; use in ``foreachBatch``."""
    rows = payloads(alerts, **options)
    rows = rows.filter(F.col("channel").isin(channels)) if channels is not None else rows

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    send(r["channel"], r["alert_id"], r["payload"])
                    out.append((r["alert_id"], r["channel"], True, None))
                except Exception as e:  # noqa: BLE001
                    out.append((r["alert_id"], r["channel"], False, str(e)[:200]))
            yield pa.RecordBatch.from_pylist([dict(zip(("alert_id", "channel", "ok", "error"), r, strict=True)) for r in out], pa.schema([("alert_id", pa.string()), ("channel", pa.string()), ("ok", pa.bool_()), ("error", pa.string())]))

    return rows.mapInArrow(run, "alert_id string, channel string, ok boolean, error string")
