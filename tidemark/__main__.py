"""``python -m tidemark simulate | inspect | serve``."""

from __future__ import annotations

import argparse
import json
import signal
import sys
import threading

from .plans.config import Config
from .service import serve
from .sinks.senders import Sender
from .sources.turns import simulated_turns
from .streaming.live import FileState, Live

FLUSH_SECONDS = 30


def as_json(turn: dict) -> dict:
    """A turn of the simulator as it would come in JSON."""
    return {
        "agentId": turn["agent_id"], "timestamp": round(turn["ts"].timestamp() * 1000), "latencyMs": turn["latency_ms"], "costUsd": turn["cost_usd"], "inputTokens": turn["input_tokens"],
        "outputTokens": turn["output_tokens"], "toolCalls": turn["tool_calls"], "finishReason": turn["finish_reason"], "error": turn["error_flag"],
    }


def simulate(turns: int, warmup: int, drift_at: int | None, seed: int) -> list[str]:
    """What happens in a simulated run, as lines."""
    # fixed values: the wording of the lines
    after = turns * 6 // 10 if drift_at is None else drift_at
    lines, first, report = [f"simulation: turns={turns} warmup={warmup} drift-at={after} seed={seed}"], None, None
    engine = Live(Config(warmup=warmup))

    def listen(e: dict) -> None:
        nonlocal first
        r, kind = e.get("report"), e["kind"]
        if kind == "baseline.ready":
            lines.append(f"turn {r['seq']} {kind} agent={e['agentId']}")
        elif kind == "drift.detected":
            score = next(f["score"] for f in r["findings"] if f["feature"] == e["feature"])
            lines.append(f"turn {r['seq']} {kind} feature={e['feature']} severity={e['severity']} score={score:.2f} behavior={r['behaviorScore']}")
            first = r["seq"] if first is None and r["seq"] > after else first
        elif kind == "drift.recovered":
            lines.append(f"turn {r['seq']} {kind} agent={e['agentId']} behavior={r['behaviorScore']}")
        elif kind == "forecast.detected":
            lines.append(f"turn {r['seq']} {kind} feature={e['feature']} {next(f['summary'] for f in r['forecasts'] if f['feature'] == e['feature'])}")

    engine.on(listen)
    for turn in simulated_turns(seed, turns, after):
        report = engine.observe(as_json(turn))
    engine.close()
    found = "not detected" if first is None else f"turn {first} (delay {first - after} turns)"
    lines += ["--- summary ---", f"turns: {turns}", f"drift injected at turn: {after}", f"first detection: {found}", f"final behavior score: {report['behaviorScore'] if report else 'n/a'}"]
    top = report["attributions"][:3] if report else []
    lines.append("top attributions:" if top else "top attributions: none")
    return lines + [f"  {a['feature']} contribution={a['contribution']:.2f} {a['summary']}" for a in top]


def inspect(path: str) -> list[str]:
    """What was learned, as tables."""
    agents, lines = Live(state=FileState(path)).inspect()["agents"], []
    if not agents:
        return [f"no state found at {path}"]
    for a in agents:
        lines.append(f"agent {a['agentId']} {a['status']} observations={a['observations']}")
        rows = [["feature", "mean", "stdDev", "p50", "p95", "p99"]] + [[f["feature"], *(f"{f[k]:.2f}" for k in ("mean", "stdDev", "p50", "p95", "p99"))] for f in a["numeric"]]
        wide = [max(map(len, column)) for column in zip(*rows, strict=True)]
        for row in rows if a["numeric"] else ():
            lines.append("  " + "  ".join([row[0].ljust(wide[0]), *(c.rjust(w) for c, w in zip(row[1:], wide[1:], strict=True))]))
        if a["frozen"]:
            lines.append(f"  frozen: {', '.join(a['frozen'])}")
        lines.append("")
    return [*lines, f"total agents={len(agents)} observations={sum(a['observations'] for a in agents)}"]


def channels(slack: str | None, webhook: str | None) -> dict:
    """Channels of alerts by address."""
    send, out = Sender({"slack": {"url": slack}, "webhook": {"url": webhook}}), {}
    if slack:

        def to_slack(a: dict) -> None:
            line = f"[{a['severity'].upper()}] {a['title']}: {a['message']}"
            line = line if len(line) <= 240 else f"{line[:237]}..."
            facts = f"agent {a['agentId']} | severity {a['severity']} | score {a['behaviorScore']}/100"
            blocks = [{"type": "section", "text": {"type": "mrkdwn", "text": f"*{a['title']}*\n{a['message']}"}}, {"type": "context", "elements": [{"type": "mrkdwn", "text": facts}]}]
            send("slack", a["id"], json.dumps({"text": line, "blocks": blocks}))

        out["slack"] = to_slack
    if webhook:
        out["webhook"] = lambda a: send("webhook", a["id"], json.dumps(a))
    return out


def run_service(o: argparse.Namespace) -> None:
    engine = Live(state=FileState(o.state) if o.state else None, channels=channels(o.slack, o.webhook))
    server, ended = serve(engine, o.host, o.port, o.token), threading.Event()

    def flush() -> None:
        while not ended.wait(FLUSH_SECONDS):
            try:
                engine.flush()
            except OSError as e:
                print(f"tidemark serve: saving failed: {e}", file=sys.stderr)

    for number in (signal.SIGINT, signal.SIGTERM):
        signal.signal(number, lambda *_: threading.Thread(target=server.shutdown).start())
    threading.Thread(target=flush, daemon=True).start()
    print(f"tidemark serve listening on http://{o.host}:{server.server_port}", flush=True)
    server.serve_forever()
    ended.set()
    server.server_close()
    engine.close()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("simulate", help="a simulated run with drift")
    c.add_argument("--turns", type=int, default=200)
    c.add_argument("--warmup", type=int, default=50)
    c.add_argument("--drift-at", type=int)
    c.add_argument("--seed", type=int, default=42)
    c = commands.add_parser("inspect", help="what a state file holds")
    c.add_argument("--state", required=True)
    c = commands.add_parser("serve", help="an HTTP service")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8787)
    for name in ("--state", "--slack", "--webhook", "--token"):
        c.add_argument(name)
    o = parser.parse_args(arguments)
    if o.command == "serve":
        run_service(o)
    else:
        print("\n".join(simulate(o.turns, o.warmup, o.drift_at, o.seed) if o.command == "simulate" else inspect(o.state)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
