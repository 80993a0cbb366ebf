"""An agent turn by turn: its reports, its alerts and its log. Plain Python; batch, streaming and the single process share
it."""

from __future__ import annotations

import math

from ..plans.config import CATEGORICAL, LEAST_DEVIATION, MOST_ATTRIBUTIONS, NUMERIC, SCORE_ALPHA, SEVERITIES, AlertPolicy, Config
from .tracks import Categorical, Numeric, half_up, track


def attributed(seen: list[tuple[str, float, dict | None]]) -> list[dict]:
    """The shares of features (name, deviation, finding) in a turn's squared deviation, as ``report.attributions`` has them."""
    top = sorted((s for s in seen if s[1] >= LEAST_DEVIATION or s[2]), key=lambda s: -s[1])[:MOST_ATTRIBUTIONS]
    total = sum(d * d for _, d, _ in top)
    out = []
    for name, d, finding in top if total else ():
        said = finding or {"direction": "above", "score": d, "observed": None, "expected": None, "summary": f"{name} deviates at {int(half_up(d * 100))}% of its critical threshold"}
        out.append({"feature": name, "contribution": half_up(d * d / total, 4), **{k: said[k] for k in ("score", "direction", "observed", "expected", "summary")}})
    return out


class Agent:
    """All features of one agent, turn by turn."""

    def __init__(self, cfg: Config, quantiles: bool = True, forecasts: bool = True):
        self.cfg, self.seq, self.index, self.tracks, self.quantiles, self.forecasts = cfg, 0, 0.0, {}, quantiles, forecasts

    def observe(self, values: dict[str, float], samples: dict[str, list[str]], millis: int) -> dict:
        """``values`` and ``samples`` by feature, those that the turn has."""
        self.seq += 1
        learning = self.seq <= self.cfg.warmup
        square, n, found, seen = 0.0, 0, [], []
        for name in (*NUMERIC, *CATEGORICAL):
            x = values.get(name) if name in NUMERIC else samples.get(name)
            if x is None or (name in CATEGORICAL and not len(x)):
                continue
            state = self.tracks.get(name)
            if state is None:
                state = self.tracks[name] = track(name, self.cfg, self.quantiles)
            out = state.step(x if name in NUMERIC else list(x), millis, learning)
            square, n = square + out["deviation"] ** 2, n + 1
            finding = None
            if out.get("finding"):
                finding = {"feature": name, "severity": out["finding"], "direction": out["direction"], "score": out["score"], "observed": out.get("observed"), "expected": out.get("expected"), "summary": out["summary"]}
                found.append(finding)
            seen.append((name, out["deviation"], finding))
        instant = math.sqrt(square / n) if n else 0.0
        self.index += SCORE_ALPHA * (instant - self.index)
        ahead = [] if learning or not self.forecasts else [{"feature": name, **f} for name in NUMERIC if name in self.tracks and (f := self.tracks[name].forecast())]
        top = max((SEVERITIES.index(f["severity"]) for f in found), default=0)
        return {"seq": self.seq, "status": "learning" if learning else "ready", "severity": SEVERITIES[top], "instant": instant, "behavior_score": int(half_up(100 * math.exp(-self.index))), "findings": found, "attributions": attributed(seen), "forecasts": ahead}

    def absorb(self, feature: str | None = None) -> None:
        for name, state in self.tracks.items():
            if feature in (None, name):
                state.absorb()

    def state(self) -> dict:
        return {"version": 1, "seq": self.seq, "index": self.index, "tracks": {k: v.state() for k, v in self.tracks.items()}}

    @classmethod
    def restored(cls, d: dict, cfg: Config) -> Agent:
        if d.get("version") != 1:
            raise ValueError(f"state of version {d.get('version')!r} can't be read")
        out = cls(cfg)
        out.seq, out.index = d["seq"], d["index"]
        out.tracks = {k: (Categorical if k in CATEGORICAL else Numeric).restored(k, v, cfg) for k, v in d["tracks"].items()}
        return out


class Governor:
    """Decides on the alerts of one agent, kind and top feature, in order."""

    def __init__(self, policy: AlertPolicy):
        self.policy, self.floor, self.last = policy, SEVERITIES.index(policy.min_severity), None

    def reason(self, kind: str, level: int, now: float) -> str | None:
        """Why an alert of a severity's rank at ``now`` (ms) doesn't go out, or None."""
        if self.policy.canary:
            return "canary"
        if kind == "drift" and level < self.floor:
            return "below-min-severity"
        if self.last and now - self.last[0] < self.policy.cooldown_ms and level <= self.last[1]:
            return "cooldown"
        self.last = (now, level)
        return None


class Desk:
    """What an agent's reports give rise to: alerts that are decided on, and the log. Alerts come on findings, on recovery, and on
    a forecast of a feature that had none before."""

    def __init__(self, agent: str, policy: AlertPolicy):
        self.agent, self.policy, self.count, self.governors = agent, policy, 0, {}
        self.severity, self.status, self.ahead = "none", None, frozenset()

    def take(self, report: dict, millis: int) -> tuple[list[dict], list[dict]]:
        """The alerts and the log of a turn."""
        log, alerts, name, score = [], [], self.agent, report["behavior_score"]

        def say(at: int, kind: str, feature=None, severity=None, message=None) -> None:
            log.append({"event_ord": at, "kind": kind, "feature": feature, "severity": severity, "message": message})

        def alert(at: int, kind: str, severity: str, title: str, message: str) -> None:
            self.count += 1
            why = report["attributions"]
            top = why[0]["feature"] if why else ""
            governor = self.governors.setdefault((kind, top), Governor(self.policy))
            reason = governor.reason(kind, SEVERITIES.index(severity), millis)
            ident = f"{name}-{kind}-{millis}-{self.count}"
            alerts.append({"alert_id": ident, "at": at, "kind": kind, "severity": severity, "title": title, "message": message, "top_feature": top, "allowed": reason is None, "reason": reason})
            if reason:
                say(at * 100 + 101, "alert.suppressed", None, severity, reason)

        if report["seq"] == 1:
            say(0, "agent.registered")
        say(1, "observation.recorded")
        if report["status"] == "learning" or self.status in (None, "learning"):
            say(2, f"baseline.{report['status']}")
        for i, f in enumerate(report["findings"]):
            say(2 * i + 3, "drift.detected", f["feature"], f["severity"])
            if f["severity"] == "critical":
                say(2 * i + 4, "baseline.frozen", f["feature"])
        if report["severity"] != "none":
            reasons = " | ".join(a["summary"] for a in report["attributions"][:3])
            alert(0, "drift", report["severity"], f"Behavioral drift detected: {name}", f"Behavior score {score}/100." + (f" {reasons}" if reasons else ""))
        elif self.severity != "none":
            say(100, "drift.recovered")
            if self.policy.notify_recovery:
                alert(1, "recovery", "info", f"Behavior recovered: {name}", f'Agent "{name}" returned to its learned baseline (behavior score {score}/100).')
        fresh = [f["feature"] for f in report["forecasts"] if f["feature"] not in self.ahead]
        for i, feature in enumerate(fresh):
            say(200 + i, "forecast.detected", feature)
        if fresh and self.policy.notify_forecast:
            alert(2, "forecast", "warning", f"Behavioral trend warning: {name}", " | ".join(f["summary"] for f in report["forecasts"]))
        self.severity, self.status, self.ahead = report["severity"], report["status"], frozenset(f["feature"] for f in report["forecasts"])
        return alerts, log

    def state(self) -> dict:
        return {"count": self.count, "severity": self.severity, "status": self.status, "ahead": sorted(self.ahead), "governors": [[*k, *(g.last or ())] for k, g in self.governors.items()]}

    @classmethod
    def restored(cls, agent: str, d: dict, policy: AlertPolicy) -> Desk:
        out = cls(agent, policy)
        out.count, out.severity, out.status, out.ahead = d["count"], d["severity"], d["status"], frozenset(d["ahead"])
        for kind, top, *last in d["governors"]:
            g = out.governors[kind, top] = Governor(policy)
            g.last = tuple(last) or None
        return out
