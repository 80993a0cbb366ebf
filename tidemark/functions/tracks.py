"""The state of one measured feature of one agent, and how an observation moves it. Plain Python; batch and streaming
share it."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import asdict, dataclass, field

from ..plans import config as C


def half_up(x: float, digits: int = 0) -> float:
    scale = 10.0**digits
    return math.floor(x * scale + 0.5) / scale


def plain(x: float) -> str:
    """A rounded number as short as it can be written."""
    x = half_up(x, 2)
    return str(int(x)) if x == int(x) else repr(x)


@dataclass
class Moments:
    """Count, mean, population variance and range, one value at a time."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    low: float | None = None
    high: float | None = None

    def push(self, x: float) -> None:
        self.n += 1
        gap = x - self.mean
        self.mean += gap / self.n
        self.m2 += gap * (x - self.mean)
        self.low = x if self.low is None else min(self.low, x)
        self.high = x if self.high is None else max(self.high, x)

    @property
    def std(self) -> float:
        return math.sqrt(self.m2 / self.n) if self.n > 1 else 0.0


@dataclass
class Ewma:
    """Exponentially weighted mean and variance."""

    alpha: float = 0.05
    n: int = 0
    mean: float = 0.0
    variance: float = 0.0

    def __post_init__(self):
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must be between 0 and 1")

    def push(self, x: float) -> None:
        self.n += 1
        if self.n == 1:
            self.mean = x
            return
        gap = x - self.mean
        move = self.alpha * gap
        self.mean += move
        self.variance = (1 - self.alpha) * (self.variance + gap * move)

    @property
    def std(self) -> float:
        return math.sqrt(self.variance)


@dataclass
class P2:
    """The P-square estimate of a quantile (Jain and Chlamtac, 1985): five markers that follow the quantile."""

    p: float = 0.5
    n: int = 0
    heights: list[float] = field(default_factory=list)
    places: list[float] = field(default_factory=lambda: [1.0, 2.0, 3.0, 4.0, 5.0])

    def __post_init__(self):
        if not 0 < self.p < 1:
            raise ValueError("p must be between 0 and 1")

    def push(self, x: float) -> None:
        self.n += 1
        q, n = self.heights, self.places
        if self.n <= 5:
            q.append(x)
            if self.n == 5:
                q.sort()
            return
        q[0], q[4] = min(q[0], x), max(q[4], x)
        cell = 3 if x >= q[4] else max(0, sum(x >= h for h in q[:4]) - 1)
        for i in range(cell + 1, 5):
            n[i] += 1
        last = self.n - 1
        for i in (1, 2, 3):
            wanted = 1 + last * (0, self.p / 2, self.p, (1 + self.p) / 2, 1)[i]
            gap = wanted - n[i]
            if (gap >= 1 and n[i + 1] - n[i] > 1) or (gap <= -1 and n[i - 1] - n[i] < -1):
                d = 1 if gap > 0 else -1
                up, down = (q[i + 1] - q[i]) / (n[i + 1] - n[i]), (q[i] - q[i - 1]) / (n[i] - n[i - 1])
                curved = q[i] + d / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + d) * up + (n[i + 1] - n[i] - d) * down)
                q[i] = curved if q[i - 1] < curved < q[i + 1] else q[i] + d * (q[i + d] - q[i]) / (n[i + d] - n[i])
                n[i] += d

    @property
    def value(self) -> float:
        if not self.heights:
            return 0.0
        if self.n < 5:
            return sorted(self.heights)[min(self.n - 1, int(self.p * self.n))]
        return self.heights[2]


@dataclass
class Shift:
    """Page-Hinkley test for a lasting change of the mean, with forgetting, both ways."""

    delta: float = 0.02
    limit: float = 75.0
    n: int = 0
    mean: float = 0.0
    up: float = 0.0
    least_up: float = 0.0
    down: float = 0.0
    most_down: float = 0.0

    def push(self, x: float) -> str | None:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        self.up = C.FORGETTING * self.up + (x - self.mean - self.delta)
        self.least_up = min(self.least_up, self.up)
        self.down = C.FORGETTING * self.down + (x - self.mean + self.delta)
        self.most_down = max(self.most_down, self.down)
        return "up" if self.up - self.least_up > self.limit else "down" if self.most_down - self.down > self.limit else None

    def reset(self) -> None:
        self.up = self.least_up = self.down = self.most_down = 0.0


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial X."""
    if k <= 0 or (p >= 1 and k <= n):
        return 1.0
    if k > n or p <= 0:
        return 0.0
    whole = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


# fixed values: Acklam's coefficients of the inverse normal distribution
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
TAIL = 0.02425


def horner(coefficients, x: float) -> float:
    out = 0.0
    for c in coefficients:
        out = out * x + c
    return out


def inverse_normal(p: float) -> float:
    p = min(max(p, 1e-300), 1 - 1e-16)
    if TAIL <= p <= 1 - TAIL:
        q = p - 0.5
        return horner(ACKLAM_A, q * q) * q / horner((*ACKLAM_B, 1.0), q * q)
    q = math.sqrt(-2 * math.log(min(p, 1 - p)))
    out = horner(ACKLAM_C, q) / horner((*ACKLAM_D, 1.0), q)
    return out if p < 0.5 else -out


def rate_shift_z(count: float, n: int, rate: float) -> float:
    """How far a count lies above what a rate leads to expect, as a normal deviate; 0 if it doesn't."""
    k = math.ceil(count - 1e-9)
    if k <= 0 or count <= n * rate:
        return 0.0
    tail = binomial_tail(k, n, rate)
    return 0.0 if tail >= 0.5 else max(0.0, -inverse_normal(tail))


def divergence(p: dict[str, float], q: dict[str, float]) -> float:
    """Jensen-Shannon divergence in bits of two distributions; 0 if one is empty."""
    if not p or not q:
        return 0.0
    total = 0.0
    for k in {**p, **q}:
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        total += 0.5 * (a * math.log2(a / m) if a else 0.0) + 0.5 * (b * math.log2(b / m) if b else 0.0)
    return min(1.0, max(0.0, total))


def trend(points: list[tuple[int, float]]) -> tuple[float, float, float, float] | None:
    """Slope per observation, t, next value and slope per hour of the least-squares line; none under three points."""
    n = len(points)
    if n < 3:
        return None
    values = [v for _, v in points]
    mx, my = (n - 1) / 2, math.fsum(values) / n
    sxx = n * (n * n - 1) / 12
    apart = [v - my for v in values]
    cross = math.sumprod(range(n), apart) - mx * math.fsum(apart)
    slope = cross / sxx
    base = my - slope * mx
    rss = max(0.0, math.sumprod(apart, apart) - slope * cross)
    error = math.sqrt(rss / (n - 2) / sxx)
    span = points[-1][0] - points[0][0]
    return slope, abs(slope) / max(error, 1e-12), base + slope * n, slope * (n - 1) * 3.6e6 / span if span > 0 else 0.0


def steps_to(current: float, threshold: float, slope: float) -> float | None:
    if slope == 0:
        return None
    steps = (threshold - current) / slope
    return steps if math.isfinite(steps) and steps > 0 else None


def deviation(raw: float, free: float, critical: float) -> float:
    """1 at the critical threshold, 0 up to ``free``."""
    if critical <= free:
        return 1.0 if raw >= critical else 0.0
    return max(0.0, (raw - free) / (critical - free))


class Gate:
    """What numeric and categorical features share: findings open after two observations out of range, or one beyond the
    warning threshold; an open one freezes the baseline, and closes after five well inside."""

    severity, calm, streak, frozen = "none", 0, 0, False

    def move(self, found: str, inside: bool) -> tuple[bool, str | None]:
        """Whether to report, and the severity that the feature moves to, if it does."""
        if found != "none":
            self.calm = 0
            self.streak += 1
            confirmed = self.streak >= C.OPEN_STREAK
            moved = None
            if confirmed and C.SEVERITIES.index(found) > C.SEVERITIES.index(self.severity):
                self.severity = moved = found
                self.frozen = True
            return confirmed, moved
        self.streak = 0
        if self.severity != "none":
            self.calm = self.calm + 1 if inside else 0
            if self.calm >= C.RECOVERY_STREAK:
                self.severity, self.frozen, self.calm = "none", False, 0
                return False, "none"
        return False, None

    def gate(self) -> dict:
        return {"severity": self.severity, "calm": self.calm, "streak": self.streak, "frozen": self.frozen}

    def set_gate(self, d: dict) -> None:
        self.severity, self.calm, self.streak, self.frozen = d["severity"], d["calm"], d["streak"], d["frozen"]


#: The quantiles of a snapshot.
QUANTILES = (0.5, 0.95, 0.99)


class Numeric(Gate):
    """A numeric feature."""

    def __init__(self, feature: str, cfg: C.Config, quantiles: bool = True):
        s = cfg.sensitivity
        self.feature, self.cfg, self.rate = feature, cfg, feature in C.RATES
        self.moments, self.ewma, self.shift = Moments(), Ewma(s.ewma_alpha), Shift(s.shift_delta, s.shift_lambda)
        #: Nothing is judged by them, so they are followed only where they are asked for.
        self.quantiles = [P2(p) for p in QUANTILES] if quantiles else []
        self.ring: deque[tuple[int, float]] = deque(maxlen=cfg.window)

    @property
    def spread(self) -> float:
        return max(self.ewma.std, 0.25 * self.moments.std, 1e-9)

    def absorb_value(self, x: float) -> None:
        self.moments.push(x)
        self.ewma.push(x)
        for q in self.quantiles:
            q.push(x)

    def step(self, x: float, t: int, learning: bool) -> dict:
        s = self.cfg.sensitivity
        if learning:
            self.absorb_value(x)
            self.ring.append((t, x))
            return {"z": None, "deviation": 0.0}
        floor = 1 / (self.moments.n + 2)
        if self.rate:
            self.ring.append((t, x))
            base = min(1.0, max(0.0, self.moments.mean))
            total, n = sum(v for _, v in self.ring), len(self.ring)
            z = min(C.Z_CAP, max(0.0, rate_shift_z(total, n, max(base, floor))))
            observed, expected = total / n, base
            mean = self.moments.mean
            long_std = max(math.sqrt(max(0.0, max(mean, floor) * (1 - min(mean, 1 - 1e-6)))), 1e-9)
        else:
            observed, expected = x, self.ewma.mean
            z = min(C.Z_CAP, max(-C.Z_CAP, (x - expected) / self.spread))
            long_std = max(self.moments.std, 1e-9)
        fired = self.shift.push(min(C.Z_CAP, max(-C.Z_CAP, (x - self.moments.mean) / long_std)))
        if fired:
            self.shift.reset()
        size = abs(z)
        found = "critical" if size >= s.critical_z else "warning" if size >= s.warning_z else "none"
        direction = "above" if z > 0 else "below" if z < 0 or fired == "down" else "above"
        far = 0.0 if found == "none" else min(3.0, deviation(size, 1.0, s.critical_z))
        report, moved = self.move(found, size < C.RECOVERY_BAND * s.warning_z)
        if moved == "none":
            self.shift.reset()
        finding = found if report else None
        if fired and found == "none":
            finding = "warning"
            far = max(far, min(3.0, deviation(s.warning_z, 1.0, s.critical_z)))
        if not self.frozen and found == "none":
            self.absorb_value(x)
        if not self.rate:
            self.ring.append((t, x))
        out = {"z": z, "deviation": far, "direction": direction, "observed": observed, "expected": expected, "shift": fired, "moved": moved}
        if finding:
            text = f"{self.feature} is {direction} baseline: observed {plain(observed)} vs expected {plain(expected)} (z={plain(z)})"
            out |= {"finding": finding, "score": z, "summary": text + (", sustained mean shift confirmed" if fired else "")}
        return out

    def forecast(self) -> dict | None:
        """When the trend of the window will cross the critical threshold, if it does within a day."""
        if self.severity != "none" or len(self.ring) < C.TREND_POINTS:
            return None
        line = trend(list(self.ring))
        if line is None or line[0] == 0 or line[1] < C.TREND_T:
            return None
        slope, _, _, hourly = line
        threshold = self.ewma.mean + math.copysign(self.cfg.sensitivity.critical_z * self.spread, slope)
        if self.rate:
            threshold = min(1.0, max(0.0, threshold))
        last = self.ring[-1][1]
        if threshold < 0 or (last >= threshold if slope > 0 else last <= threshold):
            return None
        steps = steps_to(last, threshold, slope)
        if steps is None or steps < 1 or hourly == 0:
            return None
        hours = (threshold - last) / hourly
        if not math.isfinite(hours) or not 0 < hours <= C.HORIZON_HOURS:
            return None
        way = "up" if slope > 0 else "down"
        text = f"{self.feature} is trending {way} and is projected to cross its critical threshold ({plain(threshold)}) in about {plain(hours)} h ({int(half_up(steps))} observations) if the trend continues"
        return {"slope": slope, "hourly": hourly, "steps": int(half_up(steps)), "hours": half_up(hours, 2), "summary": text}

    def absorb(self) -> None:
        """Take the window as the new baseline."""
        s = self.cfg.sensitivity
        self.moments, self.ewma, self.shift = Moments(), Ewma(s.ewma_alpha), Shift(s.shift_delta, s.shift_lambda)
        self.quantiles = [P2(q.p) for q in self.quantiles]
        for _, x in self.ring:
            self.absorb_value(x)
        self.severity, self.calm, self.streak, self.frozen = "none", 0, 0, False

    def state(self) -> dict:
        return {"moments": asdict(self.moments), "ewma": asdict(self.ewma), "shift": asdict(self.shift), "quantiles": [asdict(q) for q in self.quantiles], "ring": list(self.ring), **self.gate()}

    @classmethod
    def restored(cls, feature: str, d: dict, cfg: C.Config) -> Numeric:
        """Baselines keep the rates and thresholds of the snapshot; the window's size is that of ``cfg``."""
        out = cls(feature, cfg)
        out.moments, out.ewma, out.shift = Moments(**d["moments"]), Ewma(**d["ewma"]), Shift(**d["shift"])
        out.quantiles = [P2(**q) for q in d["quantiles"]]
        out.ring.extend((int(t), float(v)) for t, v in d["ring"])
        out.set_gate(d)
        return out


class Categorical(Gate):
    """A categorical feature: the mix of the last samples against all samples of the baseline."""

    def __init__(self, feature: str, cfg: C.Config):
        self.feature, self.cfg = feature, cfg
        self.counts: dict[str, int] = {}
        self.ring: deque[str] = deque(maxlen=cfg.window)

    def recent(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for x in self.ring:
            out[x] = out.get(x, 0) + 1
        return {k: v / len(self.ring) for k, v in out.items()}

    def baseline(self) -> dict[str, float]:
        total = sum(self.counts.values())
        return {k: v / total for k, v in self.counts.items()}

    def step(self, samples: list[str], t: int, learning: bool) -> dict:
        if not samples:
            return {"z": None, "deviation": None}
        for x in samples:
            self.ring.append(x)
            if learning or not self.frozen:
                self.counts[x] = self.counts.get(x, 0) + 1
        if learning:
            return {"z": None, "deviation": 0.0}
        s = self.cfg.sensitivity
        old, new = self.baseline(), self.recent()
        # the divergence that samples of one distribution are expected to show
        chance = (len({**old, **new}) - 1) / (4 * max(1, len(self.ring)) * math.log(2))
        far = max(0.0, divergence(old, new) - chance)
        found = "critical" if far >= s.critical_jsd else "warning" if far >= s.warning_jsd else "none"
        dev = 0.0 if found == "none" else min(3.0, deviation(far, s.warning_jsd / 2, s.critical_jsd))
        report, moved = self.move(found, far < C.RECOVERY_BAND * s.warning_jsd)
        out = {"z": far, "deviation": dev, "direction": "shifted", "observed": None, "expected": None, "shift": None, "moved": moved}
        if report:
            mix = ", ".join(f"{k} {int(half_up(v * 100))}%" for k, v in sorted(new.items(), key=lambda kv: -kv[1])[:3])
            out |= {"finding": found, "score": far, "summary": f"{self.feature} distribution shifted (JSD={plain(far)}); recent mix: {mix}"}
        return out

    def forecast(self) -> None:
        return None

    def absorb(self) -> None:
        """Add the window to the baseline."""
        for x in self.ring:
            self.counts[x] = self.counts.get(x, 0) + 1
        self.severity, self.calm, self.frozen = "none", 0, False

    def state(self) -> dict:
        return {"counts": self.counts, "ring": list(self.ring), "window": self.ring.maxlen, **self.gate()}

    @classmethod
    def restored(cls, feature: str, d: dict, cfg: C.Config) -> Categorical:
        out = cls(feature, cfg)
        out.counts, out.ring = dict(d["counts"]), deque(d["ring"], maxlen=d["window"])
        out.set_gate(d)
        return out


def track(feature: str, cfg: C.Config, quantiles: bool = True) -> Numeric | Categorical:
    return Categorical(feature, cfg) if feature in C.CATEGORICAL else Numeric(feature, cfg, quantiles)
