"""The engine once more as DuckDB SQL, to compare the queries with: recursive where the state machine is sequential.

The SQL follows the definitions, not the code: windows give the ring and its trend, recursion over a feature's observations
carries baseline, shift test and gate, and recursion over a governor's alerts its cooldown.
"""

from __future__ import annotations

from ..functions.tracks import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D
from .config import SEVERITIES, AlertPolicy, Config


def horner(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r})::DOUBLE)"
    return out


def inverse_normal(p: str) -> str:
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{horner(ACKLAM_A, f'({q} * {q})')} * {q} / {horner((*ACKLAM_B, 1.0), f'({q} * {q})')}"
    tail = f"{horner(ACKLAM_C, t)} / {horner((*ACKLAM_D, 1.0), t)}"
    return f"CASE WHEN {p} >= 0.02425 AND {p} <= 0.97575 THEN {middle} WHEN {p} < 0.5 THEN {tail} ELSE -({tail}) END"


def stacked(base: str, *steps: dict[str, str]) -> str:
    """``base`` with columns added step by step, each step seeing those before."""
    for step in steps:
        base = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {base})"
    return base


def plain(x: str) -> str:
    """A number as the summaries write it."""
    v = f"(floor(({x}) * 100 + 0.5) / 100)"
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


#: What numeric and categorical features share, over (sev, calm, streak, nfound, inside, learning).
GATE = (
    {"nstreak": "CASE WHEN learning THEN streak WHEN nfound > 0 THEN streak + 1 ELSE 0 END", "c1": "CASE WHEN inside THEN calm + 1 ELSE 0 END"},
    {
        "nsev": "CASE WHEN learning THEN sev WHEN nfound > 0 THEN CASE WHEN nstreak >= 2 AND nfound > sev THEN nfound ELSE sev END WHEN sev > 0 AND c1 >= 5 THEN 0 ELSE sev END",
        "ncalm": "CASE WHEN learning THEN calm WHEN nfound > 0 THEN 0 WHEN sev > 0 THEN CASE WHEN c1 >= 5 THEN 0 ELSE c1 END ELSE calm END",
    },
)
NAMED = "CASE {} WHEN 0 THEN 'none' WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'critical' END"


def numbers(cfg: Config) -> str:
    """CTEs ``ringed`` and ``judged`` over ``n`` (agent_id, seq, ts, feature, ord, rate, x)."""
    s = cfg.sensitivity
    std = "(CASE WHEN n > 1 THEN sqrt(m2 / n) ELSE 0.0::DOUBLE END)"
    tail = "list_sum(list_transform(range(CAST(kk AS BIGINT), rn + 1), lambda i: exp(lgamma(rn + 1) - lgamma(i + 1) - lgamma(rn - i + 1) + i * ln(base) + (rn - i) * ln(1 - base))))"
    stepped = stacked(
        "(SELECT r.*, g.seq, g.ts, g.x, g.rt, g.rn, g.rate, g.learning, g.slope, g.trend_t, g.hourly FROM (SELECT agent_id, feature, ord, k AS rk, n, wm, m2, en, em, ev, pn, pm, up, lo, dn, hi, sev, calm, streak FROM judged) r JOIN ringed g ON g.agent_id = r.agent_id AND g.feature = r.feature AND g.k = r.rk + 1)",
        {"std": std, "least_rate": "1 / (n + 2)::DOUBLE"},
        {"spread": "greatest(sqrt(ev), 0.25::DOUBLE * std, 1e-9)", "base": "greatest(least(1.0::DOUBLE, greatest(0.0::DOUBLE, wm)), least_rate)", "kk": "greatest(ceil(rt - 1e-9), 0)"},
        {"tail": f"CASE WHEN rate AND NOT learning AND kk > 0 AND rt > rn * base THEN least(1.0::DOUBLE, {tail}) ELSE 1.0::DOUBLE END", "long_std": "greatest(CASE WHEN rate THEN sqrt(greatest(0.0::DOUBLE, greatest(wm, least_rate) * (1 - least(wm, 1 - 1e-6)))) ELSE std END, 1e-9)"},
        {"nz": f"CASE WHEN learning THEN NULL WHEN rate THEN CASE WHEN tail >= 0.5 THEN 0.0::DOUBLE ELSE least(50.0::DOUBLE, greatest(0.0::DOUBLE, -({inverse_normal('greatest(tail, 1e-300)')}))) END ELSE least(50.0::DOUBLE, greatest(-50.0::DOUBLE, (x - em) / spread)) END", "zl": "least(50.0::DOUBLE, greatest(-50.0::DOUBLE, (x - wm) / long_std))", "npn": "CASE WHEN learning THEN pn ELSE pn + 1 END"},
        {"npm": "CASE WHEN learning THEN pm ELSE pm + (zl - pm) / npn END"},
        {"nup": f"CASE WHEN learning THEN up ELSE 0.999::DOUBLE * up + (zl - npm - {s.shift_delta}::DOUBLE) END", "ndn": f"CASE WHEN learning THEN dn ELSE 0.999::DOUBLE * dn + (zl - npm + {s.shift_delta}::DOUBLE) END"},
        {"nlo": "least(lo, nup)", "nhi": "greatest(hi, ndn)", "nfound": f"CASE WHEN learning THEN 0 WHEN abs(nz) >= {s.critical_z} THEN 3 WHEN abs(nz) >= {s.warning_z} THEN 2 ELSE 0 END", "inside": f"coalesce(abs(nz) < 0.7::DOUBLE * {s.warning_z}, false)"},
        {"nfired": f"CASE WHEN learning THEN NULL WHEN nup - nlo > {s.shift_lambda} THEN 'up' WHEN nhi - ndn > {s.shift_lambda} THEN 'down' END"},
        *GATE,
        {"takes": "learning OR (nfound = 0 AND nsev = 0)", "wipe": "nfired IS NOT NULL OR (sev > 0 AND nsev = 0)", "nwm": "wm + (x - wm) / (n + 1)"},
    )
    after = {
        "n": "CASE WHEN takes THEN n + 1 ELSE n END", "wm": "CASE WHEN takes THEN nwm ELSE wm END", "m2": "CASE WHEN takes THEN m2 + (x - wm) * (x - nwm) ELSE m2 END", "en": "CASE WHEN takes THEN en + 1 ELSE en END",
        "em": f"CASE WHEN NOT takes THEN em WHEN en = 0 THEN x ELSE em + (x - em) * {s.ewma_alpha}::DOUBLE END",
        "ev": f"CASE WHEN NOT takes OR en = 0 THEN ev ELSE {1 - s.ewma_alpha}::DOUBLE * (ev + (x - em) * ((x - em) * {s.ewma_alpha}::DOUBLE)) END",
        "pn": "npn", "pm": "npm", "up": "CASE WHEN wipe THEN 0 ELSE nup END", "lo": "CASE WHEN wipe THEN 0 ELSE nlo END", "dn": "CASE WHEN wipe THEN 0 ELSE ndn END", "hi": "CASE WHEN wipe THEN 0 ELSE nhi END",
        "sev": "nsev", "calm": "ncalm", "streak": "nstreak", "z": "nz", "found": "nfound", "fired": "nfired", "moved": "CASE WHEN NOT learning AND nsev <> sev THEN nsev END",
        "observed": "CASE WHEN learning THEN NULL WHEN rate THEN rt / rn ELSE x END", "expected": "CASE WHEN learning THEN NULL WHEN rate THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, wm)) ELSE em END",
    }
    zero = {c: "0.0::DOUBLE" for c in ("wm", "m2", "em", "ev", "pm", "up", "lo", "dn", "hi")} | {c: "0::BIGINT" for c in ("n", "en", "pn")} | {c: "0" for c in ("sev", "calm", "streak", "found")} | {"moved": "NULL::INTEGER", "fired": "NULL::VARCHAR"}
    first = ", ".join(f"{zero.get(c, 'NULL::DOUBLE')} AS {c}" for c in after)
    frame = f"(PARTITION BY agent_id, feature ORDER BY seq ROWS {cfg.window - 1} PRECEDING)"
    ms = "epoch_us(ts) // 1000"
    return f"""
    framed AS (
      SELECT *, row_number() OVER (PARTITION BY agent_id, feature ORDER BY seq) AS k, seq <= {cfg.warmup} AS learning, sum(x) OVER w AS rt, count(*) OVER w AS rn,
        regr_slope(x, seq) OVER w AS slope, regr_sxx(x, seq) OVER w AS sxx, regr_sxy(x, seq) OVER w AS sxy, regr_syy(x, seq) OVER w AS syy, (max({ms}) OVER w - min({ms}) OVER w)::DOUBLE AS span
      FROM n WINDOW w AS {frame}
    ), ringed AS (
      SELECT *, abs(slope) / greatest(sqrt(greatest(0, syy - slope * sxy) / nullif(rn - 2, 0) / nullif(sxx, 0)), 1e-12) AS trend_t, CASE WHEN span > 0 THEN slope * (rn - 1) * 3.6e6 / span ELSE 0 END AS hourly FROM framed
    ), judged AS (
      SELECT agent_id, feature, ord, 0::BIGINT AS k, {first} FROM (SELECT DISTINCT agent_id, feature, ord FROM ringed)
      UNION ALL
      SELECT agent_id, feature, ord, rk + 1, {', '.join(after.values())} FROM {stepped}
    ), numeric AS (
      SELECT j.*, g.seq, g.ts, g.x, g.rate, g.learning, g.slope, g.trend_t, g.hourly, g.rn, greatest(sqrt(j.ev), 0.25::DOUBLE * CASE WHEN j.n > 1 THEN sqrt(j.m2 / j.n) ELSE 0 END, 1e-9) AS spread,
        CASE WHEN z > 0 THEN 'above' WHEN z < 0 OR fired = 'down' THEN 'below' WHEN z IS NOT NULL THEN 'above' END AS direction,
        CASE WHEN found > 0 AND streak >= 2 THEN found WHEN fired IS NOT NULL AND found = 0 THEN 2 ELSE 0 END AS finding,
        greatest(CASE WHEN found > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, (abs(z) - 1) / ({s.critical_z}::DOUBLE - 1))) ELSE 0.0::DOUBLE END,
          CASE WHEN fired IS NOT NULL AND found = 0 THEN least(3.0::DOUBLE, ({s.warning_z}::DOUBLE - 1) / ({s.critical_z}::DOUBLE - 1)) ELSE 0.0::DOUBLE END) AS deviation
      FROM judged j JOIN ringed g ON g.agent_id = j.agent_id AND g.feature = j.feature AND g.k = j.k
    )"""


def mixes(cfg: Config) -> str:
    """CTE ``mixed`` over ``m`` (agent_id, seq, ts, feature, ord, category), one sample a turn."""
    s = cfg.sensitivity
    share = lambda c, of: f"({c}[i] / {of})"
    p, q = share("cs", "total"), share("qs", "size")
    part = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0 END"
    stepped = stacked(
        "(SELECT r.*, g.seq, g.ts, g.ring, g.idx, g.learning, g.many FROM (SELECT agent_id, feature, ord, k AS rk, counts, sev, calm, streak FROM mixing) r JOIN rings g ON g.agent_id = r.agent_id AND g.feature = r.feature AND g.k = r.rk + 1)",
        {"cs": "list_transform(counts, lambda c, i: c + CASE WHEN i = idx AND (learning OR sev = 0) THEN 1 ELSE 0 END)", "qs": "list_transform(range(1, many + 1), lambda i: len(list_filter(ring, lambda v: v = i))::DOUBLE)", "size": "len(ring)::DOUBLE"},
        {"total": "list_sum(cs)"},
        {"jsd": f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_sum(list_transform(range(1, many + 1), lambda i: 0.5::DOUBLE * ({part(p)} + {part(q)})))))", "kinds": "len(list_filter(range(1, many + 1), lambda i: cs[i] > 0 OR qs[i] > 0))"},
        {"far": "CASE WHEN NOT learning THEN greatest(0.0::DOUBLE, jsd - (kinds - 1) / (4 * greatest(1, size) * ln(2))) END"},
        {"nfound": f"CASE WHEN learning THEN 0 WHEN far >= {s.critical_jsd} THEN 3 WHEN far >= {s.warning_jsd} THEN 2 ELSE 0 END", "inside": f"coalesce(far < 0.7::DOUBLE * {s.warning_jsd}, false)"},
        *GATE,
    )
    text = "array_to_string(list_transform(list_sort(list_transform(list_distinct(g.ring), lambda v: {'less': -len(list_filter(g.ring, lambda w: w = v)), 'at': list_position(g.ring, v), 'v': v}))[1:3], lambda e: g.names[e.v] || ' ' || CAST(CAST(floor(-e.less::DOUBLE / len(g.ring) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'), ', ')"
    return f"""
    named AS (SELECT list_sort(list_distinct(list(category))) AS names FROM m),
    rings AS (
      SELECT *, list(idx) OVER (PARTITION BY agent_id, feature ORDER BY seq ROWS {cfg.window - 1} PRECEDING) AS ring
      FROM (SELECT m.*, seq <= {cfg.warmup} AS learning, row_number() OVER (PARTITION BY agent_id, feature ORDER BY seq) AS k, names, list_position(names, category) AS idx, len(names) AS many FROM m, named)
    ), mixing AS (
      SELECT agent_id, feature, ord, 0::BIGINT AS k, list_transform(names, lambda x: 0.0::DOUBLE) AS counts, 0 AS sev, 0 AS calm, 0 AS streak, NULL::DOUBLE AS z, 0 AS found, NULL::INTEGER AS moved
      FROM (SELECT DISTINCT agent_id, feature, ord, names FROM rings)
      UNION ALL
      SELECT agent_id, feature, ord, rk + 1, cs, nsev, ncalm, nstreak, far, nfound, CASE WHEN NOT learning AND nsev <> sev THEN nsev END FROM {stepped}
    ), mixed AS (
      SELECT j.*, g.seq, g.ts, g.learning, CASE WHEN found > 0 AND streak >= 2 THEN found ELSE 0 END AS finding,
        CASE WHEN found > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, (z - {s.warning_jsd / 2}::DOUBLE) / ({s.critical_jsd}::DOUBLE - {s.warning_jsd / 2}::DOUBLE))) ELSE 0.0::DOUBLE END AS deviation, {text} AS mix
      FROM mixing j JOIN rings g ON g.agent_id = j.agent_id AND g.feature = j.feature AND g.k = j.k
    )"""


def evaluated(turns: str, numeric: list[tuple[str, int, str]], rates: list[tuple[str, int, str]], categories: list[tuple[str, int, str]], cfg: Config) -> str:
    """``WITH RECURSIVE`` and CTEs up to ``ev``, one row per turn and feature. Features: (name, place, column of the turns)."""
    n = " UNION ALL ".join(f"SELECT agent_id, seq, ts, '{f}' AS feature, {i} AS ord, {rate} AS rate, ({c})::DOUBLE AS x FROM t WHERE ({c}) IS NOT NULL" for of, rate in ((numeric, "false"), (rates, "true")) for f, i, c in of)
    out = f"WITH RECURSIVE t AS ({turns}), n AS ({n}), {numbers(cfg)}"
    said = f"feature || ' is ' || direction || ' baseline: observed ' || {plain('observed')} || ' vs expected ' || {plain('expected')} || ' (z=' || {plain('z')} || ')' || CASE WHEN fired IS NOT NULL THEN ', sustained mean shift confirmed' ELSE '' END"
    ev = f"SELECT agent_id, seq, ts, feature, ord, learning, z, deviation, finding, direction, observed, expected, sev, moved, fired, CASE WHEN finding > 0 THEN {said} END AS summary FROM numeric"
    if categories:
        m = " UNION ALL ".join(f"SELECT agent_id, seq, ts, '{f}' AS feature, {i} AS ord, {c} AS category FROM t WHERE {c} IS NOT NULL" for f, i, c in categories)
        out += f", m AS ({m}), {mixes(cfg)}"
        ev += f" UNION ALL SELECT agent_id, seq, ts, feature, ord, learning, z, deviation, finding, CASE WHEN learning THEN NULL ELSE 'shifted' END, NULL, NULL, sev, moved, NULL, CASE WHEN finding > 0 THEN feature || ' distribution shifted (JSD=' || {plain('z')} || '); recent mix: ' || mix END FROM mixed"
    return f"{out}, ev AS ({ev})"


def reported(cfg: Config) -> str:
    """CTEs over ``ev``: ``shares`` (attributions), ``ahead`` (forecasts) and ``rep`` (reports)."""
    s = cfg.sensitivity
    way = "CASE WHEN slope > 0 THEN 'up' ELSE 'down' END"
    return f""", ranked AS (
      SELECT *, row_number() OVER (PARTITION BY agent_id, seq ORDER BY deviation DESC, ord) AS rank FROM ev WHERE deviation >= 0.25 OR finding > 0
    ), shares AS (
      SELECT agent_id, seq, rank, feature, floor(deviation * deviation / total * 10000 + 0.5) / 10000 AS contribution, CASE WHEN finding > 0 THEN z ELSE deviation END AS score, CASE WHEN finding > 0 THEN direction ELSE 'above' END AS direction,
        CASE WHEN finding > 0 THEN observed END AS observed, CASE WHEN finding > 0 THEN expected END AS expected,
        CASE WHEN finding > 0 THEN summary ELSE feature || ' deviates at ' || CAST(CAST(floor(deviation * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% of its critical threshold' END AS summary
      FROM (SELECT *, sum(deviation * deviation) OVER (PARTITION BY agent_id, seq) AS total FROM ranked WHERE rank <= 5) WHERE total > 0
    ), lines AS (
      SELECT *, CASE WHEN rate THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, em + sign(slope) * {s.critical_z} * spread)) ELSE em + sign(slope) * {s.critical_z} * spread END AS threshold
      FROM numeric WHERE NOT learning AND sev = 0 AND rn >= 8 AND slope <> 0 AND trend_t >= 4 AND hourly <> 0
    ), ahead AS (
      SELECT agent_id, seq, ts, feature, ord, slope, hourly, CAST(floor(steps + 0.5) AS BIGINT) AS steps, floor(hours * 100 + 0.5) / 100 AS hours,
        feature || ' is trending ' || {way} || ' and is projected to cross its critical threshold (' || {plain('threshold')} || ') in about ' || {plain('hours')} || ' h (' || CAST(CAST(floor(steps + 0.5) AS BIGINT) AS VARCHAR) || ' observations) if the trend continues' AS summary
      FROM (SELECT *, (threshold - x) / slope AS steps, (threshold - x) / hourly AS hours FROM lines WHERE threshold >= 0 AND CASE WHEN slope > 0 THEN x < threshold ELSE x > threshold END)
      WHERE steps >= 1 AND hours > 0 AND hours <= 24
    ), turns AS (
      SELECT agent_id, seq, max(ts) AS ts, sqrt(avg(deviation * deviation)) AS instant, max(finding) AS top, count(*) FILTER (finding > 0) AS n_findings FROM ev GROUP BY ALL
    ), smooth AS (
      SELECT agent_id, seq, 0.2::DOUBLE * instant AS idx FROM turns WHERE seq = 1
      UNION ALL SELECT u.agent_id, u.seq, s.idx + 0.2::DOUBLE * (u.instant - s.idx) FROM smooth s JOIN turns u ON u.agent_id = s.agent_id AND u.seq = s.seq + 1
    ), why AS (SELECT agent_id, seq, list(summary ORDER BY rank) AS reasons, first(feature ORDER BY rank) AS lead FROM shares GROUP BY ALL
    ), seen AS (SELECT agent_id, seq, list(feature ORDER BY ord) AS names, list(summary ORDER BY ord) AS texts FROM ahead GROUP BY ALL
    ), rep AS (
      SELECT u.*, CASE WHEN u.seq <= {cfg.warmup} THEN 'learning' ELSE 'ready' END AS status, {NAMED.format('top')} AS severity, CAST(floor(100 * exp(-idx) + 0.5) AS INTEGER) AS behavior_score,
        coalesce(reasons, []) AS reasons, coalesce(lead, '') AS lead, coalesce(names, []) AS names, coalesce(texts, []) AS texts,
        coalesce(lag(top) OVER b, 0) AS top_before, coalesce(lag(names) OVER b, []) AS known
      FROM turns u JOIN smooth USING (agent_id, seq) LEFT JOIN why USING (agent_id, seq) LEFT JOIN seen USING (agent_id, seq) WINDOW b AS (PARTITION BY u.agent_id ORDER BY u.seq)
    )"""


def alerted(policy: AlertPolicy) -> str:
    """CTEs over ``rep``: ``cand`` (alerts) and ``gov`` (alerts decided on)."""
    score = "'Behavior score ' || behavior_score || '/100.'"
    least = SEVERITIES.index(policy.min_severity)
    return f""", fresh AS (SELECT *, list_filter(names, lambda f: NOT list_contains(known, f)) AS news FROM rep), raised AS (
      SELECT *, 0 AS pos, 'drift' AS kind, top AS level, 'Behavioral drift detected: ' || agent_id AS title, {score} || CASE WHEN len(reasons) > 0 THEN ' ' || array_to_string(reasons[1:3], ' | ') ELSE '' END AS message FROM fresh WHERE top > 0
      UNION ALL SELECT *, 1, 'recovery', 1, 'Behavior recovered: ' || agent_id, 'Agent "' || agent_id || '" returned to its learned baseline (behavior score ' || behavior_score || '/100).' FROM fresh WHERE top = 0 AND top_before > 0
      UNION ALL SELECT *, 2, 'forecast', 2, 'Behavioral trend warning: ' || agent_id, array_to_string(texts, ' | ') FROM fresh WHERE len(news) > 0
    ), cand AS (
      SELECT *, agent_id || '-' || kind || '-' || (epoch_us(ts) // 1000) || '-' || row_number() OVER (PARTITION BY agent_id ORDER BY seq, pos) AS alert_id, epoch_us(ts) // 1000 AS ms,
        row_number() OVER (PARTITION BY agent_id, kind, lead ORDER BY seq, pos) AS j FROM raised
    ), walk AS (
      SELECT agent_id, kind, lead, 0::BIGINT AS j, NULL::BIGINT AS last_ms, NULL::INTEGER AS last_level, NULL::VARCHAR AS reason FROM (SELECT DISTINCT agent_id, kind, lead FROM cand)
      UNION ALL
      SELECT agent_id, kind, lead, j, CASE WHEN held IS NULL THEN ms ELSE last_ms END, CASE WHEN held IS NULL THEN level ELSE last_level END, held FROM (
        SELECT c.agent_id, c.kind, c.lead, c.j, c.ms, c.level, w.last_ms, w.last_level,
          CASE WHEN c.kind = 'drift' AND c.level < {least} THEN 'below-min-severity' WHEN w.last_ms IS NOT NULL AND c.ms - w.last_ms < {policy.cooldown_ms} AND c.level <= w.last_level THEN 'cooldown' END AS held
        FROM walk w JOIN cand c ON c.agent_id = w.agent_id AND c.kind = w.kind AND c.lead = w.lead AND c.j = w.j + 1)
    ), gov AS (SELECT c.*, w.reason IS NULL AS allowed, w.reason, {NAMED.format('c.level')} AS named FROM cand c JOIN walk w ON w.agent_id = c.agent_id AND w.kind = c.kind AND w.lead = c.lead AND w.j = c.j)"""


LOG = """
SELECT agent_id, seq, 0 AS event_ord, 'agent.registered' AS kind, NULL::VARCHAR AS feature, NULL::VARCHAR AS severity, NULL::VARCHAR AS message FROM rep WHERE seq = 1
UNION ALL SELECT agent_id, seq, 1, 'observation.recorded', NULL, NULL, NULL FROM rep
UNION ALL SELECT agent_id, seq, 2, 'baseline.' || status, NULL, NULL, NULL FROM (SELECT *, lag(status) OVER (PARTITION BY agent_id ORDER BY seq) AS before FROM rep) WHERE status = 'learning' OR coalesce(before, 'learning') = 'learning'
UNION ALL SELECT agent_id, seq, CAST(2 * pos + e AS INTEGER), CASE e WHEN 3 THEN 'drift.detected' ELSE 'baseline.frozen' END, feature, CASE e WHEN 3 THEN CASE finding WHEN 3 THEN 'critical' ELSE 'warning' END END, NULL
  FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, seq ORDER BY ord) - 1 AS pos FROM ev WHERE finding > 0), (VALUES (3), (4)) AS v(e) WHERE e = 3 OR finding = 3
UNION ALL SELECT agent_id, seq, 100, 'drift.recovered', NULL, NULL, NULL FROM rep WHERE top = 0 AND top_before > 0
UNION ALL SELECT agent_id, seq, CAST(200 + pos AS INTEGER), 'forecast.detected', news[pos + 1], NULL, NULL FROM (SELECT agent_id, seq, news, unnest(range(0, len(news))) AS pos FROM fresh)
UNION ALL SELECT agent_id, seq, pos * 100 + 101, 'alert.suppressed', NULL, named, reason FROM gov WHERE NOT allowed
"""
