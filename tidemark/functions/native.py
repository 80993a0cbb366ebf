"""Statistics as columns, for where no gate decides what is learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tracks import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, P2, TAIL


def moments(x: str) -> list[Column]:
    """Count, mean, population deviation and range of a group."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std_dev"), F.min(x).alias("low"), F.max(x).alias("high")]


def ewma(values: Column, alpha: float) -> Column:
    """Mean and variance after all values of an array, as a fold."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("variance"))

    def step(acc, x):
        gap = x - acc["mean"]
        move = gap * alpha
        first = acc["n"] == 0
        return F.struct((acc["n"] + 1).alias("n"), F.when(first, x).otherwise(acc["mean"] + move).alias("mean"), F.when(first, F.lit(0.0)).otherwise((acc["variance"] + gap * move) * (1 - alpha)).alias("variance"))

    return F.aggregate(values, start, step)


def ewma_running(rows: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """The average and deviation after every value: (keys, order columns, ``mean``, ``std_dev``), streamed in order."""
    from ..operators.keyed import fold_by_key
    from .tracks import Ewma

    def make(*_):
        e = Ewma(alpha)

        def step(row):
            e.push(row[value])
            yield {**row, "mean": e.mean, "std_dev": e.std}

        return step

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, *order))
    return fold_by_key(rows.filter(F.col(value).isNotNull()).select(*keys, *order, value), keys, order, make, f"{types}, mean double, std_dev double")


def divergence(p: str = "p", q: str = "q") -> Column:
    """Jensen-Shannon divergence in bits, as a sum over the rows of a full join of two distributions."""
    a, b = F.coalesce(F.col(p), F.lit(0.0)), F.coalesce(F.col(q), F.lit(0.0))
    m = (a + b) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum((part(a) + part(b)) / 2)))


def log_choose(n: Column, k: Column) -> Column:
    """log of n over k, for k >= 0, as a sum of logarithms."""
    return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda acc, i: acc + F.log(((n - k + i) / i).cast("double")))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of a binomial X. The terms from k away from the mean are summed relative to the first, each from the one
    before by their ratio: upwards for k above the mean, else downwards from k - 1, and what is left of 1."""
    up = k > n * p
    at = F.when(up, k).otherwise(k - 1).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def summed(steps, ratio):
        def step(acc, i):
            term = acc["term"] * ratio(i)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        return F.aggregate(steps, start, step, lambda acc: acc["total"])

    none = F.array().cast("array<int>")
    odds = p / (1 - p)
    above = summed(F.when(up & (at < n), F.sequence(at, (n - 1).cast("int"))).otherwise(none), lambda i: (n - i) / (i + 1) * odds)
    below = summed(F.when(~up & (at > 0), F.sequence(at, F.lit(1), F.lit(-1))).otherwise(none), lambda i: i / (n - i + 1) / odds)
    first = F.exp(log_choose(n, at) + at * F.log(p) + (n - at) * F.log(1 - p))
    total = F.when(up, first * above).otherwise(1 - first * below)
    return F.when((k <= 0) | ((p >= 1) & (k <= n)), F.lit(1.0)).when((k > n) | (p <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def polynomial(coefficients, x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(c)
    return out


def inverse_normal(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-300)), F.lit(1 - 1e-16))
    q = p - 0.5
    middle = polynomial(ACKLAM_A, q * q) * q / polynomial((*ACKLAM_B, 1.0), q * q)
    t = F.sqrt(F.log(F.least(p, 1 - p)) * -2)
    tail = polynomial(ACKLAM_C, t) / polynomial((*ACKLAM_D, 1.0), t)
    return F.when((p >= TAIL) & (p <= 1 - TAIL), middle).when(p < 0.5, tail).otherwise(-tail)


def rate_z(count: Column, n: Column, rate: Column) -> Column:
    k = F.ceil(count - 1e-9)
    # bound to a name, so that the tail is worked out once
    z = F.transform(F.array(binomial_tail(k, n, rate)), lambda tail: F.when(tail >= 0.5, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), -inverse_normal(tail))))
    return F.when((k <= 0) | (count <= n * rate), F.lit(0.0)).otherwise(F.element_at(z, 1))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def co_moment(pairs: Column) -> Column:
    """Sum of the products about the means of an array of (``i``, ``x``), with the digits of regr_slope, which adds each product
    to the sum with one rounding."""
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "i", "x", "sum")))

    def step(acc, p):
        n, ahead = acc["n"] + 1, p["i"] - acc["i"]
        mean = acc["x"] + (p["x"] - acc["x"]) / n
        return F.struct(n.alias("n"), (acc["i"] + ahead / n).alias("i"), mean.alias("x"), fused(ahead, p["x"] - mean, acc["sum"]).alias("sum"))

    return F.aggregate(pairs, start, step, lambda acc: acc["sum"])


def line(points: DataFrame, keys: list[str], order: list[str], value: str, millis: str, width: int) -> DataFrame:
    """The least-squares line over each row's last ``width`` values: (``slope``, ``t``, ``next_value``, ``slope_hour``).
    Sums over a ROWS frame; that of products is a fold of the frame's values, for its digits."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(1 - width, 0)
    rows = points.withColumn("__i", F.row_number().over(w).cast("double"))
    # sums of products about the means of the frame, so a long history costs no digits
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).cast("double").alias("x")))
    found = {"__n": F.count(value), "__pairs": F.collect_list(pair), "__sxx": F.var_pop("__i"), "__var": F.var_pop(value), "__mean": F.avg(value), "__late": F.max(millis), "__early": F.min(millis)}
    rows = rows.withColumns({name: c.over(frame) for name, c in found.items()}).withColumn("__n", F.col("__n").cast("double")).filter("__n >= 3")
    n = F.col("__n")
    rows = rows.withColumn("__cov", co_moment(F.col("__pairs")) / n)
    rows = rows.withColumn("slope", F.col("__cov") / F.col("__sxx"))
    rows = rows.withColumns({"__sxx": n * (n * n - 1) / 12, "__sxy": F.col("__cov") * n, "__syy": F.col("__var") * n})
    N, span = F.col("__n"), (F.col("__late") - F.col("__early")).cast("double")
    rows = rows.withColumn("__span", span)
    rss = F.greatest(F.lit(0.0), F.col("__syy") - F.col("slope") * F.col("__sxy"))
    rows = rows.withColumn("t", F.abs("slope") / F.greatest(F.sqrt(rss / (N - 2) / F.col("__sxx")), F.lit(1e-12)))
    rows = rows.withColumn("next_value", F.col("__mean") + F.col("slope") * (N + 1) / 2)
    rows = rows.withColumn("slope_hour", F.when(F.col("__span") > 0, F.col("slope") * (N - 1) * 3.6e6 / F.col("__span")).otherwise(F.lit(0.0)))
    return rows.drop(*(c for c in rows.columns if c.startswith("__")))


def p2_quantiles(rows: DataFrame, key: str, order: list[str], value: str, ps=(0.5, 0.95, 0.99)) -> DataFrame:
    """P-square estimates per key: (key, ``n``, ``p50``, ``p95``, ``p99``), streamed in order."""
    from ..operators.keyed import fold_by_key

    ends = rows.groupBy(key).agg(F.count(value).alias("__total"))
    both = rows.select(key, *order, value).join(ends, key)

    def make(k):
        tracks = [P2(p) for p in ps]

        def step(row):
            for t in tracks:
                t.push(row[value])
            if tracks[0].n == row["__total"]:
                yield {key: k, "n": tracks[0].n, **{f"p{round(p * 100)}": t.value for p, t in zip(ps, tracks, strict=True)}}

        return step

    return fold_by_key(both, [key], order, make, f"{key} {rows.schema[key].dataType.simpleString()}, n long, p50 double, p95 double, p99 double")


def shift_fires(rows: DataFrame, key: str, order: list[str], value: str, delta: float, limit: float) -> DataFrame:
    """Where a Page-Hinkley test of the standardised values fires: (key, order columns, ``shift``)."""
    from ..operators.keyed import fold_by_key
    from .tracks import Shift

    stats = rows.groupBy(key).agg(F.avg(value).alias("__m"), F.greatest(F.stddev_pop(value), F.lit(1e-9)).alias("__s"))
    both = rows.select(key, *order, value).join(stats, key)

    def make(_):
        test = Shift(delta, limit)

        def step(row):
            fired = test.push((row[value] - row["__m"]) / row["__s"])
            if fired:
                test.reset()
                yield {**row, "shift": fired}

        return step

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *order))
    return fold_by_key(both, [key], order, make, f"{types}, shift string")
