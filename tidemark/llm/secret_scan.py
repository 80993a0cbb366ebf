"""Secret scans with patterns and character Markov models, with DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in order, with pattern, group of the value, and least length of the value.
BASE = (
    ("assign", r"""(?=[pPsStTaA])(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
)
#: What the model judges: runs of characters that keys are made of.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"
SHORTEST = 12
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def with_spans(rows: DataFrame, name: str, pattern: str, at: int, kind: str, group: int = 0, least: int = 0) -> DataFrame:
    """``rows`` (with ``text``) and a column of leftmost non-overlapping matches: array of (start, at, kind, end, value).

    Between two matches lies a piece of the split text, so the starts are sums of lengths, in code points. Each step is
    a column of its own, so no pattern runs more often than once to find and, where something is found, once to split.
    """
    some = F.size("__found") > 0
    rows = rows.withColumn("__found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else F.col("__found")
    rows = rows.withColumn("__values", F.when(some, values)).withColumn("__pieces", F.when(some, F.transform(F.split("text", pattern, -1), F.length)))
    begin = F.aggregate(
        F.zip_with(F.slice("__pieces", F.lit(1), F.size("__found")), F.transform("__found", F.length), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    rows = rows.withColumn("__starts", F.when(some, begin))
    zipped = F.arrays_zip(F.col("__starts").alias("s"), F.transform("__found", F.length).alias("n"), F.col("__values").alias("v"))
    made = F.transform(zipped, lambda x: F.struct(x["s"].alias("start"), F.lit(at).alias("at"), F.lit(kind).alias("kind"), (x["s"] + x["n"]).alias("end"), x["v"].alias("value")))
    none = F.array().cast("array<struct<start:int,at:int,kind:string,end:int,value:string>>")
    found = F.coalesce(F.when(some, F.filter(made, lambda r: F.length(r["value"]) >= least)), none)
    return rows.withColumn(name, found).drop("__found", "__values", "__pieces", "__starts")


def listed(found: Column) -> Column:
    """kind:start:end, by start, then by kind as listed, joined by commas."""
    return F.array_join(F.transform(found, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of each pair of characters, random strings against ordinary identifiers, and the total of a
    string above which it counts as random; so a short string needs a higher mean than a long one."""

    ratios: tuple[float, ...]
    threshold: float

    def score(self, text: Column) -> Column:
        """The total ratio over the pairs of a string; null if it has none."""
        size = len(ALPHABET)
        where = "array(" + ",".join(str(ALPHABET.find(chr(i))) for i in range(128)) + ")"
        table = "array(" + ",".join(f"{r:.4f}D" for r in self.ratios) + ")"
        at, ratios = F.expr(where), F.expr(table)
        code = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.element_at(at, F.least(F.ascii(c), F.lit(127)) + 1))
        pairs = F.filter(F.zip_with(F.slice(code, 1, F.size(code) - 1), F.slice(code, 2, F.size(code)), lambda a, b: F.when((a >= 0) & (b >= 0), a * size + b)), lambda p: p.isNotNull())
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.element_at(ratios, p + 1))
        return F.when(F.size(pairs) > 0, total)


def random_strings(spark: SparkSession, number: int) -> DataFrame:
    """(``text``, ``weight``): strings like keys, made from a hash of their number: hexadecimal, base 64 and base 32."""
    n = spark.range(number)
    digest = F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    plain = F.regexp_replace(base64, "[+/]", "")
    capital = F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))
    return n.select(F.element_at(F.array(digest, base64, plain, capital), (F.col("id") % 4 + 1).cast("int")).alias("text"))


def pair_counts(strings: DataFrame) -> dict[str, int]:
    """How often each pair of characters of the alphabet occurs: at most the square of the alphabet's size."""
    line = strings.filter(F.length("text") > 1).select("text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"))
    pairs = line.select(F.substring("text", F.col("i"), F.lit(2)).alias("pair")).filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def ordinary_strings(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(``text``): words of the ``sample_docs`` documents whose ids hash lowest, and identifiers made of them in the usual styles
    (snake_case, kebab-case, camelCase, CONSTANTS, numbered). Words within matches of the base patterns are left out. The
    sample is chosen by ids alone; its texts are never shuffled."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    text = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    for _, pattern, _, _ in BASE:
        text = text.select(F.regexp_replace("text", pattern, " ").alias("text"))
    words = text.select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    two = words.select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.struct(F.lower(a).alias("a"), F.lower(b).alias("b")))).alias("p"))
    a, b = F.col("p.a"), F.coalesce("p.b", F.lit("x"))
    styles = F.array(a, F.concat(a, F.lit("_"), b), F.concat(a, F.lit("-"), b), F.concat(a, F.initcap(b)), F.upper(F.concat(a, F.lit("_"), b)), F.concat(a, F.lit("_"), F.length(b).cast("string"), F.lit("/"), b), F.concat(F.initcap(a), F.lit("="), b))
    return two.select(F.explode(styles).alias("text"))


def train(docs: DataFrame, sample_docs: int = 1000, random_samples: int = 4000, false_alarms: float = 0.0005, least: float = 8.0) -> Model:
    """Markov chains of order 1 of two labelled samples, of bounded size: ``random_samples`` made strings, labelled random,
    and the ``ordinary_strings`` of ``sample_docs`` documents. Four fifths of the ordinary strings train their chain; the rest
    set the threshold: the total ratio that a share of ``false_alarms`` of those long enough to be judged exceeds, but no
    less than ``least``."""
    strings = ordinary_strings(docs, sample_docs)
    kept_out = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    ordinary = pair_counts(strings.filter(~kept_out))
    random = pair_counts(random_strings(docs.sparkSession, random_samples))

    def chain(counts: dict[str, int]) -> dict[str, float]:
        out, after = {}, {c: sum(counts.get(c + d, 0) for d in ALPHABET) for c in ALPHABET}
        for c in ALPHABET:
            for d in ALPHABET:
                out[c + d] = math.log((counts.get(c + d, 0) + 0.5) / (after[c] + 0.5 * len(ALPHABET)))
        return out

    p, q = chain(random), chain(ordinary)
    model = Model(tuple(p[c + d] - q[c + d] for c in ALPHABET for d in ALPHABET), least)
    judged = strings.filter(kept_out & (F.length("text") >= SHORTEST)).select(model.score(F.col("text")).alias("total"))
    found = judged.agg(F.percentile_approx("total", 1 - false_alarms, 10_000).alias("limit")).first()["limit"]
    return replace(model, threshold=max(least, found if found is not None else least))


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Secrets of every whole text: (``doc_id``, ``base``, ``found``), arrays of (start, at, kind, end, value).

    ``base`` has the matches of the base patterns, by start, then kind. ``found`` adds, as kind ``model``, runs of
    ``SHORTEST`` or more key characters that overlap no base match and whose log-likelihood ratio under ``model`` (else one
    trained on ``docs``) is above its threshold.

    One pass without a shuffle. Null text: as empty, no spans. Null ids and repeated rows: one result each. Very long
    texts: whole. Empty table: empty result. Other columns are not read.
    """
    model = model or train(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for i, (kind, pattern, group, least) in enumerate(BASE):
        rows = with_spans(rows, kind, pattern, i, kind, group, least)
    rows = with_spans(rows, "more", CANDIDATE, len(BASE), "model").withColumn("base", F.sort_array(F.concat(*(kind for kind, *_ in BASE))))
    apart = lambda r: ~F.exists("base", lambda o: (o["start"] < r["end"]) & (r["start"] < o["end"]))
    judged = F.filter("more", lambda r: apart(r) & F.coalesce(model.score(r["value"]) > model.threshold, F.lit(False)))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", judged)).alias("found"))


def op6_markov_secrets(spark, sf_dir):
    from .common import table

    out = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda r: r["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
