"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOKEN = re.compile(r"[^\W\d_]+")
GRADES = 4
#: Lengths of the beginnings of words that are features.
STEMS = (5, 7)


def features(text: str | None) -> set[str]:
    """The distinct words of a text, in lower case, and the beginnings of longer ones, so that inflected forms count."""
    words = set(TOKEN.findall((text or "").lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigmoid(score - thresholds[k]) with one weight per word for all thresholds, which are in order."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, words: set[str]) -> float:
        return sum(self.weights[w] for w in sorted(self.weights.keys() & words))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and k."""
        return sigmoid(scores[:, None] - np.array(self.thresholds)[None, :])


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_columns: int, penalty: float = 0.2, rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on the full sample. ``rows`` and ``columns``: the
    places of the ones in the matrix of features."""
    n, k = len(grades), GRADES - 1
    share = [max(1e-3, min(1 - 1e-3, float((grades > j).mean()) if n else 1e-3)) for j in range(k)]
    start = np.maximum.accumulate(np.array([-np.log(s / (1 - s)) for s in share]) + 0.05 * np.arange(k))
    steps = np.log(np.maximum(np.diff(start), 0.05))
    x = np.r_[np.zeros(n_columns), start[0], steps]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        w, theta = x[:n_columns], x[n_columns] + np.r_[0, np.cumsum(np.exp(x[n_columns + 1 :]))]
        s = np.bincount(rows, w[columns], n) if len(rows) else np.zeros(n)
        up = np.r_[theta, np.inf][grades]
        low = np.r_[-np.inf, theta][grades]
        pu, pl = sigmoid(up - s), sigmoid(low - s)
        p = np.maximum(pu - pl, 1e-12)
        du, dl = pu * (1 - pu), pl * (1 - pl)
        ds = (du - dl) / p  # of the negative log-likelihood by the score
        g = np.zeros_like(x)
        g[:n_columns] = (np.bincount(columns, ds[rows], n_columns) if len(rows) else 0) + penalty * w
        dt = np.array([(-(du / p))[grades == j].sum() + (dl / p)[grades == j + 1].sum() for j in range(k)])
        g[n_columns] = dt.sum()
        for j in range(1, k):
            g[n_columns + j] = dt[j:].sum() * np.exp(x[n_columns + j])
        g /= max(n, 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:n_columns], x[n_columns] + np.r_[0, np.cumsum(np.exp(x[n_columns + 1 :]))]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, vocabulary: int = 2000, least_documents: int = 3) -> Ordinal:
    """A model of at most ``per_class`` labelled documents of either class, those whose ids hash lowest.

    Severity grades come from the labels and the sample: 0 for documents labelled clean; toxic ones get 1, 2 or 3 by how
    many distinct markers they hold (up to one, two, more), a marker being a feature whose share of toxic documents is
    at least eight times its share of clean ones. Features are kept by chi-square, at most ``vocabulary``. The
    sample is chosen by ids alone and its bound is what limits the driver's work; without toxic rows nothing is toxic.
    ``docs`` is read once for it: the features of the sample are written to the checkpoint folder.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda c: marks.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def words(batches):
        for batch in batches:
            sets = [sorted(features(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = sample.mapInArrow(words, f"doc_id {kind}, toxic int, words array<string>")
    # of rows that share an id one, the same one each time; written, as what follows reads the sample three times
    listed = cut(listed.groupBy("doc_id").agg(F.min(F.struct("toxic", "words")).alias("row")).select("doc_id", "row.*"))
    sizes = {r["toxic"]: r["n"] for r in listed.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not toxic:
        return Ordinal({}, (30.0, 31.0, 32.0))
    counts = listed.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).filter(F.col("n") >= least_documents)
    good, bad, n = F.col("n") - F.col("bad"), F.col("bad"), F.lit(float(clean + toxic))
    cross = bad * (clean - good) - good * (toxic - bad)
    chi = n * cross.cast("double") * cross / (F.lit(float(max(clean, 1)) * toxic) * F.col("n") * F.greatest(n - F.col("n"), F.lit(1.0)))
    best = counts.withColumn("chi", chi).filter("chi > 15").orderBy(F.desc("chi"), "word").limit(vocabulary).collect()
    names = {r["word"]: i for i, r in enumerate(best)}
    markers = {r["word"] for r in best if r["bad"] * (clean + 1) >= 8 * (r["n"] - r["bad"] + 1) * toxic}

    def places(batches):
        for batch in batches:
            held = [[names[w] for w in ws if w in names] for ws in batch.column(1).to_pylist()]
            found = [sum(w in markers for w in ws) for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array(held, pa.list_(pa.int32()))], names=["toxic", "markers", "at"])

    data = sorted(tuple(r) for r in listed.select("toxic", "words").mapInArrow(places, "toxic int, markers int, at array<int>").collect())
    grades = np.array([0 if not t else 1 + min(2, max(0, m - 1)) for t, m, _ in data], np.int64)
    rows = np.repeat(np.arange(len(data)), [len(a) for _, _, a in data])
    columns = np.array([i for _, _, a in data for i in a], np.int64)
    weights, thresholds = fit(rows, columns, grades, len(names))
    return Ordinal({w: float(weights[i]) for w, i in names.items()}, tuple(float(t) for t in thresholds))


def judge(docs: DataFrame, model: Ordinal, keep_columns: bool = False, cutoff: float = 0.5) -> DataFrame:
    """Severity of whole texts: (``doc_id``, ``expected_severity`` 0 to 3, ``grade`` the likeliest, ``p_toxic``, ``toxic``).

    Expected severity is the sum of P(grade > k). A document is toxic if P(grade > 0) is at least ``cutoff``. With
    ``keep_columns`` the rows of ``docs`` that aren't toxic come instead, with their own columns, whatever their names.

    A document is judged where it is, no shuffle. Null and empty texts: score 0. Null ids, repeated rows: one result
    each. Very long texts: whole; as a word counts once, length alone doesn't make one toxic. Empty table: empty result.
    """
    at = docs.columns.index("text")

    def scores(batch):
        return model.above(np.array([model.score(features(t.as_py())) for t in batch.column(at)], float))

    if keep_columns:

        def stay(batches):
            for batch in batches:
                yield batch.filter(pa.array(scores(batch)[:, 0] < cutoff))

        return docs.mapInArrow(stay, docs.schema)
    at = 1

    def run(batches):
        for batch in batches:
            above = scores(batch)
            each = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= cutoff)], names=["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean")


def op9_ordinal_toxicity(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
