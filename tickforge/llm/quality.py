"""Document quality by Bradley-Terry ranking.

Preference pairs are a document labelled good and one labelled bad. A linear score is learned by logistic loss on the
differences of their features, in the manner of Bradley and Terry, and documents are accepted from a quantile of the
scores on: the share of bad labels. Features are counts over the whole text, as is and as steps between quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, texts_of

#: Labelled rows of each class that the ranking is learned from at most, pairs for each row, and the accepted score.
SAMPLE, PAIRS, ACCEPT = 8_000, 6, 0.3
NAMES = ("words", "chars_per_word", "distinct_words", "repeated_next", "repeated_lines", "bare_signs", "signs", "sign_ends", "capitals", "digits", "exclamations", "spaces", "lines", "stops", "commas", "short_words", "top_word", "foreign_bytes", "long_words", "distinct_pairs")
KNOTS = 6

_SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"!?-:;()")
_CAPITALS, _DIGITS, _HIGH, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256)), b" \t\n\r\x0b\x0c"


def features(text: bytes) -> list[float]:
    """Shares and logarithms of counts over the text, one for each of NAMES; zeros where there is nothing to count."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [0.0] * len(NAMES)
    gone = lambda kind: n - len(text.translate(None, kind))
    lines = [x for x in text.split(b"\n") if x]
    distinct = set(words)
    counts: dict[int, int] = {}
    for s in map(len, words):
        counts[s] = counts.get(s, 0) + 1
    signs = gone(_SIGNS)
    bare = m - len(text.translate(None, _SIGNS).split())  # words of signs alone
    repeats = sum(map(eq, words, words[1:]))
    half = max(1, m - 1)
    return [
        math.log1p(m), n / m / 10, len(distinct) / m, repeats / half, 1 - len(set(lines)) / len(lines), bare / m, signs / n, signs / m,
        gone(_CAPITALS) / n, gone(_DIGITS) / n, text.count(b"!") / m, gone(_SPACE) / n, len(lines) / m, text.count(b".") / m, text.count(b",") / m,
        sum(c for s, c in counts.items() if s <= 3) / m, max(counts.values()) / m, gone(_HIGH) / n, sum(c for s, c in counts.items() if s >= 15) / m, len(set(zip(words, words[1:]))) / half,
    ]


@dataclass
class Ranking:
    """A learned score: knots of the steps, weights, the accepting threshold and the scale of the logistic map."""

    knots: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(x)
        steps = np.clip((x[:, :, None] - self.knots[None, :, :-1]) / np.maximum(1e-9, np.diff(self.knots, axis=1))[None], 0, 1)
        return np.concatenate([x, steps.reshape(len(x), -1)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((self.expand(x) - self.mean) / self.deviation) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ACCEPT at the threshold."""
        z = np.clip(self.scale * (self.raw(x) - self.threshold) + math.log(ACCEPT / (1 - ACCEPT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def learn(good: np.ndarray, bad: np.ndarray, bad_share: float, pairs: int = PAIRS, penalty: float = 1e-3, rounds: int = 40, seed: int = 7) -> Ranking:
    """Minimises the mean logistic loss of -w.(good - bad) over random pairs by Newton steps. bad_share: of all labels."""
    every = np.concatenate([good, bad]) if len(good) + len(bad) else np.zeros((1, len(NAMES)))
    knots = np.quantile(every, np.linspace(0.02, 0.98, KNOTS + 1), axis=0).T
    r = Ranking(knots, np.zeros(1), np.ones(1), np.zeros(1))
    wide = r.expand(every)
    r.mean, r.deviation = wide.mean(0), np.maximum(wide.std(0), 1e-6)
    r.weights = np.zeros(wide.shape[1])
    if not len(good) or not len(bad):
        r.threshold = -1.0 if len(good) or not len(bad) else 1.0  # one class alone: every document is of it
        return r
    rng = np.random.default_rng(seed)
    g, b = (r.expand(x) for x in (good, bad))
    n = pairs * max(len(g), len(b))
    d = (g[rng.integers(0, len(g), n)] - b[rng.integers(0, len(b), n)]) / r.deviation
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ r.weights, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(d.shape[1]), d.T @ p / n - penalty * r.weights)
        r.weights = r.weights + step * min(1.0, 5 / (1e-9 + float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-4:
            break
    s = np.concatenate([r.raw(good), r.raw(bad)])
    weight = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(s, kind="stable")
    k = int(np.searchsorted(np.cumsum(weight[order]), bad_share))
    lo, hi = s[order][min(k, len(s) - 1)], s[order][min(k + 1, len(s) - 1)]
    r.threshold, r.scale = float(lo + hi) / 2, 1.0
    return r


def feature_table(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns keep and x (array<double>): the features of text (null: empty)."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "x array<double>"])

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([features(t or b"") for t in texts_of(b.column(len(keep)))], pa.list_(pa.float64()))], names=[*keep, "x"])

    return map_batches(df.select(*keep, F.col("text").cast("string").alias("text")), fn, schema)


def train(docs: DataFrame, labels: DataFrame, learns: Column, sample: int = SAMPLE) -> Ranking:
    """Learns from documents (doc_id, text) with a label (doc_id, quality) whose doc_id `learns` accepts: the weights from at most
    `sample` rows of each class by a hash of their id, the threshold from the scores of all of them. Null labels are left
    out; of several labels of a document the largest counts, and of several texts of one doc_id the least."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learns).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    shares = {r["good"]: r["n"] for r in marked.groupBy((F.col("quality") >= 1).alias("good")).agg(F.count("*").alias("n")).collect()}
    chosen = None
    for good in (True, False):
        part = marked.filter((F.col("quality") >= 1) == F.lit(good)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    met = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))  # at most 2 * sample rows
    got = feature_table(met.select("quality", "text", "doc_id"), ("quality", "doc_id")).toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist(), "f8").reshape(-1, len(NAMES))
    q = got["quality"].to_numpy() >= 1
    bad = shares.get(False, 0) / max(1, sum(shares.values()))
    ranking = learn(x[q], x[~q], bad)
    if shares.get(True) and shares.get(False):
        ranking.threshold = accepting(docs, marked, ranking, bad)
    return ranking


def accepting(docs: DataFrame, marked: DataFrame, ranking: Ranking, bad: float) -> float:
    """The score below which there is the share `bad` of all marked documents' scores: in the middle of the two scores there."""
    spark = docs.sparkSession
    own, at = materialize(raw_scores(docs, ranking).join(marked.select("doc_id"), "doc_id", "left_semi").select("raw"), "raw")
    cut = own.agg(F.percentile_approx("raw", F.lit(bad), F.lit(100_000)).alias("cut")).first()["cut"]
    lo, hi = own.agg(F.max(F.when(F.col("raw") <= cut, F.col("raw"))), F.min(F.when(F.col("raw") > cut, F.col("raw")))).first() if cut is not None else (None, None)
    discard(spark, at)
    return ranking.threshold if lo is None else lo if hi is None else (lo + hi) / 2


def raw_scores(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, raw): the ranking's score of each whole text before the threshold."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t or b"") for t in texts_of(b.column(1))], "f8").reshape(-1, len(NAMES))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ranking.raw(x) if len(x) else np.zeros(0))], names=["doc_id", "raw"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), fn, f"doc_id {kind}, raw double")


def score(docs: DataFrame, ranking: Ranking, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, score (0 to 1) and predicted (1 if score >= ACCEPT, else 0) of each whole text. Null and empty
    texts have zeros for features and are scored like any other; repeated rows give repeated results."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, predicted int"])

    sent = [F.col(c) for c in keep] + ([] if "text" in keep else [F.col("text").cast("string").alias("\x00text")])
    at, name = (keep.index("text"), "text") if "text" in keep else (len(keep), "\x00text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t or b"") for t in texts_of(b.column(at))], "f8").reshape(-1, len(NAMES))
        s = ranking.score(x) if len(x) else np.zeros(0)
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= ACCEPT).astype("i4"))], names=[*keep, "score", "predicted"])

    return map_batches(docs.select(*sent), fn, schema, name)
