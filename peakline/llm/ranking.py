"""A quality classifier by Bradley-Terry ranking.

Every labelled pair (a better, a worse document) says that the first should score higher; its chance is the logistic function of the
score difference, and scores are linear in the features of a text. Fitting is a logistic regression on feature differences without a constant.
The threshold is a quantile of the scores: the share of the worse label among the labelled documents. Scores are moved so that
it lies where the caller decides, and squeezed to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from peakline.llm.common import in_arrow, stored, whole_text

FEATURES = ("log_words", "short", "word_length", "symbols", "shouts", "upper", "digits", "bars", "distinct", "distinct_triples", "repeated_lines", "open_lines", "line_words", "commonest", "sentence_ends")
_SYMBOLS, _ENDS = re.compile(rb"[#*$%&|<>]"), re.compile(rb"[.!?:;][\"')\]]*\s*$")
_UPPER, _LOWER, _DIGIT = re.compile(rb"[A-Z]"), re.compile(rb"[a-z]"), re.compile(rb"[0-9]")


@dataclass(frozen=True)
class Sample:
    """Bounds of what is fitted: at most about `rows` labelled documents, drawn by a hash of their id, and `pairs` preference pairs."""

    rows: int = 20_000
    pairs: int = 60_000
    ridge: float = 1e-3


@dataclass(frozen=True)
class Ranking:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float


def features(text: str) -> list[float]:
    """What a score may depend on: form only, not the words themselves. All finite, also for empty texts."""
    raw = text.encode()
    words, n = raw.split(), 0
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    some, triples = max(n, 1), max(n - 2, 1)
    upper, lower = len(_UPPER.findall(raw)), len(_LOWER.findall(raw))
    counts = Counter(words)
    n_lines = max(len(lines), 1)
    return [math.log1p(n), 1.0 if n < 50 else 0.0, math.log1p(sum(map(len, words)) / some), len(_SYMBOLS.findall(raw)) / some, raw.count(b"!!") / some, upper / max(upper + lower, 1),
            len(_DIGIT.findall(raw)) / max(len(raw), 1), raw.count(b"|") / some, math.log1p(len(counts)) - math.log1p(n), len(set(zip(words, words[1:], words[2:], strict=False))) / triples if n > 2 else 1.0,
            1 - len(set(lines)) / n_lines if lines else 0.0, sum(not _ENDS.search(line) for line in lines) / n_lines, math.log1p(n / n_lines),
            max(counts.values(), default=0) / some, raw.count(b".") / some]


def text_features(docs: DataFrame) -> DataFrame:
    """(doc_id, carried, features) of rows (doc_id, text, carried)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("carried"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "carried", "features"])

    return docs.select("doc_id", "carried", "text").transform(in_arrow, run, "doc_id long, carried int, features array<double>")


def preference_pairs(good: int, bad: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of (better, worse) rows: both classes are walked round until `limit`, with a shift each time one has been walked,
    so that pairs do not repeat."""
    n = min(limit, good * bad)
    at = np.arange(n)
    return (at % good, (at + at // math.lcm(good, bad)) % bad) if n else (at, at)


def fit_ranking(x: np.ndarray, better: np.ndarray, sample: Sample = Sample()) -> Ranking:
    """Weights by Newton steps on the logistic loss of feature differences. With one class only, all weights are 0."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(x) or better.all() or not better.any():
        return Ranking((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = (x - mean) / scale
    i, j = preference_pairs(int(better.sum()), int((~better).sum()), sample.pairs)
    gap = z[better][i] - z[~better][j]
    w, rows = np.zeros(k), len(gap)
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(gap @ w, -40, 40)))
        slope = gap.T @ (chance - 1) / rows + sample.ridge * w
        curve = (gap * (chance * (1 - chance))[:, None]).T @ gap / rows + sample.ridge * np.eye(k)
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return Ranking(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), float(np.quantile(z @ w, 1 - better.mean())))


def learn(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Ranking:
    """The ranking from rows (doc_id, text) and (doc_id, label). Null labels are left out; of several labels of one id the lowest counts."""
    known = stored(labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("carried")))
    share = sample.rows / max(known.count(), 1)
    drawn = known if share >= 1 else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = text_features(docs.select("doc_id", whole_text().alias("text")).join(drawn, "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "features").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit_ranking(x, rows["carried"].to_numpy() == 1, sample)


def score(docs: DataFrame, ranking: Ranking, decide_at: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted): score is at least `decide_at` exactly for documents at or above the ranking's threshold."""
    mean, scale, weights = map(np.array, (ranking.mean, ranking.scale, ranking.weights))
    shift = math.log(decide_at / (1 - decide_at)) - ranking.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(len(batch), len(weights))
            value = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ weights + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= decide_at).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).transform(in_arrow, run, "doc_id long, score double, predicted int")


def held_out(column: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), decide_at: float = 0.3) -> DataFrame:
    """Scores of all documents, learnt from labels of documents that are not held out.

    docs: doc_id, text and anything else, ignored; labels: doc_id, quality. Returns one row per document: doc_id, held_out, score,
    predicted. A null text is empty and scored as such. A null id is not held out and has no label. Repeated rows score alike; without
    usable labels every score is `decide_at`; an empty table gives an empty result.
    """
    usable = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label")).filter(~held_out())
    ranking = learn(docs, usable, sample)
    return score(docs, ranking, decide_at).select("doc_id", held_out().alias("held_out"), "score", "predicted")
