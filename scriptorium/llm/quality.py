"""Quality: naive Bayes support vectors. N-gram indicators scaled by class log-count ratios, hinge loss by dual coordinate descent.

Features of a whole text are indicators of byte n-grams of orders 2 and 3, of n-grams of its shape, in which every run of
lower-case letters, capitals, digits or equal signs is one symbol, and of n-grams of its words as they repeat, in which a word is the
symbol for "the same again" or that for another. Each indicator's value is
the log ratio of its smoothed shares among good and bad texts, rows have norm 1, and a linear machine is fitted by dual
coordinate descent on a bounded sample (labelled_sample()). Scoring takes every whole text.

Defined results: null and empty texts have no n-grams and score by the bias alone; where a class has no labelled text, every score
is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import held_out, labelled_sample, map_text
from scriptorium.llm.svm import curve, fit_curve, fit_sparse

#: Bounds of the sample that is fitted on the driver.
PER_CLASS, MAX_CHARS = 1500, 8_000
BINS = 1 << 14
PIECE = 1 << 20
#: Bins of byte n-grams of orders 2 and 3, of shape n-grams of orders 3 and 4, and of repetition n-grams of orders 1 to 3.
DIM = 7 * BINS
COST, SHARE = 1.0, 0.9
MIX = (0x9E3B, 0x3D4D, 0x85EB, 0x27D5)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def _mark(mask: np.ndarray, symbols: np.ndarray, orders: tuple[int, ...], start: int) -> None:
    """Sets the bins of all n-grams of these orders."""
    for k, order in enumerate(orders):
        if len(symbols) >= order:
            h = symbols[: len(symbols) - order + 1] * MIX[0]
            for j in range(1, order):
                h += symbols[j : len(symbols) - order + 1 + j] * MIX[j]
            mask[start + k * BINS + (h >> 4 & BINS - 1)] = True


def features(text: str | None, mask: np.ndarray) -> np.ndarray:
    """The indices of the text's indicators, in order. mask: DIM False values, left as they were."""
    raw = (text or "").encode()
    tail = np.zeros(0, np.intp)  # the last symbols of the shape so far
    for at in range(0, len(raw), PIECE):  # no n-gram is lost between pieces
        b = np.frombuffer(raw[max(0, at - 2) : at + PIECE], np.uint8)
        _mark(mask, b.astype(np.intp), (2, 3), 0)
        s = _SHAPE[b[2 if at else 0 :]].astype(np.intp)
        runs = np.concatenate([tail, s[np.concatenate([[not len(tail) or s[0] != tail[-1]], s[1:] != s[:-1]])]])
        _mark(mask, runs, (3, 4), 2 * BINS)
        tail = runs[-3:]
    words = raw.split()
    again = np.fromiter(map(operator.eq, words, words[1:]), np.intp, max(0, len(words) - 1))
    _mark(mask, 2 - again, (1, 2, 3), 4 * BINS)
    found = np.flatnonzero(mask)
    mask[found] = False
    return found


@dataclass
class QualityModel:
    """The machine's weight of each indicator (ratio and weight in one), the ratios for the norm, and the curve of margins."""

    ratio: np.ndarray | None = None
    weight: np.ndarray | None = None
    bias: float = 0.0
    ab: tuple[float, float] = (0.0, 0.0)

    def margins(self, texts: list[str | None]) -> np.ndarray:
        mask, out = np.zeros(DIM, bool), np.empty(len(texts))
        for i, t in enumerate(texts):
            at = features(t, mask)
            r = self.ratio[at]
            out[i] = self.weight[at].sum() / (np.sqrt((r * r).sum()) or 1.0) + self.bias
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), 0.5) if self.ratio is None else curve(self.margins(texts), self.ab)


def fit(sample: list[tuple[str, int]]) -> QualityModel:
    y = np.array([label for _, label in sample])
    if not len(y) or y.min() == y.max():
        return QualityModel()
    mask = np.zeros(DIM, bool)
    rows = [features(t, mask) for t, _ in sample]
    good, bad = np.ones(DIM), np.ones(DIM)
    for r, label in zip(rows, y, strict=True):
        (good if label == 1 else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    cost = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) * COST
    sign = np.where(y == 1, 1.0, -1.0)

    def machine(part: np.ndarray) -> QualityModel:
        w, bias = fit_sparse([rows[i] for i in part], ratio, sign[part], cost[part])
        w = SHARE * w + (1 - SHARE) * np.abs(w).mean()  # towards naive Bayes
        return QualityModel(ratio.astype(np.float32), (w * ratio).astype(np.float32), bias)

    # The curve is set on margins that a machine gives to the part it wasn't fitted on.
    turn = np.arange(len(y)) % 3
    margin = np.empty(len(y))
    for k in range(3):
        if len(set(y[turn != k])) < 2:
            continue
        margin[turn == k] = machine(np.flatnonzero(turn != k)).margins([sample[i][0] for i in np.flatnonzero(turn == k)])
    model = machine(np.arange(len(y)))
    model.ab = fit_curve(margin if len(y) >= 30 else model.margins([t for t, _ in sample]), y)
    return model


def learned(docs: DataFrame, labels: DataFrame, *, mod: int = 3, rem: int = 1) -> QualityModel:
    return fit(labelled_sample(docs, labels, "quality", mod, rem, per_class=PER_CLASS, max_chars=MAX_CHARS))


def score_quality(docs: DataFrame, model: QualityModel, *, keep: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 where score >= 0.5) of each whole text."""

    def score(texts: list) -> dict[str, pa.Array]:
        s = model.scores(texts)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    return map_text(docs, keep, F.col(text_col), score, f"{schema}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score_quality(docs, learned(docs, labels), keep=[F.col("doc_id"), held_out("doc_id", 3, 1).alias("held_out")], schema="doc_id long, held_out boolean")
