"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, through Nystroem landmarks.

A text is a bag of segments: its words (ends stripped of signs; words with signs inside also without them), runs of single
characters set apart by any white space, joined; long words as overlapping windows. A word broken into longer pieces is not joined. The kernel of two segments sums over the character subsequences
of 3 and of 4 that both have, each occurrence weighted DECAY to the power of its span, spans bounded, and is divided by
a function of the lengths. Characters of all scripts are told apart (Latin letters without their marks), subsequences by 20 bits of a hash. An insult with gaps or characters put in keeps most of its subsequences, so it stays near its landmark.

Labels are of whole texts, segments are learned as multiple instances: the words that several toxic texts have and clean texts
hardly have seed the positive class, clean words the negative; then, in rounds, the worst clean segments join the negatives
and the best segment of each toxic text not yet explained joins the positives. Landmark features are K_mm^(-1/2) k_m(x);
since the kernel is a product of explicit subsequence weights, the fitted machine collapses into one weight for each
subsequence, so a segment costs the same whatever the number of landmarks. A text's margin is its highest segment's.

Fitting takes a bounded sample (labelled_sample()); scoring takes every whole text. Defined results: a null or empty text, or one
without segments, scores as the lowest margin; where a class has no labelled text, every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import filter_text, held_out, labelled_sample, map_text
from scriptorium.llm.svm import curve, fit_curve, fit_dense

#: Bounds of the sample that is fitted on the driver.
PER_CLASS, MAX_CHARS = 1500, 8_000
DECAY, SPAN = 0.6, {3: 5, 4: 5}
WINDOW = 24
#: Subsequences are told apart by hashes of their characters' code points: of so many bits for each length.
BITS = 20
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
EDGE = ord("\n")
LANDMARKS = 240
FLOOR = -3.0

_SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_MAYBE = re.compile(r"\s\S\s+\S\s")


def _fold() -> dict[int, str]:
    """Latin letters with marks to their base letter."""
    out = {}
    for c in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if base in string.ascii_lowercase:
            out[c] = base
    return out | {ord("ß"): "s", ord("æ"): "a", ord("œ"): "o", ord("ø"): "o"}


FOLD = _fold()


def _patterns() -> list[tuple[tuple[int, ...], float]]:
    """Offsets of a subsequence's characters from its first, and its weight."""
    out = []
    for p, span in SPAN.items():
        def grow(at: tuple[int, ...]) -> None:
            if len(at) == p:
                out.append((at, DECAY ** (at[-1] + 1)))
                return
            for nxt in range(at[-1] + 1, span):
                grow((*at, nxt))
        grow((0,))
    return out


PATTERNS = _patterns()
SIZE = 2 << BITS


def spaced(low: str) -> list[str]:
    """Runs of three single characters or more, whatever white space sets them apart, joined."""
    return ["".join(m[0].split()) for m in _SINGLES.finditer(low)] if _MAYBE.search(f" {low} ") else []


def tokens(text: str) -> set[str]:
    """The words of a whole text, lower-cased, and its spaced out runs."""
    low = text.lower()
    found = set(low.split())
    found.update(spaced(low))
    return found


def segments(token: str) -> list[str]:
    """A word's segments: ends stripped of signs, also without signs inside, long ones as overlapping windows."""
    core = token if token.isalnum() else token.strip(string.punctuation)
    many = (core,) if core.isalnum() else (core, "".join(filter(str.isalnum, core)))
    out = []
    for x in many:
        if len(x) <= WINDOW:
            out.append(x)
        else:
            out += [x[i : i + WINDOW] for i in range(0, len(x) - WINDOW // 2, WINDOW // 2)]
    return [x for x in out if x]


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words with an edge on both sides of each, how far the next edge is from each place, and where words begin."""
    whole = "\n" + "\n".join(words) + "\n"
    codes = np.frombuffer(whole.translate(FOLD).encode("utf-32-le", "replace"), np.uint32)
    edges = np.flatnonzero(codes == EDGE)
    ahead = np.repeat(edges[1:], np.diff(edges)) - np.arange(edges[-1])
    return codes, ahead.astype(np.int32), edges[:-1]


def _occurrences(words: list[str]):
    """(place, subsequence, weight) of each pattern over the laid out words, and where words begin."""
    codes, ahead, begin = _laid_out(words)
    n = len(ahead)
    # Spread over all numbers first: sums of small numbers' multiples would meet too often.
    spread = codes * np.uint32(MIX[3])
    spread = (spread ^ spread >> np.uint32(15)) * np.uint32(MIX[2])
    mixed = [spread * np.uint32(m) for m in MIX]  # by the character's place in the subsequence
    for at, weight in PATTERNS:
        ok = np.flatnonzero(ahead >= at[-1])
        index = mixed[0][ok]
        for j, k in enumerate(at[1:], 1):
            index += mixed[j][ok + k]
        index ^= index >> np.uint32(15)
        index *= np.uint32(MIX[0])
        yield ok, (index >> np.uint32(32 - BITS)).astype(np.int64) + ((1 << BITS) if len(at) == 4 else 0), weight, begin, n


def _norms() -> np.ndarray:
    """For each length up to WINDOW and some: the root of the summed squared weights, were all subsequences different."""
    out = []
    for n in range(WINDOW + 2):
        out.append(np.sqrt(sum(max(0, n + 2 - at[-1]) * w * w for at, w in PATTERNS)) or 1.0)
    return np.array(out)


NORMS = _norms()


def table_scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """For each word the weighted sum of a table over its subsequences, by its norm."""
    if not words:
        return np.zeros(0)
    total = begin = None
    for ok, index, weight, begin, n in _occurrences(words):
        if total is None:
            total = np.zeros(n)
        total[ok] += weight * table[index]
    return np.add.reduceat(total, begin) / NORMS[[min(len(w), WINDOW + 1) for w in words]]


def _explicit(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences of a word and their weights, by its norm."""
    at, w = [], []
    for _, index, weight, *_ in _occurrences([word]):
        at.append(index)
        w.append(np.full(len(index), weight))
    keys, back = np.unique(np.concatenate(at), return_inverse=True)
    return keys, np.bincount(back, np.concatenate(w), len(keys)) / NORMS[min(len(word), WINDOW + 1)]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of each word with each landmark."""
    own = [_explicit(x) for x in landmarks]
    keys = np.unique(np.concatenate([k for k, _ in own]))
    place = np.full(SIZE, -1, np.int32)
    place[keys] = np.arange(len(keys))
    wide = np.zeros((len(keys), len(landmarks)), np.float32)
    for j, (k, w) in enumerate(own):
        wide[place[k], j] = w
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 2000):
        part = words[at : at + 2000]
        for ok, index, weight, begin, n in _occurrences(part):
            word = np.repeat(np.arange(len(part)), np.diff(np.append(begin, n)))[ok]
            seen = np.flatnonzero(place[index] >= 0)
            if len(seen):
                first = np.flatnonzero(np.diff(word[seen], prepend=-1))
                out[at + word[seen][first]] += weight * np.add.reduceat(wide[place[index[seen]]], first, axis=0)
    return out / NORMS[[min(len(w), WINDOW + 1) for w in words]][:, None]


@dataclass
class ToxicityModel:
    """One weight for each subsequence, a bias, and the curve of margins; a null table stands for no learned class."""

    table: np.ndarray | None
    bias: float = 0.0
    ab: tuple[float, float] = (0.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"table": self.table, "bias": self.bias, "ab": self.ab, "cache": {}}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The highest segment's margin of each text."""
        bags = [tokens(t) if t else set() for t in texts]
        cache = self.cache
        new = list(set().union(*bags).difference(cache)) if bags else []
        for i in range(0, len(new), 20_000):  # bounds the arrays, not what is scored
            part = new[i : i + 20_000]
            parts = [segments(w) for w in part]
            f = iter((table_scores([x for p in parts for x in p], self.table) + self.bias).tolist())
            cache.update((w, max([next(f) for _ in p], default=FLOOR)) for w, p in zip(part, parts, strict=True))
        out = np.array([max(map(cache.__getitem__, b), default=FLOOR) for b in bags])
        if len(cache) > 400_000:
            cache.clear()
        return np.maximum(out, FLOOR)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(texts))
        return np.concatenate([curve(self.margins(texts[i : i + 500]), self.ab) for i in range(0, len(texts), 500)]) if texts else np.zeros(0)


def _machine(positive: dict[str, int], negative: dict[str, int]) -> tuple[np.ndarray, float]:
    """The collapsed table and the bias of a machine fitted on positive and on negative segments with their numbers of texts."""
    # Variants with a letter put in, so that what one letter inside takes away is learned.
    varied = {}
    for w in sorted(positive, key=lambda w: (-positive[w], w))[:40]:
        for k in range(1, len(w)):
            varied.setdefault(w[:k] + "xzkj"[k % 4] + w[k:], max(5, positive[w] // 8))
    positive = varied | positive
    pos, neg = (sorted(x, key=lambda w, x=x: (-x[w], w)) for x in (positive, negative))
    spread = [neg[i] for i in np.unique(np.linspace(0, len(neg) - 1, LANDMARKS // 3).astype(int))] if neg else []
    marks = list(dict.fromkeys([*pos[: LANDMARKS - len(spread)], *spread]))
    k_mm = kernel(marks, marks)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    ok = values > 2e-3 * values.max()
    root = vectors[:, ok] / np.sqrt(values[ok])
    x = kernel(pos + neg, marks) @ root
    y = np.array([1.0] * len(pos) + [-1.0] * len(neg))
    cost = np.clip([positive[w] for w in pos] + [negative[w] for w in neg], 5.0, 200.0)
    w = fit_dense(x, y, cost, epochs=60)
    beta, table = root @ w[:-1], np.zeros(SIZE)
    for b, landmark in zip(beta, marks, strict=True):
        keys, weights = _explicit(landmark)
        table[keys] += b * weights
    return table, float(w[-1])


def fit(sample: list[tuple[str, int]], *, rounds: int = 3, chance: float = 1e-4, negatives: int = 3000) -> ToxicityModel:
    """A model of labelled texts.

    chance: a word seeds the positive class if it were found in toxic texts alone with less than this, by chance. Fitting is bounded: about
    `negatives` clean segments in alphabetical steps and the 500 most common ones, in each round the 500 worst, 240 landmarks, and
    variants of the 40 most common seeds. Scoring has no such bounds.
    """
    sample = list(dict.fromkeys(sample))
    toxic, clean = ([set().union(*map(segments, tokens(t))) for t, label in sample if label == want] for want in (1, 0))
    if not toxic or not clean:
        return ToxicityModel(None)
    n1, n0 = len(toxic), len(clean)
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    least = np.log(chance) / np.log(n1 / (n1 + n0))
    seeds = {w: c for w, c in in_toxic.items() if c >= least and in_clean[w] <= 0.02 * c}
    if not seeds:
        seeds = {w: in_toxic[w] for w in sorted(in_toxic, key=lambda w: (-np.log((in_toxic[w] + 0.5) / (n1 + 1)) + np.log((in_clean[w] + 0.5) / (n0 + 1)), w))[:10]}
    every = sorted(set(in_clean).difference(seeds))
    step = max(1, len(every) // negatives)
    negative = dict(in_clean.most_common(500)) | {w: in_clean[w] for w in every[::step]}
    own = sorted(set(in_toxic).difference(in_clean))
    for k in range(rounds + 1):
        negative = {w: c for w, c in negative.items() if w not in seeds}
        table, bias = _machine(seeds, negative)
        if k == rounds:
            break
        f = np.concatenate([table_scores(every[i : i + 20_000], table) for i in range(0, len(every), 20_000)]) + bias if every else np.zeros(0)
        negative |= {every[i]: max(10, in_clean[every[i]]) for i in np.argsort(-f)[:500] if f[i] > -0.9}
        # The best segment of a toxic text without any seed joins, if it is better than all of the clean texts'.
        g = dict(zip(own, np.concatenate([table_scores(own[i : i + 20_000], table) for i in range(0, len(own), 20_000)]) + bias, strict=True)) if own else {}
        limit = max(0.0, float(f.max()) if len(f) else 0.0)
        added = Counter()
        for b in toxic:
            best = max((w for w in b if w in g), key=g.__getitem__, default=None)
            if best is not None and g[best] > limit and not b.intersection(seeds):
                added[best] += 1
        seeds |= added
    model = ToxicityModel(table.astype(np.float32), bias)
    margin, label = model.margins([t for t, _ in sample]), np.array([label for _, label in sample])
    low, high = np.quantile(margin[label == 0], 0.995), np.quantile(margin[label == 1], 0.02)
    # Apart, the curve's middle lies between the classes' inner edges; else where the likelihood puts it.
    model.ab = (6 / (high - low), -3 * (high + low) / (high - low)) if high > low + 0.1 else fit_curve(margin, label)
    model.cache.clear()
    return model


def learned(docs: DataFrame, labels: DataFrame, *, mod: int = 5, rem: int = 0) -> ToxicityModel:
    return fit(labelled_sample(docs, labels, "toxic", mod, rem, per_class=PER_CLASS, max_chars=MAX_CHARS))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, keep: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """The kept columns with score (0 to 1) and predicted (1 where score >= 0.5) of each whole text."""
    def score(texts: list) -> dict[str, pa.Array]:
        s = model.scores(texts)
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    return map_text(docs, keep, F.col(text_col), score, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score_toxicity(docs, learned(docs, labels), keep=[F.col("doc_id"), held_out("doc_id", 5, 0).alias("held_out")], schema="doc_id long, held_out boolean")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't call toxic, with all their columns."""
    model = learned(docs, labels)
    return filter_text(docs, "text", lambda texts: (model.scores(texts) < 0.5).tolist())
