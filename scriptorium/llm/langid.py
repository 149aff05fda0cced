"""Language identification by error-correcting output codes over binary n-gram classifiers.

Each language has a codeword; each bit splits the languages in two, and a naive Bayes classifier over hashed byte n-grams (of
texts with A-Z lower-cased) predicts it. Decoding takes the codeword with the least logistic loss, bits weighted by how well they
did on the sample; `score` is the codeword's share among all, and `ambiguous` flags a runner-up that comes near.

Fitting takes a bounded sample of texts of every language (by a hash of the id); prediction takes every whole text. Defined results: `und`
with score 0 where the text is null or has no letter, or where nothing was learned; where one language was learned it gets
every text; ties go to the first language in sorted order; repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import filter_text, held_out, learnable, map_text
from scriptorium.llm.svm import fit_curve

#: Bounds of the sample that is fitted on the driver: texts of a language, characters of a text. No language is left out: where there are
#: so many that this would be over TEXTS in all, each has fewer, but FEWEST.
PER_LANGUAGE, TEXTS, FEWEST, MAX_CHARS = 300, 60_000, 20, 8_000
SPREAD, PER_PART = 64, 40
UNDETERMINED = "und"
ORDERS = (1, 2, 3)
HASHED = 1 << 17
SIZES = {1: 256, 2: 65_536, 3: HASHED}
STARTS = {1: 0, 2: 256, 3: 256 + 65_536}
DIM = 256 + 65_536 + HASHED
CHUNK = 1 << 20
NEAR = 0.2
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of -1 and 1: all splits of up to 6 languages, else the random code with the largest least distance of 200."""
    if n <= 1:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        bits = np.arange(1, 2 ** (n - 1))
        return np.vstack([np.ones(len(bits), np.int8), *(np.where(bits >> k & 1, -1, 1).astype(np.int8) for k in range(n - 1))])
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code = code[:, np.abs(code.sum(axis=0, dtype=int)) < n]
        d = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        least = (d + np.eye(n, dtype=int) * 10**6).min()
        if best is None or least > best[0]:
            best = least, code
    return best[1]


def _hashes(b: np.ndarray, order: int) -> np.ndarray:
    """The bin of the n-gram that begins at each place of bytes (as int32), within that order's bins."""
    if order == 1:
        return b
    if order == 2:
        return b[:-1] << 8 | b[1:]
    return ((b[:-2] * 0x9E3B + b[1:-1] * 0x3D4D + b[2:] * 0x85EB) >> 3) & (HASHED - 1)


def _bytes(text: str) -> bytes:
    return b" " + text.encode().lower() + b" "


def gram_counts(text: str) -> np.ndarray:
    out = np.zeros(DIM)
    b = np.frombuffer(_bytes(text), np.uint8).astype(np.int32)
    for order in ORDERS:
        h = _hashes(b, order)
        out[STARTS[order] : STARTS[order] + SIZES[order]] += np.bincount(h, minlength=SIZES[order])
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    table: np.ndarray | None = None  # DIM rows of one log ratio for each bit
    slope: np.ndarray | None = None
    shift: np.ndarray | None = None
    weight: np.ndarray | None = None

    def _sums(self, piece: bytes, own: int, begin: np.ndarray | None) -> np.ndarray:
        """The log ratios of the n-grams that begin in the first `own` bytes, in all or for each text that begins at `begin`."""
        b = np.frombuffer(piece, np.uint8).astype(np.int32)
        total = np.zeros((own, self.code.shape[1]), np.float32)
        for order in ORDERS:
            h = _hashes(b, order)[:own]
            part = self.table[STARTS[order] + h]
            if begin is not None:
                for k in range(1, order):  # n-grams over the end of a text
                    part[np.maximum(begin[1:] - k, 0)] = 0
            total[: len(h)] += part
        return total.sum(axis=0, dtype=np.float64)[None] if begin is None else np.add.reduceat(total, begin, axis=0, dtype=np.float64)

    def bits(self, texts: list[str]) -> np.ndarray:
        """For each text, the mean log ratio of its n-grams for each bit; bytes are taken CHUNK at a time."""
        data = [_bytes(t) for t in texts]
        sums, i = np.zeros((len(data), self.code.shape[1])), 0
        while i < len(data):
            j, size = i + 1, len(data[i])
            while j < len(data) and size + len(data[j]) <= CHUNK:
                size += len(data[j])
                j += 1
            if j == i + 1:
                for at in range(0, size, CHUNK):
                    sums[i] += self._sums(data[i][at : at + CHUNK + 2], min(CHUNK, size - at), None)[0]
            else:
                begin = np.concatenate([[0], np.cumsum([len(d) for d in data[i : j - 1]])])
                sums[i:j] = self._sums(b"".join(data[i:j]), size, begin)
            i = j
        return sums / np.array([len(d) for d in data], float)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text."""
        some = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        lang, score, near = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not some or not self.languages:
            return lang, score, near
        if len(self.languages) == 1:
            for k in some:
                lang[k], score[k] = self.languages[0], 1.0
            return lang, score, near
        f = self.bits([texts[k] for k in some]) * self.slope + self.shift
        loss = np.stack([(self.weight * np.logaddexp(0, -row * f)).sum(axis=1) for row in self.code.astype(float)], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        for row, k in enumerate(some):
            lang[k], score[k] = self.languages[order[row, 0]], p[row, order[row, 0]]
            near[k] = p[row, order[row, 0]] - p[row, order[row, 1]] < NEAR
        return lang, score, near


def fit(sample: list[tuple[str, str]]) -> LanguageModel:
    """A model of (text, language) rows; languages weigh alike whatever their numbers of rows."""
    languages = sorted({lang for _, lang in sample})
    code = codewords(len(languages))
    model = LanguageModel(languages, code)
    if len(languages) < 2:
        return model
    index = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(languages), DIM))
    for text, lang in sample:
        counts[index[lang]] += gram_counts(text)
    for order in ORDERS:
        part = counts[:, STARTS[order] : STARTS[order] + SIZES[order]]
        part += 0.5
        part /= part.sum(axis=1, keepdims=True)
    model.table = np.stack([np.log(counts[bit == 1].mean(axis=0)) - np.log(counts[bit == -1].mean(axis=0)) for bit in code.T], axis=1).astype(np.float32)
    # Whole texts and short pieces of them set each bit's curve and weight.
    pieces = [(x, lang) for text, lang in sample for x in (text, text[:60], text[len(text) // 2 : len(text) // 2 + 25]) if x.strip()]
    ratio = model.bits([t for t, _ in pieces])
    truth = code[[index[lang] for _, lang in pieces]]
    fits = [fit_curve(ratio[:, b], (truth[:, b] == 1).astype(int)) for b in range(code.shape[1])]
    model.slope, model.shift = np.array([a for a, _ in fits]), np.array([b for _, b in fits])
    right = ((ratio * model.slope + model.shift > 0) == (truth == 1)).mean(axis=0).clip(0.5, 1 - 1e-3)
    model.weight = np.log(right / (1 - right)) + 1e-6
    model.weight /= model.weight.mean()
    return model


def learned(docs: DataFrame, *, mod: int = 5, rem: int = 0) -> LanguageModel:
    """A model of a bounded sample of the documents that may be learned from, languages taken from their `lang`.

    Null texts and those over MAX_CHARS are passed over before any is chosen.
    """
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("lang").cast("string").alias("__lang"), F.col("text").cast("string").alias("__text")).filter(F.col("__lang").isNotNull() & (F.length("__text") <= MAX_CHARS))
    ids = texts.filter(learnable("__id", mod, rem)).select("__id", "__lang")
    languages = ids.agg(F.count_distinct("__lang")).first()[0]
    each = min(PER_LANGUAGE, max(FEWEST, TEXTS // max(1, languages)))
    # By hash, some of each of SPREAD parts of a language, then of those: so no task gets more than a bounded number of its rows in the end.
    for parts, most in ((["__lang", F.pmod(F.xxhash64("__id"), F.lit(SPREAD))], PER_PART), (["__lang"], each)):
        nth = F.row_number().over(Window.partitionBy(*parts).orderBy(F.xxhash64("__id"), "__id"))
        ids = ids.withColumn("__n", nth).filter(F.col("__n") <= most).drop("__n")
    # At most `each` rows of an id and a language for each language are broadcast.
    rows = texts.join(F.broadcast(ids.distinct()), ["__id", "__lang"]).orderBy(F.xxhash64("__id"), "__id", "__text").limit(each * max(1, languages)).collect()
    return fit([(r["__text"], r["__lang"]) for r in rows])


def identify(docs: DataFrame, model: LanguageModel, *, keep: list[Column], schema: str, text_col: str = "text") -> DataFrame:
    """The kept columns with lang_pred, score and ambiguous of each whole text."""

    def score(texts: list) -> dict[str, pa.Array]:
        lang, s, near = model.predict(texts)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(s, pa.float64()), "ambiguous": pa.array(near, pa.bool_())}

    return map_text(docs, keep, F.col(text_col), score, f"{schema}, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    return identify(docs, learned(docs), keep=[F.col("doc_id"), held_out("doc_id", 5, 0).alias("held_out")], schema="doc_id long, held_out boolean")


def determined_documents(docs: DataFrame) -> DataFrame:
    """The documents with a language: not `und`, and of a codeword that has at least half of the score."""
    model = learned(docs)

    def keep(texts: list) -> list[bool]:
        lang, score, _ = model.predict(texts)
        return [x != UNDETERMINED and s >= 0.5 for x, s in zip(lang, score, strict=True)]

    return filter_text(docs, "text", keep)
