"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text, and an estimated share of positives.

A text becomes measurements of its style (shares of kinds of characters, repeated words, lines and triples of words, ...),
each cut into bins at quantiles of the unlabelled texts; the model adds a weight a bin. It is fitted by the non-negative
risk: with prior p, the risk p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)), whose last part estimates the
risk of negatives without having one. Where that part falls below zero, which means that the model has learned unlabelled
rows by heart, a step goes the other way. The prior is estimated where one half of the rows judges the other: of all
thresholds, the least bound of the share of unlabelled rows above it over that of positives. Labels of negatives are not used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import documents, hash_sample, held_out, map_texts, one_text_each

MEASURES = (
    "words", "letters", "upper case", "digits", "blanks", "punctuation", "symbols", "exclamation", "word length", "word length spread",
    "longest word", "distinct words", "commonest word", "words said twice", "words without letters", "capitalised words",
    "words per line", "repeated lines", "text in repeated lines", "repeated triples", "words that end a clause", "character entropy",
)
#: Quantiles of the unlabelled texts at which a measurement is cut.
CUTS = (0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.75, 0.88, 0.94, 0.97, 0.99)
#: Kinds of characters.
OTHER, LOWER, UPPER, DIGIT, BLANK, LINE, PUNCTUATION, SHOUT = range(8)
#: Strength of the penalty, steps of a fit, and the chance that the bound of the prior is too low.
PENALTY, STEPS, DELTA = 5e-5, 400, 0.1


def kinds() -> np.ndarray:
    """The kind of each code point."""

    def kind(c: str) -> int:
        if c == "\n":
            return LINE
        if c.isspace():
            return BLANK
        if c.isalpha():
            return UPPER if c.isupper() else LOWER
        if c.isdigit():
            return DIGIT
        return SHOUT if c == "!" else PUNCTUATION if c in ".,;:?-'\"()…¿¡«»“”„’" else OTHER

    return np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000)


def _repeats(x: np.ndarray) -> np.ndarray:
    """Whether an entry has stood before."""
    order = np.argsort(x, kind="stable")
    again = np.zeros(len(x), bool)
    again[order[1:]] = x[order[1:]] == x[order[:-1]]
    return again


def _hashes(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each of some stretches of code points."""
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(int(sizes.sum()))
    inner = place - at
    x = (code[np.repeat(starts, sizes) + inner].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + inner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(x ^ (x >> np.uint64(32)), np.cumsum(sizes) - sizes)


def measure(kind_of: np.ndarray, text: str) -> np.ndarray:
    """The measurements of a whole text; of one without words, all zero."""
    out = np.zeros(len(MEASURES))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kind_of[code]
    inside = (kind != BLANK) & (kind != LINE)
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    words = len(starts)
    if not words:
        return out
    n = len(code)
    share = np.bincount(kind, minlength=8) / n
    letters = share[LOWER] + share[UPPER]
    word = _hashes(code, starts, sizes)
    counts = np.sort(np.unique(word, return_counts=True)[1])
    has_letter = np.add.reduceat(np.append((kind == LOWER) | (kind == UPPER), False).astype(np.int64), edges)[::2] > 0
    breaks = np.flatnonzero(kind == LINE)
    line_starts, line_ends = np.append(0, breaks + 1), np.append(breaks, n)
    full = line_ends > line_starts
    line_starts, line_sizes = line_starts[full], (line_ends - line_starts)[full]
    again = _repeats(_hashes(code, line_starts, line_sizes))
    triples = word[:-2] * np.uint64(3) ^ word[1:-1] * np.uint64(0x9E3779B97F4A7C15) ^ word[2:] * np.uint64(0xC2B2AE3D27D4EB4F) if words > 2 else word[:0]
    chars = np.bincount(code & 0xFF, minlength=256)
    chars = chars[chars > 0] / n
    ends = kind[edges[1::2] - 1]
    out[:] = (
        math.log1p(words), letters, share[UPPER] / max(letters, 1 / n), share[DIGIT], share[BLANK] + share[LINE], share[PUNCTUATION], share[OTHER], share[SHOUT],
        sizes.mean(), sizes.std(), math.log1p(sizes.max()), math.log1p(len(counts)) / math.log1p(words), counts[-1] / words,
        (word[1:] == word[:-1]).mean() if words > 1 else 0.0, 1 - has_letter.mean(), (kind[starts] == UPPER).mean(),
        math.log1p(words / len(line_starts)), again.mean(), line_sizes[again].sum() / n, _repeats(triples).mean() if len(triples) else 0.0,
        ((ends == PUNCTUATION) | (ends == SHOUT)).mean(), -(chars * np.log(chars)).sum(),
    )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Bins:
    """Measurements as places of ones in a long vector: a bin of each, and a one that all have."""

    def __init__(self, unlabelled: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, CUTS)) for c in unlabelled.T]
        self.first = np.cumsum([1, *(len(c) + 1 for c in self.cuts)])

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([f + np.searchsorted(c, col, side="right") for f, c, col in zip(self.first, self.cuts, x.T)], axis=1)

    def dense(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.first[-1]), np.float32)
        out[:, 0] = 1
        out[np.arange(len(x))[:, None], self.places(x)] = 1
        return out


def _descend(gradient, size: int) -> np.ndarray:
    """Weights after some steps along gradient(weights), each entry scaled by what it was before."""
    w, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, STEPS + 1):
        g = gradient(w)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w - 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    return w


def _penalty(w: np.ndarray) -> np.ndarray:
    return PENALTY * np.append(0.0, w[1:])


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk under the logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = sigmoid(positive @ w), sigmoid(unlabelled @ w)
        # of the loss as a negative, log(1 + exp(z)), the slope is the score itself
        negative = u @ unlabelled / len(u) - prior * (p @ positive) / len(p)
        risk = np.logaddexp(0, unlabelled @ w).mean() - prior * np.logaddexp(0, positive @ w).mean()
        if risk < 0:
            return _penalty(w) - negative
        return _penalty(w) + prior * ((p - 1) @ positive) / len(p) + negative

    return _descend(gradient, positive.shape[1])


def fit_apart(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Weights that tell positives from unlabelled rows, both sides weighted alike."""

    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = sigmoid(positive @ w), sigmoid(unlabelled @ w)
        return _penalty(w) + (p - 1) @ positive / len(p) + u @ unlabelled / len(u)

    return _descend(gradient, positive.shape[1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows: each half of the rows is judged by the other. At the threshold where
    the share of unlabelled rows above it over that of positives, both with their sampling error, is least, the unlabelled
    rows above it are nearly all positive, so the ratio is the prior."""
    found = []
    for fold in (0, 1):
        w = fit_apart(positive[fold::2], unlabelled[fold::2])
        p, u = np.sort(positive[1 - fold :: 2] @ w), np.sort(unlabelled[1 - fold :: 2] @ w)
        above = lambda x, c: 1 - np.searchsorted(x, c) / len(x)
        at = np.unique(p)
        of_p, of_u = above(p, at), above(u, at)
        error = sum(math.sqrt(math.log(4 / DELTA) / (2 * len(x))) for x in (p, u))
        best = int(np.argmin((of_u + error) / of_p))
        found.append(min(1.0, of_u[best] / of_p[best]))
    return float(np.clip(np.mean(found), 0.01, 0.99))


@dataclass
class Model:
    bins: Bins
    weights: np.ndarray
    prior: float

    def judge(self, x: np.ndarray) -> tuple[float, list[str]]:
        """The score, and the measurements that lower it most, at most three."""
        parts = self.weights[self.bins.places(x[None])[0]]
        low = [int(k) for k in np.argsort(parts, kind="stable")[:3] if parts[k] < 0]
        return float(sigmoid(self.weights[0] + parts.sum())), [MEASURES[k] for k in low]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = 4000, unlabelled: int = 8000) -> Model | None:
    """Learns from rows that aren't held out: `positives` trusted ones and `unlabelled` texts whatever their label, at most;
    those least by a hash. A document is trusted if all its labels are 1."""
    told = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    told = told.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = documents(docs, id_col, text_col)
    trusted = one_text_each(texts, hash_sample(told.where("label = 1"), positives, "label"), "label")
    web = hash_sample(texts.where(~held_out() | F.col("doc_id").isNull()).withColumn("label", F.lit(0)), unlabelled, "label")
    rows = trusted.select("text", "label").unionByName(web.select("text", "label"))
    measured = map_texts(rows, lambda kind_of, text, label: (label, measure(kind_of, text).tolist()), "label int, x array<double>", kinds)
    by = {1: [], 0: []}
    for label, x in sorted((r.label, r.x) for r in measured.toLocalIterator()):  # positives + unlabelled rows of 22 numbers
        by[label].append(x)
    if not by[1] or not by[0]:
        return None
    rng = np.random.default_rng(1)  # halves of sorted rows would be alike
    p, u = (rng.permutation(np.array(by[y])) for y in (1, 0))
    bins = Bins(u)
    p, u = bins.dense(p), bins.dense(u)
    prior = estimate_prior(p, u) if min(len(p), len(u)) > 1 else 0.5
    return Model(bins, fit_non_negative(p, u, prior), prior)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, reasons: a row for each row of docs, by whole texts only.

    score is the chance of being positive under the estimated prior; reasons, of texts below the threshold, are the
    measurements that lower it most. Null and empty texts, and those of blanks only, are measured as zero throughout.
    Rows that repeat an id are scored each for itself; one text of a labelled id is learned, the least by a hash. held_out
    is null for a null id. Without a positive to learn from, or without unlabelled rows, the score is 0.5 for all. An empty
    table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **how)

    def row(kind_of, doc_id, text, out):
        score, reasons = model.judge(measure(kind_of, text)) if model else (0.5, [])
        return doc_id, out, score, int(score >= threshold), reasons if score < threshold else []

    schema = "doc_id long, held_out boolean, score double, predicted int, reasons array<string>"
    return map_texts(documents(docs, id_col, text_col).withColumn("held_out", held_out()), row, schema, kinds)
