"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

Texts become counts of hashed letter pairs and triples of the whole text, square-rooted and scaled to length one. The
classifiers are fitted on a bounded sample of labelled rows, `per_lang` a language, whose vectors are made on the
executors; the weights, a few vectors, go to every task.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import documents, hash_sample, held_out, map_column, map_texts

BINS = 2048
#: Families of language codes; codes that are in none are grouped by their texts.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk",
    "indic": "hi bn ur pa mr gu ne",
    "sinitic": "zh yue wuu",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
#: So many languages of unknown family are a family each.
FEW = 4


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(letters: np.ndarray, text: str) -> np.ndarray | None:
    """A vector of length one over 2 * BINS hashed pairs and triples; None if the text has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    is_letter = letters[code]
    if not is_letter.any():
        return None
    # one separator between words, and one at each end
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    code = np.concatenate([[32], np.where(is_letter, code, 32)[keep], [32]]).astype(np.uint32)
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + code[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BINS.bit_length() + 1)
    counts = np.concatenate([np.bincount((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift, minlength=BINS) for x in (two, three)])
    out = np.sqrt(counts)
    return (out / np.sqrt(out @ out)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a squared-hinge linear SVM (y: -1 or 1), classes weighted alike; accelerated gradient."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = v = np.zeros(x.shape[1] + 1)
    step = 1.0 / (1.0 / penalty + 4.0)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = np.append(v[:-1] / penalty - 2 * (slack @ x), -2 * slack.sum())
        new = v - step * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the probability 1 / (1 + exp(-(a * margin + b))), with smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z, both = np.array([2.0, 0.0]), np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ z, -30, 30)))
        hessian = both.T @ (both * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, both.T @ (p - target))
        z = z - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return max(float(z[0]), 1e-3), float(z[1])


class Pairs:
    """One-versus-one SVMs over the labels; a label's probability is the mean of those its pairs give it."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.labels = sorted(set(labels.tolist()))
        self.pairs, weights, scales = list(itertools.combinations(range(len(self.labels)), 2)), [], []
        for i, j in self.pairs:
            rows = (labels == self.labels[i]) | (labels == self.labels[j])
            y = np.where(labels[rows] == self.labels[i], 1.0, -1.0)
            w = linear_svm(x[rows], y)
            weights.append(w)
            scales.append(platt(x[rows] @ w[:-1] + w[-1], y))
        self.weights = np.array(weights, np.float32).reshape(len(self.pairs), x.shape[1] + 1)
        self.scales = np.array(scales).reshape(-1, 2)

    def best(self, v: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.labels[0], 1.0
        margin = self.weights[:, :-1] @ v + self.weights[:, -1]
        p = 1 / (1 + np.exp(-np.clip(self.scales[:, 0] * margin + self.scales[:, 1], -30, 30)))
        votes, total = np.zeros(len(self.labels)), np.zeros(len(self.labels))
        for (i, j), q in zip(self.pairs, p.tolist(), strict=True):
            votes[i] += q > 0.5
            votes[j] += q <= 0.5
            total[i] += q
            total[j] += 1 - q
        k = int(np.lexsort((-total, -votes))[0])
        return self.labels[k], float(total[k] / (len(self.labels) - 1))


def families_of(x: np.ndarray, langs: np.ndarray) -> dict[str, str]:
    """Each language's family: the known one of its code, else one of some groups of languages with like mean vectors, so
    that pairs to be fitted stay few. Groups are named by their first language."""
    out = {lang: FAMILY[lang] for lang in set(langs.tolist()) if lang in FAMILY}
    other = sorted(set(langs.tolist()) - set(out))
    if len(other) <= FEW:
        return out | {lang: lang for lang in other}
    means = np.stack([x[langs == lang].mean(axis=0) for lang in other]).astype(float)
    means /= np.sqrt((means**2).sum(axis=1, keepdims=True))
    groups: list[list[int]] = []
    room = math.ceil(math.sqrt(len(other)))
    left = list(range(len(other)))
    while left:  # the first that is left, and those most like it
        near = sorted(left, key=lambda k: (k != left[0], -means[k] @ means[left[0]], k))[:room]
        groups.append(near)
        left = [k for k in left if k not in near]
    return out | {other[k]: other[min(g)] for g in groups for k in g}


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = families_of(x, langs)
        families = np.array([family[lang] for lang in langs.tolist()])
        self.family = Pairs(x, families)
        self.within = {f: Pairs(x[families == f], langs[families == f]) for f in self.family.labels}

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        family, p = self.family.best(v)
        lang, q = self.within[family].best(v)
        return lang, p * q


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, most_langs: int = 64) -> Model | None:
    """A model from `per_lang` rows a language at most, the least by a hash of the whole row, of those not held out; of the
    `most_langs` most frequent languages, the first by name of equally frequent ones."""
    rows = documents(docs.withColumn("lang", F.col(f"`{lang_col}`").cast("string")), id_col, text_col, "lang").where(~held_out() & F.col("lang").isNotNull())
    usual = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).select("lang")
    usual_rows = rows.join(F.broadcast(usual), "lang", "left_semi")  # usual: most_langs rows
    vectors = map_texts(
        hash_sample(usual_rows, per_lang, "lang").select("doc_id", "text", "lang"),
        lambda letters, doc_id, text, lang: (doc_id, lang, None if (v := features(letters, text)) is None else v.tobytes()),
        "doc_id long, lang string, vector binary",
        _letters,
    ).where("vector IS NOT NULL")
    got = sorted((r.doc_id, r.lang, bytes(r.vector)) for r in vectors.toLocalIterator())  # per_lang * most_langs rows
    if not got:
        return None
    return Model(np.stack([np.frombuffer(v, np.float32) for _, _, v in got]), np.array([lang for _, lang, _ in got]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, most_langs: int = 64) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of docs, by whole texts only.

    lang_pred is a learned language or `und`, score 0, if the text is null or has no letter, or if nothing was to be learned
    from. score is the family's probability times the language's within it; of languages with equal votes the one with the
    higher sum of probabilities wins, then the first by name. held_out is null for a null id. Rows that repeat an id are
    learned and judged each for itself; rows that repeat whole are learned once. An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, id_col, text_col, lang_col, per_lang, most_langs)

    def row(letters, doc_id, text, out):
        v = features(letters, text) if model else None
        return doc_id, out, *((UNKNOWN, 0.0) if v is None else model.predict(v))

    texts = documents(docs, id_col, text_col).withColumn("held_out", held_out())
    return map_texts(texts, row, "doc_id long, held_out boolean, lang_pred string, score double", _letters)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, most_langs: int = 64, least_score: float = 0.3) -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language that is told with `least_score` or more.

    Rejected are null texts, texts without letters, and, where nothing was to be learned from, all. Rows that repeat an id
    are judged each for itself, and an empty table stays empty.
    """
    model = fit(docs, id_col, text_col, lang_col, per_lang, most_langs)

    def told(letters, text) -> bool:
        v = features(letters, text) if text and model else None
        return v is not None and model.predict(v)[1] >= least_score

    return docs.where(map_column(docs, text_col, told, "boolean", _letters))
