"""Quality of texts by learning from positive and unlabelled texts.

Trusted positives (label 1) and unlabelled web texts are bounded samples, taken by the order of a hash of the id; labels 0
are never used. A model of one hidden layer over shares and rates of a text's characters, words and lines minimises the
non-negative unbiased risk: with the class prior p, p times the positives' loss as positives plus whatever of the unlabelled
texts' loss as negatives is not explained by the positives among them, which is kept from falling below zero. The prior is
estimated from the scores of a first model, on texts it has not seen: the share of unlabelled texts above a score, over
that of positives, is smallest where nearly all texts are good; the smallest upper bound over all scores says where to look, and two standard errors are taken off what is found there, since
a prior that is too high hides bad texts among the unlabelled.

Null and empty texts have all features zero. Rows are scored each for itself, a null id too (its fold is null). Without
positives or texts every score is 0. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.labelled import labelled, sampled, with_texts
from tablecare.llm.text import Texts, crc_fold, map_texts, span_hashes

#: Positives, and as many unlabelled texts, that are learned from.
SAMPLE = 20_000
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
HIDDEN = 16
STEPS = 600
RATE = 0.02
#: Chance that the bound of the class prior is too low.
DOUBT = 0.1

_CLASSES = ("upper", "lower", "digit", "high", "bang", "stop", "comma", "pipe", "symbol", "bracket", "quote", "slash")
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _name, _chars in (
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("digit", "0123456789"), ("bang", "!?"), ("stop", "."),
    ("comma", ",;:"), ("pipe", "|"), ("symbol", "#$%&*+=@^_~"), ("bracket", "()[]{}<>"), ("quote", "'\"`"), ("slash", "/\\-"),
):
    _CLASS[[ord(x) for x in _chars]] = _CLASSES.index(_name)
_CLASS[0x80:] = _CLASSES.index("high")


def features(part: Texts) -> np.ndarray:
    """One row of numbers per text: logarithms of sizes, and rates per word, letter and line."""
    n = len(part)
    starts, ends, rows = part.words()
    words = np.bincount(rows, minlength=n).astype(float)
    some = np.maximum(words, 1)
    kinds = np.zeros((len(_CLASSES) + 1, n))
    if len(part.data):
        row = np.repeat(np.arange(n), np.diff(part.offs))
        kinds = np.bincount(row * (len(_CLASSES) + 1) + _CLASS[part.data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1).T.astype(float)
    letters = np.maximum(kinds[0] + kinds[1] + kinds[3], 1)
    size = (ends - starts).astype(float)
    hashes = span_hashes(part.data, starts, ends)

    def share(mask: np.ndarray, of: np.ndarray = rows, by: np.ndarray = some) -> np.ndarray:
        return np.bincount(of[mask], minlength=n) / by

    again = np.zeros(len(rows), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    pair = np.zeros(len(rows), bool)
    pair[2:] = (hashes[2:] == hashes[:-2]) & (rows[2:] == rows[:-2]) & ~again[2:]
    order = np.lexsort((hashes, rows))
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    group = np.flatnonzero(fresh)
    many = np.diff(np.append(group, len(rows)))
    top = np.zeros(n)
    np.maximum.at(top, rows[order][group], many)
    # lines
    breaks = np.flatnonzero(part.data == 10)
    edges = np.unique(np.concatenate([part.offs, breaks, breaks + 1]))
    begin, end = edges[:-1], edges[1:]
    line = (end > begin) & ~np.isin(begin, breaks)
    begin, end = begin[line], end[line]
    line_row = part.row_of(begin)
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    line_hash = span_hashes(part.data, begin, end)
    line_order = np.lexsort((line_hash, line_row))
    same = np.zeros(len(begin), bool)
    same[1:] = (line_hash[line_order][1:] == line_hash[line_order][:-1]) & (line_row[line_order][1:] == line_row[line_order][:-1])
    shout = (_CLASS[part.data[ends - 1]] == _CLASSES.index("bang")) if len(ends) else np.zeros(0, bool)
    marked = (_CLASS[part.data[ends - 1]] == _CLASSES.index("symbol")) if len(ends) else np.zeros(0, bool)
    caps = (_CLASS[part.data[starts]] == 0) if len(starts) else np.zeros(0, bool)
    lone = size == 1
    columns = [
        np.log1p(words) / 5, np.log1p(lines) / 3, np.bincount(rows, weights=size, minlength=n) / some / 8,
        *(np.sqrt(kinds[i] / (letters if i in (0, 1, 3) else some)) for i in range(len(_CLASSES))),
        share(again), share(pair), np.bincount(rows[order][group], minlength=n) / some, top / some,
        np.sqrt(share(shout)), np.sqrt(share(marked)), share(caps), share(lone), share(size > 20),
        np.bincount(line_row[line_order][same], minlength=n) / lines, np.log1p(some / lines) / 4,
        np.sqrt(np.bincount(rows, weights=size**2, minlength=n) / some) / 10,
    ]
    out = np.clip(np.stack(columns, 1), 0, 6)
    out[words == 0] = 0
    return out.astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.weights, (x - self.mean) / self.scale)[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d, e = weights
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + x @ e + d


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> list[np.ndarray]:
    """Weights of the least non-negative unbiased risk, with logistic loss, by Adam over all rows."""
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    w = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(()), np.zeros(width)]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    x = np.concatenate([positive, unlabelled]).astype(float)
    n, m = len(positive), len(unlabelled)
    for step in range(1, STEPS + 1):
        hidden, z = _forward(w, x)
        p = _sigmoid(z)
        as_negative = np.logaddexp(0, z)
        rest = as_negative[n:].mean() - prior * as_negative[:n].mean()
        # d loss / d z: positives as positives, then the rest as negatives; below zero the rest is stepped back
        g = np.concatenate([prior * (p[:n] - 1) / n, np.zeros(m)])
        back = np.concatenate([-prior * p[:n] / n, p[n:] / m])
        g = g + back if rest >= 0 else -back
        inner = np.outer(g, w[2]) * (1 - hidden**2)
        grads = [x.T @ inner + 1e-4 * w[0], inner.sum(0), hidden.T @ g + 1e-4 * w[2], g.sum(), x.T @ g + 1e-4 * w[4]]
        rate = RATE * (1 - step / (STEPS + 1)) + 1e-4
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad**2
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of good texts among unlabelled ones, from the scores of unseen texts."""
    levels = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = 1 - np.searchsorted(np.sort(positive), levels, side="left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), levels, side="left") / len(unlabelled)
    slack = np.sqrt(np.log(4 / DOUBT) / 2 / len(positive)) + np.sqrt(np.log(4 / DOUBT) / 2 / len(unlabelled))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    a, b = u[best], max(p[best], 1e-9)
    error = np.sqrt((1 - a) / max(a, 1e-9) / len(unlabelled) + (1 - b) / b / len(positive))
    return float(np.clip(a / b * (1 - 2 * error), 0.02, 0.98))


def _sample_features(rows: DataFrame) -> np.ndarray:
    def work(part: Texts) -> pa.RecordBatch:
        x = features(part)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([part.rows.column(0), flat], names=["at", "x"])

    ordered = map_texts(rows.select(F.xxhash64("text").alias("at"), "text"), work, "at long, x array<float>")
    table = ordered.toArrow().sort_by("at")  # at most SAMPLE rows
    column = table.column("x").combine_chunks()
    return column.flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 1), np.float32)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held: int = HELD, most: int = SAMPLE) -> Model | None:
    """The model from at most ``most`` trusted positives and as many unlabelled texts, none of the held fold."""
    trusted = sampled(labelled(labels, column, folds, held).filter("label = 1"), most)
    web = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (crc_fold("doc_id", folds) != held)).distinct()
    positive = _sample_features(with_texts(docs, trusted))
    unlabelled = _sample_features(with_texts(docs, sampled(web, most).withColumn("label", F.lit(None).cast("int"))))
    if not len(positive) or not len(unlabelled):
        return None
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    first = fit(p[::2], u[::2], 0.5)
    prior = class_prior(_forward(first, p[1::2])[1], _forward(first, u[1::2])[1]) if len(p) > 1 and len(u) > 1 else 0.5
    return Model(mean, scale, fit(p, u, prior), prior)


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()

    def work(part: Texts) -> pa.RecordBatch:
        p = np.zeros(len(part)) if shared.value is None else shared.value(features(part))
        return pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(p)], names=[id_column, "score"])

    return map_texts(docs.select(id_column, F.col(text).alias("text")), work, f"`{id_column}` {kind}, score double")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that are predicted to be good; all, if there is nothing to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def work(part: Texts) -> pa.RecordBatch:
        return part.rows if shared.value is None else part.rows.filter(pa.array(shared.value(features(part)) >= THRESHOLD))

    return map_texts(docs, work, docs.schema, text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``."""
    return score(docs, train(docs, labels)).select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
