"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are runs of letters and digits, in lower case. A token has as features itself and its beginnings of 3 to 8 bytes,
as inflected words share their stem. Over a bounded sample of labelled documents, a feature's log-odds of being among the
distinct tokens of toxic against other documents have an informative Dirichlet prior (the whole sample's rates); these are rates
a token, so that longer texts of a label favour no word. Features whose log-odds are at least EFFECT, and whose
likelihood ratio against equal rates is as sure as SURE standard deviations, are the lexicon. A token scores the largest log-odds of its features, and a token without any scores the log-odds
of not being in the lexicon, or less, so that the mean score of clean text is below zero. One scan over a text's tokens finds all
maximal segments (no part of one that is cut off at either end sums to less than zero, and none can be longer); those
whose score could hardly come from clean text are its toxic passages. How probable a score is follows the extreme-value law
of segment scores: lambda solves E[exp(lambda s)] = 1 over tokens of clean documents, K comes from their best segments.
A logistic function of the best passage's surprise, fitted on the sample and never falling, gives the score.

Null and empty texts have no tokens and score as such a text. Rows are scored each for itself, a null id too (its fold is
null). Without labels of both kinds every score is the share of toxic labels, or 0. Equal texts have equal scores. A very long text
is scanned whole and needs some 40 bytes a byte of text. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.labelled import labelled, sampled, with_texts
from tablecare.llm.links import discard, stored
from tablecare.llm.text import Texts, crc_fold, map_texts, mix, runs, span_hashes

#: Documents of each label that are learned from.
SAMPLE = 20_000
#: Features of the lexicon at most, the surest first; part of the model's size, not of what is scored.
LEXICON = 50_000
SURE = 5.0
#: Least log-odds of a feature: toxic text has it this many times (as a logarithm) as often.
EFFECT = 1.0
#: Weight of the prior, in tokens.
PRIOR = 500.0
PREFIXES = range(3, 9)
FOLDS, HELD = 5, 0
THRESHOLD = 0.5
#: Passages under this probability in clean text are reported.
SIGNIFICANT = 0.01
_TABLE = 1 << 20
#: Bytes of text whose features are counted at once, at some 80 bytes each.
_COUNT_BYTES = 3 << 20


_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
for _first, _last in ("09", "AZ", "az"):
    _LETTER[ord(_first) : ord(_last) + 1] = True


def tokens(part: Texts) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case (of Latin-1 letters too) and each token's first byte, end and row."""
    part = part.lower()
    data = part.data
    if len(data):
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[capital] += 32
    starts, ends = runs(_LETTER[data], part.offs)
    return part, starts, ends, part.row_of(starts)


def features(part: Texts, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of tokens that have a feature, and its hash: first whole tokens, then beginnings."""
    yield np.arange(len(starts)), span_hashes(part.data, starts, ends)
    padded = np.concatenate([part.data, np.zeros(8, np.uint8)])
    head = np.zeros(len(starts), np.uint64)
    at = np.arange(len(starts))
    for i in range(PREFIXES[-1]):
        at = at[ends[at] - starts[at] > i]
        head[at] |= padded[starts[at] + i].astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in PREFIXES:
            longer = at[ends[at] - starts[at] > i + 1]  # the whole token is there already
            yield longer, mix(head[longer] ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))


@dataclass
class Model:
    """keys and odds: the lexicon; miss: score of other tokens; lam, k: extreme-value law; a, b: from surprise to score."""

    keys: np.ndarray
    odds: np.ndarray
    miss: float = -0.01
    lam: float = 1.0
    k: float = 0.1
    a: float = 0.0
    b: float = -50.0

    def table(self) -> np.ndarray:
        found = np.zeros(_TABLE, bool)
        found[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        return found


def hits(part: Texts, model: Model, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the tokens that score above zero: index, score; then each token's start, end and row."""
    part, starts, ends, rows = tokens(part)
    best = np.zeros(len(starts))
    for at, keys in features(part, starts, ends):
        maybe = table[(keys >> np.uint64(44)).astype(np.int64)]
        at, keys = at[maybe], keys[maybe]
        if len(model.keys) and len(keys):
            where = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
            same = model.keys[where] == keys
            np.maximum.at(best, at[same], model.odds[where[same]])
    index = np.flatnonzero(best > 0)
    return index, best[index], starts, ends, rows


def segments(places: list[int], scores: list[float], miss: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments of a text in one scan: (score, first token, last token).

    ``places`` are the tokens that score above zero; each other token scores ``miss``. Segments wait on a list; a new one
    is joined with the nearest earlier one that starts lower, if it also ends higher than that one.
    """
    open_: list[list[float]] = []  # first and last token, sum before the first, sum up to the last, the next to ask
    total, seen = 0.0, 0
    for place, score in zip(places, scores):
        total += miss * (place - seen)
        seen = place + 1
        low, total = total, total + score
        first, last, high = place, place, total
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][2] >= low:
                j = open_[j][4]
            if j < 0 or open_[j][3] >= high:
                open_.append([first, last, low, high, j])
                break
            first, low = open_[j][0], open_[j][2]
            del open_[j:]
    return [(high - low, int(first), int(last)) for first, last, low, high, _ in open_]


def _by_row(index: np.ndarray, scores: np.ndarray, rows: np.ndarray, n: int) -> Iterator[tuple[int, int, list[int], list[float]]]:
    """Row, number of its tokens, places and scores of its hits; rows without hits are left out."""
    counts = np.bincount(rows, minlength=n)
    firsts = np.cumsum(counts) - counts
    of = rows[index]
    cuts = np.flatnonzero(np.diff(of)) + 1
    for own in np.split(np.arange(len(index)), cuts) if len(index) else ():
        row = int(of[own[0]])
        yield row, int(counts[row]), (index[own] - firsts[row]).tolist(), scores[own].tolist()


def surprise(best: np.ndarray, n: np.ndarray, lam: float, k: float) -> np.ndarray:
    """-ln of the probability that clean text of n tokens has a segment of this score."""
    expected = k * np.maximum(n, 1) * np.exp(-lam * np.minimum(best, 600 / lam))
    return -np.log(-np.expm1(-np.maximum(expected, 1e-300)))


def _distinct(part: Texts, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Distinct tokens of each document, summed for label 0 and 1."""
    words = span_hashes(part.data, starts, ends)
    order = np.lexsort((words, rows))
    rows, words = rows[order], words[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])
    return np.bincount(label[rows[first]], minlength=2)


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features whose log-odds are surely above zero: the documents that have them against all distinct tokens of documents."""
    def count(part: Texts) -> pa.RecordBatch:
        label = part.rows.column(0).to_numpy()
        low, starts, ends, rows = tokens(part)
        keys, of = [], []
        for at, found in features(low, starts, ends):
            keys.append(found)
            of.append(rows[at].astype(np.int32))
        keys, of = np.concatenate(keys), np.concatenate(of)
        order = np.lexsort((of, keys))
        keys, of = keys[order], of[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        whole = _distinct(low, starts, ends, rows, label)
        keys, toxic = keys[first], label[of[first]]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ones = np.add.reduceat(toxic, start) if len(start) else start
        many = np.diff(np.append(start, len(keys)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys[start].view(np.int64), 0)), pa.array(np.append(ones, whole[1]).astype(np.int64)), pa.array(np.append(many - ones, whole[0]).astype(np.int64))],
            names=["feature", "ones", "zeros"])

    counted = map_texts(sample, count, "feature long, ones long, zeros long", step=_COUNT_BYTES).groupBy("feature").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    # the row of feature 0 counts whole tokens, once a document
    counted = stored(counted, "features")
    total = counted.filter("feature = 0").agg(F.sum("ones"), F.sum("zeros")).first()
    ones, zeros = (x or 0 for x in total)
    prior = F.lit(PRIOR) * (F.col("ones") + F.col("zeros")) / F.lit(max(ones + zeros, 1))
    y, x = F.col("ones") + prior, F.col("zeros") + prior
    odds = F.log(y / (ones + PRIOR - y)) - F.log(x / (zeros + PRIOR - x))
    # the likelihood ratio holds for features that clean text never has, whose odds have no standard deviation to speak of
    share = ones / max(ones + zeros, 1)
    seen = F.col("ones") + F.col("zeros")
    ratio = F.col("ones") * F.log(F.col("ones") / (seen * share)) + F.when(F.col("zeros") > 0, F.col("zeros") * F.log(F.col("zeros") / (seen * (1 - share)))).otherwise(0.0)
    found = counted.filter("feature != 0 and ones > 2").withColumn("odds", odds).withColumn("z", F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))).filter(F.col("odds") > EFFECT)
    rows = found.filter(F.col("z") > SURE).orderBy(F.desc("z"), "feature").limit(LEXICON).toArrow()
    discard(counted)
    keys, odds = rows.column("feature").to_numpy().view(np.uint64), rows.column("odds").to_numpy()
    order = np.argsort(keys)
    return keys[order], odds[order]


def _measured(sample: DataFrame, model: Model) -> tuple[np.ndarray, ...]:
    """Of each sampled document: label, tokens, hits and best segment; and how often which score is in clean documents."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(part: Texts) -> pa.RecordBatch:
        model = shared.value
        label = part.rows.column(0).to_numpy()
        index, scores, _, _, rows = hits(part, model, model.table())
        best, found = np.zeros(len(part)), np.zeros(len(part), np.int64)
        for row, _, places, own in _by_row(index, scores, rows, len(part)):
            best[row] = max(s for s, _, _ in segments(places, own, model.miss))
            found[row] = len(own)
        grid, many = np.unique(np.round(scores[label[rows[index]] == 0], 3), return_counts=True)
        # documents first, then (-1, count, 0, score)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(label, np.full(len(grid), -1)).astype(np.int32)), pa.array(np.append(np.bincount(rows, minlength=len(part)), many)),
             pa.array(np.append(found, np.zeros(len(grid), np.int64))), pa.array(np.append(best, grid))], names=["label", "n", "found", "best"])

    rows = stored(map_texts(sample, measure, "label int, n long, found long, best double"), "measured")
    table, clean = rows.filter("label >= 0").toArrow(), rows.filter("label < 0").groupBy("best").agg(F.sum("n").alias("n")).toArrow()
    discard(rows)
    return (*(table.column(c).to_numpy() for c in ("label", "n", "found", "best")), np.stack([clean.column(c).to_numpy() for c in ("best", "n")]))


def _lambda(clean: np.ndarray, tokens_: int, miss: float, odds: np.ndarray) -> float:
    """The root above zero of E[exp(lambda s)] = 1; one imagined hit of middling score keeps it finite.

    The mean of s is below zero (see ``_miss``), so there is one root.
    """
    values, many = np.append(clean[0], np.median(odds) if len(odds) else 1.0), np.append(clean[1], 1)
    share = 1 / max(tokens_, 2 * many.sum())

    def over(lam: float) -> bool:
        return share * (many * np.exp(lam * values)).sum() + (1 - share * many.sum()) * np.exp(lam * miss) > 1

    low, high = 1e-6, 1.0
    while not over(high) and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def _miss(toxic: float, clean: float, scores: np.ndarray, tokens_: int) -> float:
    """The score of tokens outside the lexicon, from the rates of hits in toxic and clean text.

    It is the log-odds of no hit, or what makes clean tokens score half of what their hits bring below zero, if that is lower.
    """
    gained = (scores[0] * scores[1]).sum() / max(tokens_, 1)
    return min(-1e-3, float(np.log((1 - toxic) / (1 - clean))), -1.5 * gained / max(1 - clean, 0.1))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method for one input, with a little ridge; the slope is not below zero."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (weight * (p - y)) + 1e-3 * w
        hess = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    if w[0] < 0:  # surprise never speaks for clean text: the share of toxic documents alone
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-9, 1 - 1e-9)
        return 0.0, float(np.log(share / (1 - share)))
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held: int = HELD, most: int = SAMPLE) -> Model:
    """The model from at most ``most`` labelled documents of each kind, none of the held fold."""
    rows = labelled(labels, column, folds, held)
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    if not ones or not zeros:
        empty.b = 50.0 if ones else -50.0
        return empty
    sample = with_texts(docs, sampled(rows.filter("label = 1"), most).unionByName(sampled(rows.filter("label = 0"), most)))
    model = Model(*_lexicon(sample))
    label, n, found, _, clean = _measured(sample, model)
    if not len(label):
        empty.b = float(np.log(ones / zeros))
        return empty
    toxic = label == 1
    rate = [(found[own].sum() + 0.5) / (n[own].sum() + 1000.0) for own in (toxic, ~toxic)]
    model.miss = _miss(*rate, clean, int(n[~toxic].sum()))
    model.lam = _lambda(clean, int(n[~toxic].sum()), model.miss, model.odds)
    label, n, found, best, clean = _measured(sample, model)
    # K by maximum likelihood of the clean documents' best scores under exp(-K n exp(-lambda s)), no passage being a score of 0
    model.k = float(np.clip((~toxic).sum() / max((n[~toxic] * np.exp(-model.lam * np.minimum(best[~toxic], 600 / model.lam))).sum(), 1.0), 1e-6, 1.0))
    weight = np.where(toxic, ones / max(toxic.sum(), 1), zeros / max((~toxic).sum(), 1))
    model.a, model.b = _logistic(surprise(best, n, model.lam, model.k).clip(0, 100), label.astype(float), weight / weight.sum() * len(label))
    return model


def judge(part: Texts, model: Model, table: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """The score of each text, and its significant passages."""
    index, scores, starts, ends, rows = hits(part, model, table)
    best, n = np.zeros(len(part)), np.bincount(rows, minlength=len(part))
    firsts = np.cumsum(n) - n
    found: list[list[dict]] = [[] for _ in range(len(part))]
    for row, many, places, own in _by_row(index, scores, rows, len(part)):
        parts = segments(places, own, model.miss)
        best[row] = max(s for s, _, _ in parts)
        sure = np.log(model.k * many / SIGNIFICANT) / model.lam
        found[row] = [{"score": s, "first": int(starts[firsts[row] + a] - part.offs[row]), "end": int(ends[firsts[row] + b] - part.offs[row])}
                      for s, a, b in parts if s > sure]
    x = surprise(best, n, model.lam, model.k).clip(0, 100)
    return 1 / (1 + np.exp(-np.clip(model.a * x + model.b, -500, 500))), found


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, n_passages, passages) per row; passages: score, first and end byte of each significant toxic passage."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))
    kind = docs.schema[id_column].dataType.simpleString()
    spans = pa.list_(pa.struct([("score", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))

    def work(part: Texts) -> pa.RecordBatch:
        p, found = judge(part, *shared.value)
        return pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(p), pa.array([len(x) for x in found], pa.int32()), pa.array(found, spans)],
                                          names=[id_column, "score", "n_passages", "passages"])

    return map_texts(docs.select(id_column, F.col(text).alias("text")), work,
                     f"`{id_column}` {kind}, score double, n_passages int, passages array<struct<score: double, first: bigint, `end`: bigint>>")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that are not predicted to be toxic."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, model.table()))

    def work(part: Texts) -> pa.RecordBatch:
        return part.rows.filter(pa.array(judge(part, *shared.value)[0] < THRESHOLD))

    return map_texts(docs, work, docs.schema, text)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) per row of ``docs``."""
    return score(docs, train(docs, labels)).select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
