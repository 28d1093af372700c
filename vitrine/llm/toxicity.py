"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Every sentence s has a probability
p_s = sigmoid(bias + sum of the weights of its words' features), and the bag's
is the noisy-or 1 - prod(1 - p_s): one offending sentence is enough.  Only
document labels are needed to train, by gradient ascent on the bags'
log-likelihood; the sentence scores then tell where the offence is.

Features of a word (lower-cased letters): the word itself and its beginnings of
four to six letters, hashed into a fixed number of weights, so that inflected
forms of an offending stem share weights.  Language, source and
id are never features.

Scale: the fit takes a bounded, documented sample of labelled rows
(``sample_rows`` and ``sample_chars``), chosen by a hash of the id; scoring is
one pass over all texts without a shuffle, with a model of fixed size.

Edge cases: null and empty texts have no sentence and score 0.0; null labels
are not learnt from; without any label, or with one class only, every score is
0.0; repeated rows are scored alike; other columns of the input, whatever
their names, are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold

BUCKETS = 1 << 18
LETTERS = re.compile(r"[^\W\d_]+")
#: A sentence ends at a line break or at white space behind . ! or ?; the separator is one character.
SENTENCE_END = re.compile(r"(?<=[.!?])\s|\n")
#: Smaller weights are set to zero after the fit.
LEAST_WEIGHT = 0.25
WORD_CACHE = 400_000
SCORE_TYPE = "struct<score:double,offending:array<struct<start:int,stop:int,score:double>>>"


@dataclass
class ToxicityModel:
    """weights of all features and the sentence bias, of fixed size."""

    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[int]:
    """Feature numbers of one lower-cased word."""
    names = ["w" + word, *("b" + word[:n] for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


def bags_of(texts: Iterable[str | pa.Scalar], labels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse bags: features, their sentence, each sentence's document, the labels."""
    known: dict[str, list[int]] = {}
    feats, sent, doc = array("i"), array("i"), array("i")  # compact: lists of ints would take ten times the memory
    for d, text in enumerate(texts):
        for line in SENTENCE_END.split(text if isinstance(text, str) else text.as_py()):
            found = set()
            for word in LETTERS.findall(line.lower()):
                if word not in known:
                    known[word] = word_features(word)
                found.update(known[word])
            if found:
                feats.extend(found)
                sent.extend(repeat(len(doc), len(found)))
                doc.append(d)
    return tuple(np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (feats, sent, doc)) + (np.array(labels, np.float64),)


def ascend(feats, sent, doc, labels, w, b, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adagrad on the mean noisy-or log-likelihood of the bags, with an L2 decay."""
    n_docs, n_sent, positive = len(labels), len(doc), labels > 0.5
    gw, gb = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.clip(b + np.bincount(sent, w[feats], n_sent), -30, 30)
        p = 1 / (1 + np.exp(-z))
        some = np.maximum(np.bincount(doc, np.log1p(np.exp(z)), n_docs), 1e-9)  # -log of "no sentence offends"
        per_doc = np.where(positive, np.exp(-some) / -np.expm1(-some), -1.0) / n_docs
        grad = per_doc[doc] * p
        dw = np.bincount(feats, grad[sent], BUCKETS) - decay * w
        db = grad.sum()
        gw += dw * dw
        gb += db * db
        w = w + rate * dw / np.sqrt(gw)
        b = b + rate * db / np.sqrt(gb)
    return w, b


def fit_bags(feats, sent, doc, labels, features: int = 600) -> ToxicityModel:
    """Fit all features briefly, keep those with the largest weights, and fit these to the end."""
    n_docs = len(labels)
    if not len(feats) or labels.min() == labels.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -math.inf)
    # features that occur in under three bags can't be learnt from labels that may hold mistakes
    bags = np.unique(feats.astype(np.int64) * n_docs + doc[sent]) // n_docs
    keep = (np.bincount(bags, minlength=BUCKETS) >= 3)[feats]
    feats, sent = feats[keep], sent[keep]
    w, b = ascend(feats, sent, doc, labels, np.zeros(BUCKETS), -5.0, 40, 0.4, 1e-5)
    best = np.zeros(BUCKETS, bool)
    best[np.argsort(-np.abs(w), kind="stable")[:features]] = True
    keep = best[feats]
    w, b = ascend(feats[keep], sent[keep], doc, labels, np.where(best, w, 0), b, 150, 0.3, 1e-5)
    w[np.abs(w) < LEAST_WEIGHT] = 0
    return ToxicityModel(w.astype(np.float32), float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_chars: int = 16_000_000) -> ToxicityModel:
    """Fit on at most sample_rows labelled documents of at most sample_chars characters in all, in the order of a hash of the id.

    A text of over a sixteenth of sample_chars takes no part.
    Held-out rows (crc32 of the id as text, modulo 5, is 0) never take part.
    The fit is one task's work, and only the weights come to the driver.
    """
    rank = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("rank", rank).orderBy("rank", "doc_id").limit(sample_rows)
    )
    # the chosen ids are few by the limit above, whatever the tables' sizes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    # a text that would take a large part of the room for all is left out, and the others go on
    rows = rows.withColumn("n", F.length("text")).where(F.col("n") <= max(1, sample_chars // 16))
    rows = rows.orderBy("rank", "doc_id", F.xxhash64("text")).limit(sample_rows)
    upto = Window.orderBy("rank", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)
    sample = rows.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") <= sample_chars).select("text", "toxic")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts.extend(batch["text"])
            toxic.extend(batch["toxic"].to_pylist())
        if texts:
            model = fit_bags(*bags_of(texts, toxic))
            at = np.flatnonzero(model.weights).astype("<i4")
            yield pa.record_batch([pa.array([at.tobytes()], pa.binary()), pa.array([model.weights[at].tobytes()], pa.binary()), pa.array([model.bias])], ["features", "weights", "bias"])

    # the window leaves the bounded sample, in its order, in one partition
    found = sample.mapInArrow(fit, "features binary, weights binary, bias double").collect()
    weights = np.zeros(BUCKETS, np.float32)
    for row in found:
        weights[np.frombuffer(row["features"], "<i4")] = np.frombuffer(row["weights"], np.float32)
    return ToxicityModel(weights, found[0]["bias"] if found else -math.inf)


class Scorer:
    """Scores texts; each distinct token's weights are looked up once and remembered, up to a bound."""

    def __init__(self, model: ToxicityModel):
        self.bias = model.bias
        self.weights = {i: float(model.weights[i]) for i in np.flatnonzero(model.weights).tolist()}
        self.known: dict[str, tuple[int, ...] | bool] = {}
        self.plain = math.log1p(math.exp(model.bias)) if model.bias < 0 else model.bias + math.log1p(math.exp(-model.bias))

    def token(self, raw: str) -> tuple[int, ...] | bool:
        """The token's features that have weights, or False."""
        feats = {f for word in LETTERS.findall(raw.lower()) for f in word_features(word)}
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        out = self.known[raw] = tuple(sorted(feats & self.weights.keys())) or False
        return out

    def __call__(self, text: str | None) -> tuple[float, list[dict]]:
        none, at, where = 0.0, 0, []
        get = self.known.get
        for sentence in SENTENCE_END.split(text or ""):
            tokens = sentence.split()
            if tokens:
                got = list(map(get, tokens))
                if None in got:
                    got = [self.token(t) if g is None else g for t, g in zip(tokens, got, strict=True)]
                if any(got):
                    z = self.bias + math.fsum(self.weights[f] for f in {f for g in got if g for f in g})
                    none += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                    if z >= 0:
                        where.append({"start": at, "stop": at + len(sentence), "score": 1 / (1 + math.exp(-z))})
                else:
                    none += self.plain
            at += len(sentence) + 1
        return min(1.0, max(0.0, -math.expm1(-none))), where


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add column ``out``: the document's score and the offending sentences (start, stop in code points, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORE_TYPE)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            got = [scorer(t) for t in texts]
            yield pd.DataFrame({"score": [g[0] for g in got], "offending": [g[1] for g in got]})

    return docs.withColumn(out, judge(F.col(text)))
