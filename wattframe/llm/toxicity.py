"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its distinct words; a document's is the noisy-or of its
sentences, 1 - product of (1 - p), together with one leak term for labels that no sentence explains. The weights
follow from the document labels alone, through that product. A scored document then names its offending sentences.

The classifier is fitted on a sample of labelled documents whose size is a parameter. Vocabulary counts of the
sample are taken on the executors; the driver gets word numbers per sentence, for the chosen words only, and fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.sizes import broadcast_if_small
from wattframe.session import materialize

#: At most about this many labelled documents are fitted on, chosen by a hash of their ids.
MAX_TRAINING_DOCUMENTS = 20_000
VOCABULARY = 2_000
MIN_DOCUMENTS = 3
#: Of the log likelihood ratio; a word that says nothing has about one chance in ten thousand.
MIN_EVIDENCE = 8.0
STEM = 4
THRESHOLD = 0.7
OFFENDING = 0.5
STEPS = 250
RATE = 0.1
L2 = 1e-7
MIN_WEIGHT = 0.02

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")
SCORED = "score double, predicted int, offending array<struct<start: int, end: int, score: double>>"


def _features(sentence: str) -> set[str]:
    """The distinct words, and the first letters of longer ones (`lett*`) for inflected and compound forms."""
    words = set(_WORD.findall(sentence.lower()))
    words.update([w[:STEM] + "*" for w in words if len(w) > STEM])
    return words


@dataclass(frozen=True)
class ToxicityModel:
    """A logistic weight per feature, the logit of a sentence without any of them, and the leak's logit."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    leak: float = -30.0

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and its offending sentences (start, end, probability)."""
        weights, offending = self.weights, []
        total, plain = _softplus(self.leak), 0
        for found in _SENTENCE.finditer(text or ""):
            known = [weights[w] for w in _features(found.group()) if w in weights]
            if not known:
                plain += 1
                continue
            logit = self.bias + sum(known)
            total += _softplus(logit)
            if logit >= _OFFENDING_LOGIT:
                offending.append((found.start(), found.end(), float(1 / (1 + np.exp(-logit)))))
        total += plain * _softplus(self.bias)
        return float(-np.expm1(-total)), offending


_OFFENDING_LOGIT = float(np.log(OFFENDING / (1 - OFFENDING)))


def _softplus(x: float) -> float:
    """-log(1 - sigmoid(x))"""
    return float(np.logaddexp(0.0, x))


def usable_for_training(row_id: str = "doc_id"):
    """Two thirds of the ids; the others are held out."""
    return F.crc32(F.col(row_id).cast("string")) % 3 != 1


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = batch.column("text").to_pylist(), batch.column("label")
        words = [[sorted(_features(s)) for s in _SENTENCE.findall(t or "")] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [labels, pa.array(words, pa.list_(pa.list_(pa.string())))], ["label", "sentences"])


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "toxic",
    max_documents: int = MAX_TRAINING_DOCUMENTS,
) -> ToxicityModel:
    """The model of the labelled documents that are not held out.

    Null ids and null labels are left out; an id labelled several times counts as toxic if one label says so;
    repeated documents count each. Without labels of both kinds the model knows no word and scores everything at
    the leak, which then is the (smoothed) share of toxic labels, 0 without labels.
    """
    marked = labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull() & usable_for_training(row_id))
    marked = marked.groupBy(F.col(row_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = marked.count()
    share = F.pmod(F.xxhash64(F.col("_id")), F.lit(1_000_000)) < 1_000_000 * max_documents / max(n, 1)
    marked = broadcast_if_small(materialize(marked.where(share), "training-labels"), 2 * max_documents)
    sample = docs.select(F.col(row_id).alias("_id"), F.col(text).cast("string").alias("text")).join(marked, "_id")
    tokens = materialize(
        sample.select("label", "text").mapInArrow(_tokenize, "label int, sentences array<array<string>>"), "training-words")

    sums = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not 0 < sums["toxic"] < sums["n"]:
        rate = sums["toxic"] / sums["n"] if sums["n"] else 0.0
        rate = min(max(rate, 1e-9), 1 - 1e-9)
        return ToxicityModel(leak=float(np.log(rate) - np.log1p(-rate)))
    vocabulary = {w: i for i, w in enumerate(_choose_words(tokens, sums["n"], sums["toxic"]))}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, places, words = [], [], []
            for sentences in batch.column("sentences").to_pylist():
                known = [[vocabulary[w] for w in s if w in vocabulary] for s in sentences]
                plain.append(sum(not k for k in known))
                known = [k for k in known if k]
                places.append([i for i, k in enumerate(known) for _ in k])
                words.append([w for k in known for w in k])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(plain, pa.int32()), pa.array(places, kind), pa.array(words, kind)],
                ["label", "plain", "places", "words"])

    rows = tokens.mapInArrow(numbers, "label int, plain int, places array<int>, words array<int>").toArrow()
    weights, bias, leak = _fit(rows, len(vocabulary))
    kept = {w: float(weights[i]) for w, i in vocabulary.items() if abs(weights[i]) >= MIN_WEIGHT}
    return ToxicityModel(kept, bias, leak)


def _choose_words(tokens: DataFrame, n: int, toxic: int) -> list[str]:
    """The words whose presence in a document says most about its label (likelihood ratio of the 2 x 2 table)."""
    words = tokens.select("label", F.explode(F.array_distinct(F.flatten("sentences"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("k"), F.sum("label").alias("t")).where(F.col("k") >= MIN_DOCUMENTS)
    k, t = F.col("k"), F.col("t")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = (term(t, k * toxic / n) + term(k - t, k * (n - toxic) / n)
          + term(toxic - t, (n - k) * toxic / n) + term(n - k - toxic + t, (n - k) * (n - toxic) / n))
    best = counts.select("word", g2.alias("g2")).where(F.col("g2") >= MIN_EVIDENCE).orderBy(F.col("g2").desc(), "word").limit(VOCABULARY)
    return [r["word"] for r in best.collect()]


def _fit(rows: pa.Table, size: int) -> tuple[np.ndarray, float, float]:
    """Minimises the noisy-or log loss plus L2 with Adam; gradients of the whole sample."""
    def flat(name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    y = rows.column("label").to_numpy().astype(float)
    plain = rows.column("plain").to_numpy().astype(float)
    lengths = np.array([len(x) for x in rows.column("words").to_pylist()], np.int64)
    doc_of_entry = np.repeat(np.arange(len(y)), lengths)
    word, place = flat("words"), flat("places")
    new = np.ones(len(word), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc_of_entry[1:] != doc_of_entry[:-1])
    sentence = np.cumsum(new) - 1
    doc = doc_of_entry[new]

    params = np.zeros(size + 2)
    params[-2:] = -6.0, np.log(max(y.mean(), 1e-6)) - 1.0
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, bias, leak = params[:-2], params[-2], params[-1]
        logit = bias + np.bincount(sentence, w[word], len(doc))
        total = np.bincount(doc, np.logaddexp(0.0, logit), len(y)) + plain * np.logaddexp(0.0, bias) + np.logaddexp(0.0, leak)
        # d loss / d total: 1 for label 0, -1 / (e^total - 1) for label 1
        slope = np.where(y > 0, -1.0 / np.maximum(np.expm1(np.minimum(total, 50.0)), 1e-6), 1.0) / len(y)
        each = slope[doc] / (1.0 + np.exp(-logit))
        grad = np.empty_like(params)
        grad[:-2] = np.bincount(word, each[sentence], size) + L2 * w
        grad[-2] = each.sum() + (slope * plain).sum() / (1.0 + np.exp(-bias))
        grad[-1] = slope.sum() / (1.0 + np.exp(-leak))
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        params = params - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return params[:-2], float(params[-2]), float(params[-1])


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows with `score`, `predicted` (score >= 0.7) and `offending` (code points, end exclusive).

    Columns of these names are replaced. Null and empty texts have no sentences and score at the leak. Whole texts
    are scored, one at a time; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORED)
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in texts:
            rows = [known.score(t) for t in batch]
            score = np.array([s for s, _ in rows], float)
            yield pd.DataFrame({
                "score": score, "predicted": (score >= THRESHOLD).astype(np.int32),
                "offending": [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in rows]})

    names = ("score", "predicted", "offending")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    result = docs.select(*kept, scored(F.col(text).cast("string")).alias("_scored"))
    return result.select(*[c for c in kept], *[F.col(f"_scored.{n}").alias(n) for n in names])
