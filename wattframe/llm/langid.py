"""Languages of a text as a mixture: each document's language shares by expectation-maximisation.

A language is a distribution over hashed letter trigrams, learned from labelled documents. The trigrams of a
document are explained by a mixture of these; EM estimates the shares. Which languages belong to the set is decided
by the likelihood less a penalty per language: sets of the 1, 2, .. all largest shares are refitted and compared. The
predicted language is the one with the largest share of the chosen set.

The trigram models are fitted on a sample of labelled documents whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about this many labelled documents are fitted on, chosen by a hash of their ids.
MAX_TRAINING_DOCUMENTS = 20_000
UNKNOWN = "und"
BUCKET_BITS = 16
SMOOTHING = 0.5
PENALTY = 4.0
EM_STEPS = 10
REFIT_STEPS = 6
_BATCH_LETTERS = 1_000_000
_NOTHING = np.empty(0, np.int64)
DETECTED = "lang_pred string, score double, languages array<struct<lang: string, share: double>>"


class Trigrams:
    """Counts the hashed trigrams of the letters of a text, words separated by single blanks."""

    def __init__(self) -> None:
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(distinct buckets, counts); empty without a letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.is_letter[points]
        if not letter.any():
            return _NOTHING, _NOTHING
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        line = np.concatenate([[32], np.where(letter, points, 32)[keep], [32]]).astype(np.uint64)
        h = line[:-2] * np.uint64(0x9E3779B97F4A7C15) + line[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + line[2:] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(64 - BUCKET_BITS))[line[1:-1] != 32]
        return np.unique(h.astype(np.int64), return_counts=True)


@dataclass(frozen=True)
class LanguageModel:
    """Names, and per bucket and language the probability of the bucket."""

    names: list[str]
    probability: np.ndarray

    def mixtures(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Shares of the chosen set per document (rows add up to 1); no document may be empty."""
        doc = np.repeat(np.arange(len(grams)), [len(b) for b, _ in grams])
        start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.concatenate([c for _, c in grams]).astype(np.float32)
        p = self.probability[np.concatenate([b for b, _ in grams])]
        n = np.add.reduceat(count, start)

        def em(shares: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(steps):
                part = p * shares[doc]
                part *= (count / part.sum(axis=1))[:, None]
                shares = np.add.reduceat(part, start, axis=0) / n[:, None]
            likelihood = np.add.reduceat(count * np.log((p * shares[doc]).sum(axis=1)), start)
            return shares, likelihood

        size = len(self.names)
        shares, _ = em(np.full((len(grams), size), 1 / size, np.float32), EM_STEPS)
        rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1)
        best, best_value = shares, np.full(len(grams), -np.inf)
        for members in range(1, size + 1):
            within = np.where(rank < members, shares, 0) + np.float32(1e-12)
            fitted, likelihood = em(within / within.sum(axis=1, keepdims=True), REFIT_STEPS if members > 1 else 0)
            value = likelihood - PENALTY * members * np.log(n + 1)
            better = value > best_value
            best = np.where(better[:, None], np.where(rank < members, fitted, 0), best)
            best_value = np.maximum(value, best_value)
        return best / best.sum(axis=1, keepdims=True)


def usable_for_training(row_id: str = "doc_id"):
    """Three quarters of the ids; the others are held out."""
    return F.crc32(F.col(row_id).cast("string")) % 4 != 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task, added up per language before anything is sent."""
    trigrams, sums = Trigrams(), {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            bucket, n = trigrams(text)
            if lang not in sums:
                sums[lang] = np.zeros(1 << BUCKET_BITS, np.int64)
            sums[lang][bucket] += n
    for lang, count in sums.items():
        bucket = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket), pa.array(count[bucket])], ["lang", "bucket", "n"])


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id",
    max_documents: int = MAX_TRAINING_DOCUMENTS,
) -> LanguageModel:
    """The model of the labelled documents that are not held out; null ids, languages and texts are left out.

    Every language has a trigram table of at most 65,536 counts, which is all that reaches the driver.
    """
    usable = docs.where(F.col(row_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & usable_for_training(row_id))
    ids = usable.select(F.col(row_id).alias("_id"))
    share = F.pmod(F.xxhash64(F.col("_id")), F.lit(1_000_000)) < 1_000_000 * max_documents / max(ids.count(), 1)
    sample = usable.select(F.col(row_id).alias("_id"), F.col(lang).cast("string").alias("lang"),
                           F.col(text).cast("string").alias("text")).where(share)
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, bucket bigint, n bigint")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    table = np.full((1 << BUCKET_BITS, len(names)), SMOOTHING)
    table[rows.column("bucket").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] += rows.column("n").to_numpy()
    return LanguageModel(names, (table / table.sum(axis=0)).astype(np.float32))


def detect_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows with `lang_pred`, `score` (its share) and `languages` (the chosen set with shares, largest first).

    Columns of these names are replaced. Null texts and texts without a letter, and all texts if nothing was
    learned, are `und` with score 0 and no languages. Equal shares go to the first name. Whole texts are read, in
    blocks of bounded length (a longer text is a block of its own); nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DETECTED)
    def detected(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, trigrams = shared.value, Trigrams()

        def block(part: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
            rows = [{"lang_pred": UNKNOWN, "score": 0.0, "languages": []} for _ in part]
            full = [i for i, (b, _) in enumerate(part) if len(b)]
            if full and known.names:
                for i, shares in zip(full, known.mixtures([part[i] for i in full]), strict=True):
                    order = [x for x in np.argsort(-shares, kind="stable") if shares[x] > 0]
                    rows[i] = {"lang_pred": known.names[order[0]], "score": float(min(shares[order[0]], 1.0)),
                               "languages": [{"lang": known.names[x], "share": float(shares[x])} for x in order]}
            return rows

        for batch in texts:
            rows, part, letters = [], [], 0
            for value in batch:
                part.append(trigrams(value))
                letters += len(value or "")
                if letters >= _BATCH_LETTERS:
                    rows += block(part)
                    part, letters = [], 0
            yield pd.DataFrame(rows + block(part), columns=["lang_pred", "score", "languages"])

    names = ("lang_pred", "score", "languages")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    result = docs.select(*kept, detected(F.col(text).cast("string")).alias("_detected"))
    return result.select(*kept, *[F.col(f"_detected.{n}").alias(n) for n in names])
