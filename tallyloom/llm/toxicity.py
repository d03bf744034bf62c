"""Toxicity of texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (3 to 5) that occur in the lower-cased text, white space folded.
A feature's value is its log-count ratio between toxic and clean training texts, each text scaled to unit
length; logistic regression learns the weights. The ratios count all training texts (per task, then a
grouped sum); the weights come from at most about ``SAMPLE_PER_CLASS`` texts of each class, chosen by a hash of
their id, the one documented bound. Scoring gathers the weights of a text's features, whatever its length.

Edge cases: a null text counts as empty, and an empty text scores by the intercept alone; labels that are null or not
0 or 1 are not learned; a repeated row is learned and scored as often as it occurs; a null id is held out; without
texts of both classes every score is the smoothed share of label 1. Other columns are never looked at.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.arrow import small_batches
from tallyloom.llm.common import broadcast_below

BITS = 18
ORDERS = (3, 4, 5)
SAMPLE_PER_CLASS = 3000
ROUNDS, STEP, MOMENTUM, DECAY, SMOOTHING = 60, 8.0, 0.9, 1e-4, 1.0
#: Odd multipliers of the n-gram hash.
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of a text."""
    folded = f" {' '.join((text or '').lower().split())} "
    chars = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = np.zeros(1 << BITS, bool)
    for n in ORDERS:
        size = len(chars) - n + 1
        if size < 1 or len(folded) < 3:
            continue
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = (h ^ chars[k:k + size]) * MIX[k]
        h = (h ^ (h >> np.uint64(29))) * MIX[5]
        seen[h >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many toxic and clean texts hold each bucket; bucket -1 counts the texts."""
    totals = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            row = totals[1 - toxic.as_py()]
            row[features(text.as_py())] += 1
            row[-1] += 1
    at = np.flatnonzero(totals.any(axis=0))
    bucket = np.where(at == 1 << BITS, -1, at).astype(np.int32)
    for s in range(0, len(at), 1 << 16):
        part = slice(s, s + (1 << 16))
        yield pa.record_batch([pa.array(bucket[part]), pa.array(totals[0][at[part]]), pa.array(totals[1][at[part]])],
                              ["bucket", "toxic", "clean"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(1).cast(pa.int32()),
                               pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())],
                              ["toxic", "buckets"])


def log_count_ratios(counts: pd.DataFrame) -> np.ndarray:
    """Log ratio of the smoothed shares of toxic and clean texts that hold a bucket."""
    total = counts[counts.bucket == -1]
    n = (int(total.toxic.sum()), int(total.clean.sum()))
    held = np.zeros((2, 1 << BITS))
    own = counts[counts.bucket >= 0]
    held[0][own.bucket], held[1][own.bucket] = own.toxic, own.clean
    share = [(held[k] + SMOOTHING) / (n[k] + 2 * SMOOTHING) for k in (0, 1)]
    return np.log(share[0] / share[1])


def fit(toxic: np.ndarray, buckets: list[np.ndarray], ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression on unit-length ratio vectors; both classes count alike."""
    sizes = np.array([len(b) for b in buckets])
    keep = sizes > 0
    col = np.concatenate([b for b in buckets if len(b)])
    sizes, y = sizes[keep], toxic[keep].astype(float)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    row = np.repeat(np.arange(len(y)), sizes)
    value = ratios[col]
    value /= np.sqrt(np.maximum(np.add.reduceat(value * value, starts), 1e-12))[row]
    share = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w, b, speed, bias_speed = np.zeros(1 << BITS), 0.0, np.zeros(1 << BITS), 0.0
    for _ in range(ROUNDS):
        error = (1 / (1 + np.exp(-np.add.reduceat(value * w[col], starts) - b)) - y) * share
        gradient = np.bincount(col, weights=value * error[row], minlength=1 << BITS) + DECAY * w
        speed, bias_speed = MOMENTUM * speed - STEP * gradient, MOMENTUM * bias_speed - STEP * error.sum()
        w, b = w + speed, b + bias_speed
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> dict:
    """The model of the labelled rows that are not held out: ``ratios``, ``weights`` and ``bias``, arrays of a
    fixed size. One pass counts, one pass brings the sample to a single task."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).select(
        F.col(key).alias("__key"), F.col(label).cast("int").alias("toxic"))
    per_class = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(per_class) < 2:
        n = sum(per_class.values())
        share = (per_class.get(1, 0) + 1) / (n + 2)
        return {"ratios": np.zeros(1 << BITS), "weights": np.zeros(1 << BITS), "bias": float(np.log(share / (1 - share)))}
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(broadcast_below(known), "__key")
    counts = (texts.select("text", "toxic").mapInArrow(_count, "bucket int, toxic long, clean long")
              .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas())
    ratios = log_count_ratios(counts)
    keep = F.lit(False)
    for value, n in per_class.items():
        bound = int(min(1.0, SAMPLE_PER_CLASS / n) * (1 << 20))
        keep = keep | ((F.col("toxic") == value) & (F.pmod(F.xxhash64("__key", F.lit(7)), F.lit(1 << 20)) < bound))
    shared = spark.sparkContext.broadcast(ratios)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        w, b = fit(rows["toxic"].to_numpy(), [np.frombuffer(x, np.int32) for x in rows["buckets"]], shared.value)
        return pd.DataFrame({"weights": [w.astype(np.float64).tobytes()], "bias": [b]})

    model = (texts.where(keep).select("text", "toxic").mapInArrow(_rows, "toxic int, buckets binary")
             .groupBy().applyInPandas(learn, "weights binary, bias double").first())
    if model is None:  # labels without documents
        return {"ratios": ratios, "weights": np.zeros(1 << BITS), "bias": 0.0}
    return {"ratios": ratios, "weights": np.frombuffer(model["weights"], np.float64), "bias": model["bias"]}


def score_toxicity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from 0.5 on)."""
    small_batches(docs.sparkSession)
    ratios = model["ratios"].astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((ratios * ratios, (ratios * model["weights"]).astype(np.float32)))
    bias = model["bias"]

    def score(texts: pa.Array) -> pa.Array:
        squares, weighted = shared.value
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            at = features(t.as_py())
            norm = np.sqrt(max(float(squares[at].sum(dtype=np.float64)), 1e-12))
            out[k] = float(weighted[at].sum(dtype=np.float64)) / norm + bias
        return pa.array(1 / (1 + np.exp(-out)))

    scored = docs.withColumn("score", F.arrow_udf(score, "double")(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
