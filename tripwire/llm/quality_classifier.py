"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features. A text is cut into letter runs, digit runs and symbol runs; every token and every pair of
neighbours is hashed into 2**18 slots, and every pair of equal neighbours into one slot more. A slot's value is log(1 + count), scaled so that a text's
vector has length one: a score is then a sparse dot product that does not depend on the text length.

Training. Labelled rows outside the held-out fold are spread over shards of about `shard_rows` rows by
a hash of their id. Each shard runs FTRL-proximal (per-coordinate rates, L1 and L2) for some epochs over its
rows in hash order, and the shards' weights are averaged. `max_rows` bounds the labelled rows used
(documented parameter of the operator): with more labels every row is kept with the same hash-decided
probability. A shard's examples (about shard_rows texts, as sparse vectors) are all that one
task holds; the driver receives the averaged weights, at most 2**18 numbers.

Scoring is one Arrow pass over all rows with the weights as broadcast (2 MB, fixed by the slots).

Null and empty texts have no features: their score is the bias alone. Labels, lang, source and ids are
never features. Rows of `labels` with a null label or without document are ignored; conflicting or
repeated label rows of a document are each an example. Without any label all scores are 0.5. Repeated
documents get equal scores; extra columns pass through `score`.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tripwire.llm.common import crc_of_id, table

SLOTS_LOG2 = 18
SLOTS = 1 << SLOTS_LOG2
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
THRESHOLD = 0.3
FOLDS = 5
TWIN = 0xD1B54A32D192ED03  # hash of the pair "a token and itself again", whatever the token is


def features(text, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text, slots ascending; `cache` remembers token hashes within a task."""
    tokens = TOKEN.findall(text) if isinstance(text, str) else []
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(cache) > 500_000:
        cache.clear()
    for t in set(tokens):
        if t not in cache:
            cache[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    twins = np.full(int((h[:-1] == h[1:]).sum()), TWIN, np.uint64)
    mixed = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), pairs, twins]) >> np.uint64(64 - SLOTS_LOG2)
    slots, counts = np.unique(mixed.astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    return slots, values / math.sqrt(float(values @ values))


class Ftrl:
    """FTRL-proximal with per-coordinate rates over dense state vectors; the last slot is the bias."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w @ values)))))
        g = (p - label) * values
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g


def train(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id", epochs: int = 3,
          max_rows: int = 40_000, shard_rows: int = 5_000, alpha: float = 8.0, beta: float = 1.0, l1: float = 0.01,
          l2: float = 0.01) -> np.ndarray:
    """Averaged weights (slots, then bias) from the documents that have a 0/1 label."""
    rows = labels.filter(F.col(label).isin(0, 1)).select(doc_id, label)
    count = rows.count()
    if not count:
        return np.zeros(SLOTS + 1)
    shards = max(1, round(min(count, max_rows) / shard_rows))
    draw = F.xxhash64(doc_id, F.lit("sample"))
    part = F.pmod(F.xxhash64(doc_id, F.lit("shard")), F.lit(shards))
    # the sample is drawn from the labels alone: about max_rows ids at most, so they can be broadcast
    # and only the sampled texts are ever shuffled
    chosen = rows.filter(F.pmod(draw, F.lit(1 << 30)) < int(min(1.0, max_rows / count) * (1 << 30)))
    bounded = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).select(
        part.alias("shard"), draw.alias("draw"), F.col(text).alias("text"), F.col(label).alias("label"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "label"], kind="stable")
        cache: dict = {}
        bias = np.array([SLOTS]), np.ones(1)
        examples = [(np.append(s, bias[0]), np.append(v, bias[1])) for s, v in (features(t, cache) for t in pdf["text"])]
        model = Ftrl(alpha, beta, l1, l2)
        for _ in range(epochs):
            for (s, v), y in zip(examples, pdf["label"].tolist()):
                model.learn(s, v, y)
        w = model.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at]})

    learnt = bounded.groupBy("shard").applyInPandas(learn, "slot long, w double")
    used = bounded.select(F.count_distinct("shard")).first()[0]
    out = np.zeros(SLOTS + 1)
    if used:
        got = learnt.groupBy("slot").agg(F.sort_array(F.collect_list("w")).alias("w")).toPandas()  # at most SLOTS + 1 rows
        out[got["slot"].to_numpy()] = [sum(w) / used for w in got["w"]]
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """docs plus the probability of label 1."""
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def dot(texts: pd.Series) -> pd.Series:
        w, cache = model.value, {}
        found = np.empty(len(texts))
        for i, t in enumerate(texts):
            slots, values = features(t, cache)
            found[i] = w[SLOTS] + w[slots] @ values
        return pd.Series(1 / (1 + np.exp(-np.clip(found, -30, 30))))

    return docs.withColumn(out, dot(F.col(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(F.col(doc_id)), F.lit(FOLDS)) == 0


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    weights = train(docs, labels.filter(~held_out()), "quality")
    found = score(docs, weights)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
