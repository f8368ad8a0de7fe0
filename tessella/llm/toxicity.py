"""Operator 1, toxicity: cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - t_k), with one weight vector for all thresholds t_1 < t_2 < ...; x are a text's distinct words
and word beginnings, sparse and binary. Spark counts the features of a bounded sample of labelled rows and keeps those most
associated with the label; the weights are fitted to them with an L1 penalty by accelerated proximal gradients. All documents
are then scored by a map over whole texts, with no shuffle. The expected severity is the sum of P(grade >= k) over k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, only, stored, table

#: Labelled rows used to fit (a sample by a hash of doc_id where there are more), features kept in the model, the L1 penalty,
#: and the expected severity from which a document is rejected.
SAMPLE_ROWS, MAX_FEATURES, PENALTY, REJECT_AT = 8_000, 3_000, 4e-5, 0.5
#: Lengths of the word beginnings that are features: words are inflected, compounded and disguised at their ends.
BEGINNINGS = (4, 5, 6, 7)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(text: str | None) -> set[str]:
    """Distinct words, marked with a final $, and their beginnings."""
    found = distinct_words(text)
    return {w + "$" for w in found}.union(*({w[:n] for w in found if len(w) >= n} for n in BEGINNINGS))


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    base: int = 0  # the lowest grade

    def __post_init__(self):
        self._whole = {f[:-1]: w for f, w in self.weights.items() if f.endswith("$")}
        self._begun = {n: {f: w for f, w in self.weights.items() if not f.endswith("$") and len(f) == n} for n in BEGINNINGS}

    def severity(self, text: str | None) -> tuple[float, int]:
        """Expected severity and likeliest grade."""
        found = distinct_words(text)
        met = [self._whole[w] for w in sorted(found & self._whole.keys())]
        for n, begun in self._begun.items():
            if begun:
                met += [begun[w] for w in sorted({w[:n] for w in found} & begun.keys())]
        z = sum(met)
        above = [1.0, *(1 / (1 + np.exp(-np.clip(z - t, -500, 500))) for t in self.thresholds), 0.0]
        chances = [a - b for a, b in zip(above, above[1:], strict=False)]
        return round(float(self.base + sum(above[1:-1])), 6), self.base + int(np.argmax(chances))


def cuts(params: np.ndarray, features: int) -> np.ndarray:
    """The thresholds: a first one and the logarithms of the gaps between them, so that they stay in order."""
    return np.cumsum(np.concatenate([params[features : features + 1], np.exp(params[features + 1 :])]))


def likelihood(params: np.ndarray, r: np.ndarray, c: np.ndarray, y: np.ndarray, features: int) -> tuple[float, np.ndarray]:
    """The mean negative logarithm of each row's chance of its grade, and its gradient. Row r[i] has feature c[i]; y: grades."""
    n, k = len(y), len(params) - features
    t, z = cuts(params, features), np.bincount(r, weights=params[c], minlength=n)
    above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30))), np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    chance = np.maximum(above[at, y] - above[at, y + 1], 1e-12)
    slope = above * (1 - above)
    dz = -(slope[at, y] - slope[at, y + 1]) / chance / n
    dt = np.array([(((y == i + 1) * slope[:, i + 1]) - ((y == i) * slope[:, i + 1])) @ (1 / chance) / n for i in range(k)])
    tail = np.cumsum(dt[::-1])[::-1]
    return -np.log(chance).mean(), np.concatenate([np.bincount(c, weights=dz[r], minlength=features), tail[:1], tail[1:] * np.exp(params[features + 1 :])])


def fit(rows: list[tuple[list[int], int]], names: list[str], *, penalty: float = PENALTY, steps: int = 400) -> OrdinalModel:
    """rows: the features (places in names) and the grade of each labelled text. With one grade only, that grade is everyone's
    severity."""
    grades = sorted({g for _, g in rows})
    if len(grades) < 2:
        return OrdinalModel(base=grades[0] if grades else 0)
    level = {g: i for i, g in enumerate(grades)}
    y, n, kept = np.array([level[g] for _, g in rows]), len(rows), len(names)
    r = np.repeat(np.arange(n), [len(f) for f, _ in rows])
    c = np.concatenate([np.asarray(f, dtype=np.int64) for f, _ in rows])
    share = np.array([(y > i).mean() for i in range(len(grades) - 1)])
    first = -np.log(share / (1 - share))
    params = np.concatenate([np.zeros(kept), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        return likelihood(p, r, c, y, kept)

    def shrunk(p: np.ndarray, step: float) -> np.ndarray:
        p = p.copy()
        w = p[:kept]
        p[:kept] = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        return p

    now, ahead, speed, step = params, params, 1.0, 4.0
    for _ in range(steps):
        value, slope = loss(ahead)
        while True:
            new = shrunk(ahead - step * slope, step)
            d = new - ahead
            if loss(new)[0] <= value + slope @ d + d @ d / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        if (ahead - new) @ (new - now) > 0:
            speed = 1.0
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, now, speed, step = new + (speed - 1) / faster * (new - now), new, faster, step * 1.2
    return OrdinalModel({f: float(now[i]) for i, f in enumerate(names) if now[i]}, [float(x) for x in cuts(now, kept)], grades[0])


def labelled_texts(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic: about sample_rows labelled texts. A document labelled twice has its highest label; null labels are no labels;
    equal texts count once, as toxic if half of them are."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample_rows / max(1, known.count()))
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    pairs = only(docs, "doc_id", "text").join(F.broadcast(some), "doc_id")  # some: about sample_rows rows of 12 bytes
    return pairs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("of")).agg(F.first("text").alias("text"), (F.avg((F.col("toxic") > 0).cast("int")) >= 0.5).cast("int").alias("toxic")).select("text", "toxic")


def toxicity_model(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES, penalty: float = PENALTY, least_texts: int = 4) -> OrdinalModel:
    """The model of labels(doc_id, toxic 0/1) on docs(doc_id, text).

    The labels are made three grades: toxic texts with more marked words than the median of the toxic texts that have any are
    grade 2, other toxic ones 1. Marked: beginning with or being a feature that least_texts toxic texts have and that is 20
    times as frequent there as in other texts. The driver gets sample_rows rows of feature numbers at most."""
    sample = stored(labelled_texts(bounded_batches(docs), labels, sample_rows=sample_rows))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if toxic in (0, n):
        return OrdinalModel(base=int(n > 0 and toxic == n))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(features(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["feature", "toxic"])

    counts = sample.mapInArrow(listed, "feature string, toxic int").groupBy("feature").agg(F.count("*").alias("c"), F.sum("toxic").cast("double").alias("t"))
    share = toxic / n
    strength = (F.col("t") - F.col("c") * share) / F.sqrt(F.col("c") * (1 - F.col("c") / (n + 1.0)) * share * (1 - share))
    best = counts.filter(F.col("c") >= least_texts).withColumn("z", F.abs(strength)).orderBy(F.desc("z"), "feature").limit(max_features).collect()
    names = [r["feature"] for r in best]
    marked = {r["feature"] for r in best if r["t"] >= least_texts and r["t"] / toxic >= 20 * (r["c"] - r["t"] + 0.5) / (n - toxic + 1)}
    place = docs.sparkSession.sparkContext.broadcast(({f: i for i, f in enumerate(names)}, marked))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signs = place.value
        for batch in lean(batches):
            texts = batch.column(0).to_pylist()
            of = [sorted(known[f] for f in features(x) & known.keys()) for x in texts]
            hits = [sum(w + "$" in signs or any(w[:m] in signs for m in BEGINNINGS) for w in distinct_words(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(of, pa.list_(pa.int32())), pa.array(hits, pa.int32())], names=["toxic", "features", "hits"])

    rows = sample.mapInArrow(numbered, "toxic int, features array<int>, hits int").collect()
    rows.sort(key=lambda r: (r["toxic"], r["features"]))
    some = [r["hits"] for r in rows if r["toxic"] and r["hits"]]
    middle = float(np.median(some)) if some else 0.0
    return fit([(r["features"], 2 if r["toxic"] and r["hits"] > middle else r["toxic"]) for r in rows], names, penalty=penalty)


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, text: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """docs with severity (expected, double), grade (likeliest, int) and toxic (severity >= reject_at) added; columns of these
    names are replaced. Null and empty texts have no words and so the severity of the thresholds alone."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)  # at most max_features features

    @F.pandas_udf("severity double, grade int")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in lean(batches):
            yield pd.DataFrame([known.severity(x) for x in batch], columns=["severity", "grade"]).astype({"severity": "float64", "grade": "int32"})

    both = docs.drop("severity", "grade", "toxic").withColumn("__scored", scored(F.col(f"`{text}`")))
    return both.withColumns({"severity": F.col("__scored.severity"), "grade": F.col("__scored.grade"), "toxic": F.col("__scored.severity") >= reject_at}).drop("__scored")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "severity", "grade", "toxic")
