"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

One weight vector serves all thresholds: the chance of a grade of at most j is the logistic function of threshold j less the
weighted sum, and the thresholds are kept in order. The output is the expected grade.

The labels tell toxic documents only from others, so toxic documents are graded by how many words they hold that occur almost
only in toxic ones: grade 2 above the median of toxic documents, else grade 1; all others have grade 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import WordCache, map_frames, materialize, table, texts

WORDS = re.compile(r"[^\W\d_]+")
#: Besides the word itself, its beginnings of these lengths are features.
BEGINNINGS = (4, 5, 6)
#: Bounds of learning: labelled documents of either kind, features kept, documents that a feature has to be in.
PER_KIND, FEATURES, SEEN, STEPS, RIDGE = 4000, 1000, 3, 400, 2e-5
#: Only features are kept of whose sampled documents this share is toxic, those first that are by most standard errors more
#: common there. What does not tell toxic documents would add up to noise in long ones.
MARKED_SHARE = 0.9


def features_of(word: str) -> list[str]:
    return [f"{word}$", *(word[:n] for n in BEGINNINGS if len(word) > n)]


@dataclass
class SeverityModel:
    """Weights of the features, and the thresholds between grades in rising order."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([math.inf]))

    def known(self) -> WordCache:
        """For a word, the rows of its features."""
        return WordCache(lambda word: tuple(self.features[f] for f in features_of(word) if f in self.features), limit=50_000)

    def probabilities(self, counts: Counter) -> np.ndarray:
        """Chances of grades 0, 1, ... of a text whose features were counted."""
        total = sum(self.weights[row] * math.log1p(n) for row, n in counts.items())
        at_most = [1 / (1 + math.exp(-min(max(t - total, -500.0), 500.0))) for t in self.thresholds]
        return np.diff([0.0, *at_most, 1.0])


def count_features(text: str | None, known: WordCache) -> Counter:
    return Counter(row for word in WORDS.findall((text or "").lower()) for row in known[word])


def fit_cumulative_link(x: np.ndarray, grades: np.ndarray, levels: int, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient steps on the mean log likelihood with a ridge on the weights."""
    n, width = x.shape
    shares = np.clip(np.cumsum([(grades == j).mean() for j in range(levels - 1)]), 0.01, 0.99)
    logits = np.log(shares / (1 - shares))
    # The thresholds are the first one and the logarithms of the distances to the next, so any step keeps them in order.
    at = np.concatenate([np.zeros(width), logits[:1], np.log(np.maximum(np.diff(logits), 0.1))])
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        weights, gaps = at[:width], np.exp(at[width + 1 :])
        thresholds = at[width] + np.concatenate([[0.0], np.cumsum(gaps)])
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        score = x @ weights
        with np.errstate(over="ignore"):
            upper = 1 / (1 + np.exp(-(edges[grades + 1] - score)))
            lower = 1 / (1 + np.exp(-(edges[grades] - score)))
        likely = np.maximum(upper - lower, 1e-12)
        rise_upper, rise_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        by_score = (rise_upper - rise_lower) / n
        by_edge = np.array([-(rise_upper[grades == j].sum() - rise_lower[grades == j + 1].sum()) / n for j in range(levels - 1)])
        later = np.cumsum(by_edge[::-1])[::-1]
        slope = np.concatenate([x.T @ by_score + ridge * weights, later[:1], later[1:] * gaps])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        at = at - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return at[:width], at[width] + np.concatenate([[0.0], np.cumsum(np.exp(at[width + 1 :]))])


def learn(docs: DataFrame, labels: DataFrame, per_kind: int = PER_KIND) -> SeverityModel:
    """Learn from documents whose doc_id the labels (doc_id, toxic) name.

    The sample is bounded: of toxic and of other labelled documents the ``per_kind`` with the least hash of their key. Spark
    counts the features; the driver gets FEATURES of them and, of the sampled documents, the rows of those features.
    """
    kinds = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    kinds = kinds.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("rank", F.xxhash64("doc_id"))
    ids = [kinds.where(F.col("toxic") == kind).orderBy("rank", "doc_id").limit(per_kind).drop("rank") for kind in (F.lit(True), F.lit(False))]
    # Equal texts teach nothing new, and a large group of copies would outvote the rest.
    sample = texts(docs).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy(F.xxhash64("text").alias("copy")).agg(F.min_by(F.struct("text", "toxic"), "doc_id").alias("one"))
    sample = materialize(sample.select("one.text", F.col("one.toxic").cast("int").alias("toxic")), "toxicity-sample")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        found = [sorted({f for w in set(WORDS.findall(t.lower())) for f in features_of(w)}) for t in frame["text"]]
        flat = pd.DataFrame({"feature": found, "toxic": frame["toxic"].to_numpy()}).explode("feature").dropna()
        return flat.groupby("feature")["toxic"].agg(["sum", "count"]).reset_index().set_axis(["feature", "toxic", "n"], axis=1).astype({"toxic": "int64", "n": "int64"})

    sizes = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return SeverityModel()
    counted = map_frames(sample, count, "feature string, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("n").alias("n"))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (sizes[True] + 1 - a)) - F.log(b / (sizes[False] + 1 - b))
    scored = counted.where(F.col("n") >= SEEN).withColumn("z", odds / F.sqrt(1 / a + 1 / b))
    marked = scored.where((F.col("a") >= MARKED_SHARE * F.col("n")) & (F.col("z") > 0))
    chosen = marked.orderBy(F.col("z").desc(), "feature").limit(FEATURES).toPandas()
    model = SeverityModel({f: i for i, f in enumerate(chosen["feature"])})
    words = set(chosen[chosen["feature"].str.endswith("$")].index)

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        known, out = model.known(), []
        for text, toxic in zip(frame["text"], frame["toxic"]):
            counts = count_features(text, known)
            out.append((int(toxic), sum(n for row, n in counts.items() if row in words), list(counts), [math.log1p(n) for n in counts.values()]))
        return pd.DataFrame(out, columns=["toxic", "marks", "at", "value"])

    drawn = map_frames(sample, rows, "toxic int, marks int, at array<int>, value array<double>").collect()
    x, grades = np.zeros((len(drawn), len(chosen))), np.zeros(len(drawn), dtype=np.int64)
    middle = float(np.median([r["marks"] for r in drawn if r["toxic"]]))
    for i, row in enumerate(drawn):
        x[i, row["at"]] = row["value"]
        grades[i] = (1 + (row["marks"] > middle)) if row["toxic"] else 0
    grades = np.unique(grades, return_inverse=True)[1]
    model.weights, model.thresholds = fit_cumulative_link(x, grades, int(grades.max()) + 1)
    return model


def severity_of(text: Column, model: SeverityModel, spark: SparkSession) -> Column:
    """struct<severity, grade, p_toxic, toxic> of a text column; a null text counts as empty.

    severity is the expected grade, grade the likeliest, p_toxic the chance of any grade above 0; toxic is p_toxic of at least
    a half.
    """
    shared = spark.sparkContext.broadcast(model)
    kept: list[WordCache] = []

    @F.pandas_udf("severity double, grade int, p_toxic double, toxic boolean")
    def judge(found: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(shared.value.known())
        chances = [shared.value.probabilities(count_features(t, kept[0])) for t in found]
        return pd.DataFrame(
            {
                "severity": [float(p @ np.arange(len(p))) for p in chances],
                "grade": [int(p.argmax()) for p in chances],
                "p_toxic": [float(1 - p[0]) for p in chances],
                "toxic": [bool(p[0] <= 0.5) for p in chances],
            }
        )

    return judge(F.coalesce(text, F.lit("")))


def grade(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """doc_id, severity, grade, p_toxic and toxic of every whole text.

    Repeated rows and rows without doc_id are judged as they come; extra columns are left out. Without labels of both kinds
    nothing is toxic.
    """
    judged = texts(docs).select("doc_id", severity_of(F.col("text"), model, docs.sparkSession).alias("judged"))
    return judged.select("doc_id", "judged.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade(docs, learn(docs, table(spark, sf_dir, "labels")))
