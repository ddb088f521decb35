"""Quality of a text by the votes of its nearest labelled neighbours in a latent-semantic space.

A text is a sparse vector of what occurs in it: its words, the shapes of its tokens, and how long and how repetitive it is, each
of these three kinds scaled to one length. Singular vectors of the labelled sample's matrix span the latent space. The labelled
vectors are broadcast; cosines of blocks of documents with all of them are exact matrix products, and a document's nearest
neighbours vote with their labels, weighted by similarity.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import WordCache, map_frames, materialize, table, texts

#: Bounds of learning: labelled texts, features, texts of the sample that a feature has to be in, dimensions of the space.
SAMPLE, FEATURES, SEEN, DIMENSIONS = 3000, 4096, 3, 64
#: Voting neighbours (and all that tie with the last one), decimals of a cosine that count, and the score of a good text.
NEIGHBOURS, DECIMALS, GOOD = 15, 5, 0.7
#: Kinds of features and how much each weighs in a text's vector.
KINDS = {"word": 0.5, "shape": 1.0, "form": 1.0}
_LETTERS = re.compile(r"[\W\d_]+")


def shape_of(token: str) -> str:
    """Runs of letters, capitals and digits as one sign each, other characters as they are, at most two in a row."""
    signs = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return "".join(c if c in "aA0" else c * min(len(list(run)), 2) for c, run in itertools.groupby(signs))


def features_of(token: str) -> tuple[str, ...]:
    word = _LETTERS.sub("", token).lower()
    return (f"shape {shape_of(token)}", f"word {word}") if word else (f"shape {shape_of(token)}",)


def forms_of(tokens: list[str]) -> list[str]:
    """How many tokens there are, and how many of the tokens and of the pairs of tokens are different ones."""
    if not tokens:
        return ["form empty"]
    pairs = list(zip(tokens, tokens[1:]))
    length = len(tokens).bit_length()
    return [
        f"form length {length}",
        f"form tokens {length} {10 * len(set(tokens)) // len(tokens)}",
        f"form pairs {10 * len(set(pairs)) // max(len(pairs), 1)}",
    ]


def count_features(text: str | None, known: WordCache) -> Counter:
    """Features of the whole text with their numbers; ``known`` gives those of a token."""
    tokens = (text or "").split()
    counts: Counter = Counter()
    for token, n in Counter(tokens).items():
        for feature in known[token]:
            counts[feature] += n
    for feature in forms_of(tokens):
        counts[feature] += 1
    return counts


@dataclass
class QualityModel:
    """Features with their kinds and weights, the directions of the latent space, and labelled unit vectors in it."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    directions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def sparse(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a text's features and their values: each kind has its length, and the whole has length one."""
        known = [(self.features[f], n) for f, n in counts.items() if f in self.features]
        rows = np.array([row for row, _ in known], dtype=np.int64)
        values = np.log1p([n for _, n in known]) * self.weights[rows]
        kinds = self.kinds[rows]
        lengths = np.sqrt(np.bincount(kinds, values * values, len(KINDS)))
        values = values / np.maximum(lengths, 1e-12)[kinds] * np.array(list(KINDS.values()))[kinds]
        return rows, values / max(math.sqrt(float(values @ values)), 1e-12)

    def vector(self, counts: Counter) -> np.ndarray:
        """The unit vector of a text in the latent space, or zero if nothing of it is known."""
        rows, values = self.sparse(counts)
        inside = values @ self.directions[rows]
        return inside / max(math.sqrt(float(inside @ inside)), 1e-12)

    def scores(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Votes for the better label among the nearest of all labelled vectors, by similarity. Without any: one half.

        Texts of which no labelled one is at a right angle or less get the share of the better label among all.
        """
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        cosines = np.round(vectors @ self.vectors.T, DECIMALS)
        k = min(neighbours, len(self.labels))
        least = np.partition(cosines, len(self.labels) - k, axis=1)[:, -k]
        votes = np.where(cosines >= least[:, None], np.maximum(cosines, 0.0), 0.0)
        total = votes.sum(axis=1)
        return np.where(total > 0, (votes @ self.labels) / np.maximum(total, 1e-12), self.labels.mean()).clip(0.0, 1.0)


def held_out() -> Column:
    """Whether a document is kept from learning: the remainder of its key's checksum by 4 is 2; without a key it is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def singular_directions(matrix: np.ndarray, dimensions: int, seed: int = 11) -> np.ndarray:
    """The right singular vectors of the largest singular values, by subspace iteration from seeded directions."""
    wide = min(dimensions + 16, *matrix.shape)
    basis = np.random.default_rng(seed).standard_normal((matrix.shape[1], wide))
    for _ in range(6):
        basis = np.linalg.qr(matrix.T @ np.linalg.qr(matrix @ basis)[0])[0]
    _, _, turned = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ turned.T)[:, :dimensions]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learn from documents that are not held out and whose doc_id the labels (doc_id, quality) name.

    The sample is bounded: the ``sample`` labelled keys with the least hash, and of their texts as many. Of equal texts one is
    kept, so that a large group of copies does not outvote the rest. Spark counts the features; the driver gets FEATURES of them and the sample's rows. A
    document with several labels has their mean. Without labels, or without features, every score is one half.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy(F.sha2("text", 256).alias("copy")).agg(F.first("text").alias("text"), F.avg("label").alias("label"))
    labelled = materialize(labelled, "quality-sample")
    # One key may have many rows, so different texts are bounded as well.
    labelled = labelled.join(F.broadcast(labelled.select("copy").orderBy("copy").limit(sample)), "copy", "left_semi")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        known = WordCache(features_of, limit=50_000)
        found = Counter(f for text in frame["text"] for f in count_features(text, known))
        return pd.DataFrame({"feature": list(found), "n": np.array(list(found.values()), dtype=np.int64)})

    counted = map_frames(labelled, count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    features = counted.orderBy(F.col("n").desc(), "feature").limit(FEATURES).toPandas()
    size = labelled.count()
    if features.empty:
        return QualityModel()
    kinds = list(KINDS)
    model = QualityModel(
        {f: i for i, f in enumerate(features["feature"])},
        np.log((size + 1) / (features["n"].to_numpy() + 0.5)) + 0.1,
        np.array([kinds.index(f.split(" ", 1)[0]) for f in features["feature"]]),
    )

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        known = WordCache(features_of, limit=50_000)
        made = [model.sparse(count_features(text, known)) for text in frame["text"]]
        return pd.DataFrame({"copy": frame["copy"], "label": frame["label"], "at": [a for a, _ in made], "value": [v for _, v in made]})

    drawn = sorted(map_frames(labelled, rows, "copy string, label double, at array<long>, value array<double>").collect(), key=lambda row: row["copy"])
    matrix = np.zeros((len(drawn), len(features)))
    for i, row in enumerate(drawn):
        matrix[i, row["at"]] = row["value"]
    model.directions = singular_directions(matrix, DIMENSIONS)
    inside = matrix @ model.directions
    model.vectors = inside / np.maximum(np.linalg.norm(inside, axis=1, keepdims=True), 1e-12)
    model.labels = np.array([row["label"] for row in drawn])
    return model


def quality_of(text: Column, model: QualityModel, spark: SparkSession) -> Column:
    """The score of a text column, 0 to 1; a null text counts as empty."""
    shared = spark.sparkContext.broadcast(model)
    kept: list[WordCache] = []

    @F.pandas_udf("double")
    def judge(found: pd.Series) -> pd.Series:
        model = shared.value
        if not kept:
            kept.append(WordCache(lambda token: tuple(f for f in features_of(token) if f in model.features), limit=50_000))
        scores = [np.zeros(0)]
        for start in range(0, len(found), 256):
            vectors = [model.vector(count_features(text, kept[0])) for text in found.iloc[start : start + 256]]
            scores.append(model.scores(np.array(vectors)))
        return pd.Series(np.concatenate(scores))

    return judge(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from GOOD on) of every whole text.

    Only the text is looked at. Repeated rows and rows without doc_id are judged as they come; null and empty texts are judged
    by being empty. Extra columns are left out, an empty table gives no rows.
    """
    judged = texts(docs).select("doc_id", held_out().alias("held_out"), quality_of(F.col("text"), model, docs.sparkSession).alias("score"))
    return judged.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
