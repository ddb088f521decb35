"""Quality votes against plain Python, and on rows kept from learning."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.frames import ROWS, edge_documents, no_documents
from watchmill.llm import quality
from watchmill.llm.common import WordCache

GOOD = ["a calm line of text that goes on for a while", "one more line about the weather and the sea", "the sea was calm and the weather was fine"]
BAD = ["BUY!! NOW!! BUY!! NOW!!", "x | y | z | menu | home", "spam spam spam spam spam spam spam"]
LABELS = "doc_id long, quality int, score string"


def labelled(spark):
    rows, marks = [], []
    for i in range(1000, 1120):
        source = (GOOD if i % 3 else BAD)[i % 7 % 3]
        rows.append((i, f"{source} {source.split()[i % 3]}" + (" and so on" if i % 3 else "!!")))
        marks.append((i, int(i % 3 > 0), "clash"))
    return rows, marks + [(1001, None, "clash"), (None, 0, "clash"), (5, 1, "clash"), (1004, 1, "clash")]


def plain_score(model, text):
    """The same votes, text by text and neighbour by neighbour."""
    tokens = (text or "").split()
    counts = Counter(f for token in tokens for f in quality.features_of(token)) + Counter(quality.forms_of(tokens))
    values = {}
    for kind, share in quality.KINDS.items():
        of_kind = {f: math.log1p(n) * model.weights[model.features[f]] for f, n in counts.items() if f in model.features and f.startswith(kind + " ")}
        length = math.sqrt(sum(v * v for v in of_kind.values()))
        values |= {f: v / length * share for f, v in of_kind.items()}
    inside = [sum(v * model.directions[model.features[f], d] for f, v in values.items()) for d in range(model.directions.shape[1])]
    length = math.sqrt(sum(v * v for v in inside)) or 1.0
    cosines = [round(sum(a * b for a, b in zip(inside, row)) / length, 5) for row in model.vectors.tolist()]
    least = sorted(cosines)[-min(15, len(cosines))]
    votes = [(c, y) for c, y in zip(cosines, model.labels) if c >= least and c > 0]
    return sum(c * y for c, y in votes) / sum(c for c, _ in votes) if votes else float(np.mean(model.labels))


def test_scores_equal_a_plain_vote_on_odd_documents(spark):
    rows, marks = labelled(spark)
    learned = quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, LABELS))
    docs = edge_documents(spark).select("doc_id", "text", F.lit("x").alias("quality"), F.lit("x").alias("score"), F.lit("x").alias("held_out"))
    found = quality.score(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("y") for c in ("quality", "score", "held_out")})), learned)
    every = [(r[0], r[1]) for r in ROWS] + rows
    expected = [(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, plain_score(learned, t)) for i, t in every]
    got = sorted(found.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    expected.sort(key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r["doc_id"], r["held_out"]) for r in got] == [r[:2] for r in expected]
    # A cosine on the edge of a decimal may be rounded either way.
    assert np.allclose([r["score"] for r in got], [r[2] for r in expected], atol=1e-3)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert quality.score(no_documents(spark), learned).count() == 0


def test_nothing_to_learn_from(spark):
    rows, marks = labelled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, "x")], LABELS)):
        assert {r["score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()} == {0.5}
    only_good = quality.learn(docs, spark.createDataFrame([m for m in marks if m[0] and m[1] == 1], LABELS))
    assert {round(r["score"], 9) for r in quality.score(docs, only_good).collect()} == {1.0}


def test_one_key_with_many_texts_is_bounded(spark):
    docs = spark.createDataFrame([(1000, f"text number {i} of one key") for i in range(200)], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame([(1000, 1, "x")], LABELS), sample=20)
    assert len(model.labels) == 20


def test_shapes_and_forms():
    assert [quality.shape_of(t) for t in ("Word", "WORD!!", "a&&&", "x-ray", "3,141", "É!!!!", "x" * 500)] == ["Aa", "A!!", "a&&", "a-a", "0,0", "A!!", "a"]
    assert quality.forms_of([]) == ["form empty"] and quality.forms_of(["a"]) == ["form length 1", "form tokens 1 10", "form pairs 0"]
    known = WordCache(quality.features_of)
    assert quality.count_features("a a. B", known)["word a"] == 2 and quality.count_features(None, known) == {"form empty": 1}


def test_directions_are_the_largest_singular_vectors():
    matrix = np.random.default_rng(1).standard_normal((60, 5)) @ np.diag([9, 5, 3, 1, 0.1]) @ np.random.default_rng(2).standard_normal((5, 40))
    exact = np.linalg.svd(matrix)[2][:3]
    assert np.allclose(np.abs(exact @ quality.singular_directions(matrix, 3)), np.eye(3), atol=1e-6)


def test_documents_kept_from_learning(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.op13_quality(spark, sf).collect()
    assert len(rows) == docs.count()
    kept = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in kept]) > 0.95
    assert np.mean([r["predicted"] for r in kept if truth[r["doc_id"]]]) > 0.98
    # Labels of documents that are held out teach nothing, nor do language, source and key of any.
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(docs.repartition(5).withColumns({"lang": F.lit("zz"), "source": F.lit(None)}), quality.learn(docs.repartition(3), turned)).collect()
    before = {r["doc_id"]: r["score"] for r in rows}
    assert np.allclose([r["score"] for r in again], [before[r["doc_id"]] for r in again], atol=1e-3)
