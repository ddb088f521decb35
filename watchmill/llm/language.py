"""Language of a text by word-first backoff.

A word that was learned votes with its log frequency in every language. A word that was not falls back to its character
n-grams, from long to short: the longest length at which any of them was learned votes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchmill.llm.common import map_frames, materialize, table, texts

UNKNOWN = "und"
#: Lengths of n-grams, tried in this order; a word carries a sign at either end.
LENGTHS, EDGE = (5, 4, 3, 2, 1), "^"
#: Bounds of what is learned from: at most so many documents of each language, and words or n-grams seen this often.
PER_LANGUAGE, WORD_SEEN, GRAM_SEEN, SMOOTHING = 3000, 3, 5, 0.5
#: Words whose votes a worker keeps; up to twice as many are held, by every worker of an executor.
KEPT = 50_000
WORDS = re.compile(r"[^\W\d_]+")


class HashedRows:
    """For words or n-grams, the rows at which they stand, held as sorted 64-bit hashes in place of the texts. A worker makes a
    dictionary of them when it first looks one up.
    """

    def __init__(self, keys: np.ndarray):
        self.keys, self.rows = keys, None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "rows": None}

    @staticmethod
    def hash(item: str) -> int:
        """Spark's xxhash64 of a text."""
        value = xxhash.xxh64_intdigest(item.encode("utf-8", "surrogatepass"), seed=42)
        return value - (1 << 64) if value >> 63 else value

    def get(self, item: str) -> int | None:
        if self.rows is None:
            self.rows = {key: row for row, key in enumerate(self.keys.tolist())}
        return self.rows.get(self.hash(item))

    def __contains__(self, item: str) -> bool:
        return self.get(item) is not None

    def __len__(self) -> int:
        return len(self.keys)


@dataclass
class LanguageModel:
    """Log frequencies by language: ``words`` and ``grams`` say at which row of the logs a word or n-gram stands."""

    languages: list[str] = field(default_factory=list)
    words: dict[str, int] | HashedRows = field(default_factory=dict)
    grams: dict[str, int] | HashedRows = field(default_factory=dict)
    word_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    gram_logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def backoff(self, word: str) -> np.ndarray | None:
        marked = EDGE + word + EDGE
        for n in LENGTHS:
            rows = [row for i in range(len(marked) - n + 1) if (row := self.grams.get(marked[i : i + n])) is not None]
            if rows:
                return self.gram_logs[rows].mean(axis=0)
        return None

    def vote(self, word: str) -> np.ndarray:
        """What a word says for each language; nothing if no part of it is known."""
        row = self.words.get(word)
        if row is not None:
            return self.word_logs[row]
        vote = self.backoff(word)
        return vote if vote is not None else np.zeros(len(self.languages), np.float32)

    def predict(self, text: str | None, votes: Votes | None = None) -> tuple[str, float]:
        """The language, and its share among all languages if they are taken as equally likely beforehand."""
        words = WORDS.findall((text or "").lower())
        if not self.languages or not any(c.isalpha() for word in words for c in word):
            return UNKNOWN, 0.0
        total = (votes or Votes(self)).total(words)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


class Votes:
    """Votes of words met before, as rows of one matrix. The sum never depends on what is kept."""

    def __init__(self, model: LanguageModel, kept: int = KEPT):
        self.model, self.kept, self.rows = model, kept, {}
        self.matrix = np.zeros((min(kept, 1024), len(model.languages)), np.float32)

    def _row(self, word: str) -> int:
        row = self.rows[word] = len(self.rows)
        if row == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[row] = self.model.vote(word)
        return row

    def total(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(self.model.languages))
        for start in range(0, len(words), self.kept):
            part = words[start : start + self.kept]
            if len(self.rows) + len(part) > 2 * self.kept:
                self.rows.clear()
            known = self.rows
            rows = [known[word] if word in known else self._row(word) for word in part]
            total += self.matrix[rows].sum(axis=0, dtype=np.float64)
        return total


def held_out() -> F.Column:
    """Whether a document is kept from learning: the remainder of its key's checksum by 3 is 1; without a key it is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _logs(counts: pd.DataFrame, languages: list[str]) -> tuple[HashedRows, np.ndarray]:
    """Rows in order of the items' hashes, and their log frequencies."""
    if counts.empty:
        return HashedRows(np.zeros(0, np.int64)), np.zeros((0, len(languages)), np.float32)
    keys, at = np.unique(counts["item"].to_numpy(), return_inverse=True)
    wide = np.zeros((len(keys), len(languages)))
    np.add.at(wide, (at, counts["at"].to_numpy()), counts["n"].to_numpy())
    logs = np.log((wide + SMOOTHING) / (wide.sum(axis=0) + SMOOTHING * len(wide)))
    return HashedRows(keys), logs.astype(np.float32)


def _seen(counts: DataFrame, least: int, languages: list[str]) -> pd.DataFrame:
    """Items seen often enough, as hashes, with the place of their language."""
    place = F.coalesce(*(F.when(F.col("lang") == lang, i) for i, lang in enumerate(languages)))
    often = counts.withColumn("all", F.sum("n").over(Window.partitionBy("item"))).where(F.col("all") >= least)
    return often.select(F.xxhash64("item").alias("item"), place.alias("at"), "n").toPandas()


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from documents (doc_id, text, lang) that are not held out.

    The sample is bounded: of every language the ``per_language`` documents with the least hash of their key. Counting is
    done by Spark; only words seen at least WORD_SEEN times and n-grams seen GRAM_SEEN times reach the driver.
    """
    usable = labelled.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages = sorted(row["lang"] for row in usable.select("lang").distinct().collect())
    if not languages:
        return LanguageModel()
    keys = usable.select("doc_id", "lang").withColumn("rank", F.xxhash64("doc_id"))
    chosen = [keys.where(F.col("lang") == lang).orderBy("rank", "doc_id").limit(per_language).select("doc_id") for lang in languages]
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.unionByName(more)
    sample = usable.select("doc_id", "text", "lang").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({"item": [WORDS.findall(t.lower()) for t in frame["text"]], "lang": frame["lang"]}).explode("item")
        return found.dropna().groupby(["item", "lang"]).size().reset_index(name="n").astype({"n": "int64"})

    words = map_frames(sample, count, "item string, lang string, n long").groupBy("item", "lang").agg(F.sum("n").alias("n"))
    # Both words and n-grams are made of these counts.
    words = materialize(words, "language-words")
    marked = F.concat(F.lit(EDGE), "item", F.lit(EDGE))

    def of_length(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length("item") + 3 - n), lambda i: F.substr(marked, i, F.lit(n)))
        return F.when(F.length("item") + 2 >= n, every).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.array(*map(of_length, LENGTHS)))
    counted = words.select(F.explode(grams).alias("item"), "lang", "n").groupBy("item", "lang").agg(F.sum("n").alias("n"))
    word_rows, word_logs = _logs(_seen(words, WORD_SEEN, languages), languages)
    gram_rows, gram_logs = _logs(_seen(counted, GRAM_SEEN, languages), languages)
    return LanguageModel(languages, word_rows, gram_rows, word_logs, gram_logs)


def language_of(text: Column, model: LanguageModel, spark: SparkSession) -> Column:
    """struct<lang_pred, score> of a text column; texts without a letter, and null ones, are ``und`` at 0."""
    shared = spark.sparkContext.broadcast(model)
    kept: list[Votes] = []

    @F.pandas_udf("lang_pred string, score double")
    def judge(found: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(Votes(shared.value))
        judged = [shared.value.predict(t, kept[0]) for t in found]
        return pd.DataFrame({"lang_pred": [lang for lang, _ in judged], "score": [float(score) for _, score in judged]})

    return judge(F.coalesce(text, F.lit("")))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for every whole text.

    Only the text is looked at. Repeated rows and rows without doc_id are judged as they come; extra columns are left out.
    """
    judged = texts(docs).select("doc_id", language_of(F.col("text"), model, docs.sparkSession).alias("judged"))
    return judged.select("doc_id", "judged.lang_pred", "judged.score")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of the table that may be learned from, and predict all of them: doc_id, held_out, lang_pred, score."""
    judged = predict(docs, learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
