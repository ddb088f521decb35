"""The pipeline against a brute-force version of its stages."""

import re

import corpus_pipeline
from tests.llm.frames import edge_documents, no_documents
from tests.llm.test_pairs import by_brute_force, plain_simhash
from tests.llm.test_tokens import check_packing


def test_stages_on_the_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    assert ids["language"] == {r["doc_id"] for r in seen["input"] if any(c.isalpha() for c in r["text"])}
    rejected = ids["language"] - ids["toxicity"]
    assert len(rejected & {i for i, t in labels.items() if t}) > 0.9 * len(ids["language"] & {i for i, t in labels.items() if t})
    assert not rejected & {i for i, t in labels.items() if not t}
    prints = {r["doc_id"]: plain_simhash(r["text"]) for r in seen["toxicity"]}
    assert ids["near-duplicates"] == {i for i, name in by_brute_force(prints).items() if i == name}
    assert ids["personal-data"] == ids["near-duplicates"]
    before = {r["doc_id"]: r["text"] for r in seen["near-duplicates"]}
    private = re.compile(r"[\w.]+@[\w.]+\.\w+|\b\d{16}\b|password=\w+")
    for row in seen["personal-data"]:
        assert not set(private.findall(row["text"])) & set(private.findall(before[row["doc_id"]]))
        assert row["n_chars"] == len(row["text"])
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert check_packing(rows, {r["doc_id"]: r["text"] for r in seen["personal-data"]}) > 0.98
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows))


def test_stages_on_odd_and_empty_documents(spark, sf):
    for docs in (edge_documents(spark), no_documents(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, sf), "stage")
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_rows_and_not_ids_of_near_duplicates_go(spark, sf):
    long = "a line of words that goes on and on and says the same thing over and over again " * 20
    rows = [
        (1, long), (2, long + "x"), (2, "quite another text that shares its id with a near copy, and is kept"),
        (None, long), (None, "a text without an id"), (None, "a text without an id"), (None, "one more text, and no id"),
        (3, "the same row twice"), (3, "the same row twice"), (4, None), (5, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key string")
    left = corpus_pipeline.one_of_each(spark, docs, sf)
    assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert kept == sorted([(1, long), rows[2], rows[4], rows[6], rows[7], (4, None)], key=str)
