"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.frames import ROWS, edge_documents, no_documents
from watchmill.llm import lexical

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def by_brute_force(docs, items, k=10):
    counts = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    holding = Counter(term for _, c in counts for term in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in holding.items()}
    rows = []
    for item_id, text in sorted({(i, t) for i, t in items if t is not None}, key=str):
        scored = []
        for doc_id, c in counts:
            m = 100 - 90 + (90 * c.total() * n) // total
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        rows += [(item_id, rank, None if gone else doc_id, -score) for rank, (score, gone, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return rows


def key(row):
    return tuple((value is None, value) for value in row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aZ09 /:@[`{\x7f\x80é中Éß🙂\n\0", "word ", "WORD"]), max_size=40).map("".join) | st.text(max_size=40))
def test_terms_of_bytes_are_those_of_code_points(text):
    assert lexical.count_terms(text.encode("utf-8", "surrogatepass")) == Counter(t.encode("utf-8", "surrogatepass") for t in plain_terms(text))


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(lexical, "PART", 7)
    text = " ".join(["word", "longerthanapart", "é", "", "x"] * 50)
    assert lexical.count_terms(text.encode()) == Counter(t.encode() for t in plain_terms(text))


def random_tree(rng, rows, width, leaf, largest=1_000_000, copies=False):
    picks = [rng.choice(width, rng.integers(1, min(width, 12) + 1), replace=False) for _ in range(rows)]
    values = [rng.integers(1, largest, len(p)) for p in picks]
    if copies:
        picks, values = [picks[0]] * rows, [values[0]] * rows
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in picks])])
    dense = np.zeros((rows, width), dtype=np.int64)
    for row, (p, v) in enumerate(zip(picks, values)):
        dense[row, p] = v
    return lexical.Tree([(False, i) for i in range(rows)], bounds, np.concatenate(picks), np.concatenate(values), leaf), dense


@pytest.mark.parametrize("seed, rows, width, leaf, largest, copies", [(1, 300, 40, 4, 10**6, False), (2, 77, 500, 1, 3, False), (3, 200, 30, 8, 10**6, True), (4, 1, 5, 16, 9, False), (5, 500, 12, 16, 2, False)])
def test_trees_find_what_a_scan_finds(seed, rows, width, leaf, largest, copies):
    rng = np.random.default_rng(seed)
    tree, dense = random_tree(rng, rows, width, leaf, largest, copies)
    by_key = {k: i for i, k in enumerate(tree.keys)}
    order = [by_key[False, i] for i in range(rows)]
    for _ in range(30):
        columns = rng.choice(width + 5, rng.integers(1, 10), replace=False)
        weights = rng.integers(0, 20_000, len(columns))
        there = columns < width
        exact = dense[:, columns[there]] @ weights[there]
        for k in (1, 10, 1000):
            best = []
            tree.search(columns, weights, best, k)
            assert best == sorted((-int(s), (False, i)) for i, s in enumerate(exact) if s > 0)[:k]
        used = columns < tree.width
        if used.any():
            limits = tree.limits(columns[used], weights[used])
            for node, (start, stop) in enumerate(zip(tree.starts, tree.stops)):
                held = [i for i in range(rows) if start <= order[i] < stop]
                assert max(int(exact[i]) for i in held) <= limits[node]


def test_balls_alone_bound_what_they_hold():
    rng = np.random.default_rng(9)
    tree, dense = random_tree(rng, 200, 15, 8)
    tree.reaches = np.full_like(tree.reaches, 10**12)
    order = {k[1]: i for i, k in enumerate(tree.keys)}
    columns, weights = np.arange(tree.width), rng.integers(1, 9000, tree.width)
    for node, limit in enumerate(tree.limits(columns, weights)):
        held = [i for i in range(200) if tree.starts[node] <= order[i] < tree.stops[node]]
        assert (dense[held][:, : tree.width] @ weights).max() <= limit < 1e13


def test_subtrees_are_pruned():
    rng = np.random.default_rng(3)
    tree, _ = random_tree(rng, 4000, 400, 16)
    scored = [tree.search(rng.choice(400, 5, replace=False), rng.integers(1000, 9000, 5), [], 10) for _ in range(20)]
    assert np.mean(scored) < 0.7 * 4000


def test_search_over_odd_documents_and_items(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = ["the", "The", "of", "été", "ÉTÉ", "x1", "rare", "中文", "line"]
    made = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 12)))) for i in range(100, 160)]
    made += [(None, "rare rare line"), (200, "rare line"), (200, "rare line"), (201, "rare line"), (202, "rare line")]
    docs = edge_documents(spark).select("doc_id", "text", F.lit("clash").alias("item_id"), F.lit("clash").alias("score"))
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "score": F.lit("y")}))
    asked = [(1, "rare, THE line!"), (2, None), (3, ""), (4, "nowhere"), (5, "été the of of of"), (5, "été the of of of"), (5, "x1"), (None, "line mail"), (6, "中文 word")]
    items = spark.createDataFrame([(*row, "clash") for row in asked], "item_id long, text string, doc_id string")
    expected = by_brute_force([(r[0], r[1]) for r in ROWS] + made, asked)
    for group, numbers, at_once in ((8192, 2_000_000, 2000), (5, 2_000_000, 3), (50, 20, 1)):
        for name, value in (("GROUP", group), ("NUMBERS", numbers), ("ITEMS_AT_ONCE", at_once)):
            monkeypatch.setattr(lexical, name, value)
        assert sorted(map(tuple, lexical.search(docs, items).collect()), key=key) == sorted(expected, key=key)
    assert lexical.search(no_documents(spark), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
