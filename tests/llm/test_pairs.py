"""Fingerprints, near duplicates and components against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.frames import CLASHING, ROWS, edge_documents, key, no_documents
from watchmill.llm import components, neighbours, simhash, sketches


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300), (7, 8), (8, 7)]
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(90)]
    found = components.components(spark.createDataFrame([*links, (1, None)], "a long, b long"))
    nodes = {n for a, b in links if a != b for n in (a, b)}
    rows = found.collect()
    assert len(rows) == len(nodes)
    assert {r["node"]: r["component"] for r in rows} == least_reachable(nodes, [(a, b) for a, b in links if a != b])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_broadcast_of_least_nodes_has_one_long_as_its_key(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, i) for i in range(40)], "a long, b long")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    found = components._with_least(edges, least.hint("broadcast")).select("a", "b", "m")
    assert sorted(map(tuple, found.collect())) == sorted((a, b, 0 if a == 100 else a - 1) for a, b in edges.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"HashedRelationBroadcastMode\(List\(([^()]*)\)", plan)
    # Rows under other keys are kept in pages of 16 MB and more, on every executor and for every round.
    assert keys and all(re.fullmatch(r"input\[\d+, bigint, \w+\]", k) for k in keys)


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [simhash.xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def by_brute_force(prints):
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    return least_reachable(prints, links)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB \n\t é"), max_size=80))
def test_fingerprint_of_one_text(text):
    assert simhash.simhash(text) % (1 << 64) == plain_simhash(text)


def test_spark_hashes_alike(spark):
    assert spark.sql("select xxhash64('one two three') h").first()["h"] % (1 << 64) == simhash.xxhash.xxh64_intdigest(b"one two three", 42)


def test_near_duplicates_are_those_of_brute_force(spark, sf):
    prints = {r["doc_id"]: plain_simhash(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = simhash.op10_simhash_near_duplicates(spark, sf).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == by_brute_force(prints)


def test_no_link_of_three_bits_is_lost(spark):
    rng, values = random.Random(2), []
    for _ in range(60):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(rng.randint(1, 6)):  # chains of near and too far steps, also within one block
            low = rng.randrange(0, 44)
            for bit in rng.sample(range(low, low + 20), rng.randint(1, 5)):
                base ^= 1 << bit
            values.append(base)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    found = {r["fp"]: r["label"] for r in simhash.link_groups(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = by_brute_force(dict(zip(values, [v % (1 << 64) for v in values])))
    groups = {}
    for value, name in want.items():
        groups.setdefault(name, set()).add(value)
    mine = {}
    for value, name in found.items():
        mine.setdefault(name, set()).add(value)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates_of_odd_documents(spark):
    rows = simhash.near_duplicates(edge_documents(spark)).collect()
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((row[0] for row in ROWS), key=key)
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[1] == found[2] == found[3] == 1 and found[8] == found[5] == 5 and found[None] is None
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def plain_digests(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r["i"]: set(r["d"]) for r in frame.select("i", sketches.digests(F.col("text")).alias("d")).collect()}


def test_sketches_compare_like_sets(spark, sf):
    documents = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    texts = [t for _, t in documents]
    edited = [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]
    own, changed = plain_digests(spark, texts), plain_digests(spark, edited)
    rows = {r["doc_id"]: r for r in sketches.op2_fingerprints(spark, sf).collect()}
    assert len(rows) == len(documents)
    for i, (doc_id, text) in enumerate(documents):
        row, following = rows[doc_id], own[(i + 1) % len(texts)]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == __import__("hashlib").sha256(edited[i].encode()).hexdigest()
        assert abs(row["near_edited"] - len(own[i] & changed[i]) / len(own[i] | changed[i])) < 1e-12
        assert abs(row["near_next"] - len(own[i] & following) / len(own[i] | following)) < 1e-12
    by_text = {}
    for doc_id, text in documents:
        assert by_text.setdefault(text, rows[doc_id]["fingerprint"]) == rows[doc_id]["fingerprint"]


def test_peeling_recovers_the_digests_of_both_sides(spark):
    frame = spark.createDataFrame([([1, 2, 3, 40, 50], [3, 2, 1, 7])], "a array<long>, b array<long>")
    hashed = frame.select(*(F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"))
    cells = sketches.subtract(sketches.sketch(F.col("a"), 16), sketches.sketch(F.col("b"), 16))
    row = hashed.select("a", "b", sketches.peel(cells, 16).alias("found")).first()
    assert {f["key"] for f in row["found"] if f["n"] == 1} == set(row["a"]) - set(row["b"])
    assert {f["key"] for f in row["found"] if f["n"] == -1} == set(row["b"]) - set(row["a"])
    # Too few cells: peeling gets stuck, and larger sketches or the sets themselves give the answer.
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: F.xxhash64(x)).alias("a"), F.array(F.lit(5).cast("long")).alias("b"))
    stuck = many.select(sketches.peel(sketches.subtract(sketches.sketch(F.col("a"), 8), sketches.sketch(F.col("b"), 8)), 8).alias("found"), sketches.difference(F.col("a"), F.col("b")).alias("d")).first()
    assert stuck["found"] is None and (stuck["d"]["mine"], stuck["d"]["other"]) == (60, 1)


def test_neighbours_over_gaps_between_blocks(spark):
    ids = [3, 64, 65, 5000, 70_000, 10_000_000, 10**15, -9]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    found = {r["doc_id"]: r["t"] for r in sketches.with_next(docs).select("doc_id", F.col("next_text").alias("t")).collect()}
    order = sorted(ids)
    assert found == {i: f"text {order[(n + 1) % len(order)]}" for n, i in enumerate(order)}


def test_rows_without_an_id_are_dealt_to_blocks_in_order(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i}") for i in range(600)], "doc_id long, text string")
    rows = sketches.with_next(docs).select("block", "doc_id", "text", "next_text", F.xxhash64("text").alias("h")).collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    assert {r["text"]: r["next_text"] for r in rows} == {r["text"]: order[(i + 1) % 600]["text"] for i, r in enumerate(order)}
    assert len({r["block"] for r in rows if r["doc_id"] is None}) > 390  # of 400


def test_sketches_of_odd_documents(spark):
    rows = sketches.compare_with_edited(edge_documents(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert sketches.compare_with_edited(no_documents(spark)).count() == 0
    one = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    assert sketches.compare_with_edited(one).first()["near_next"] == 1.0


OTHERS = [c for c in CLASHING if c != "label"]
VECTORS = "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in OTHERS)


def vectors_of(spark, rows):
    return spark.createDataFrame([(*row, *("clash" for _ in OTHERS)) for row in rows], VECTORS)


def near_by_brute_force(rows):
    good = [(i, np.array(v, dtype=np.float64), label) for i, v, label in rows]
    links = []
    for n, (i, v, label) in enumerate(good):
        for j, w, other in good[:n]:
            if label == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((j, i))
    return least_reachable([i for i, _, _ in good], links), links


def test_embeddings_link_like_brute_force(spark):
    rng, rows = np.random.default_rng(4), []
    for _ in range(150):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 5)):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.07).astype(np.float32).tolist(), int(len(rows) % 2 and 1)))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(30)]
    want, links = near_by_brute_force(rows)
    counts = {i: 0 for i, _, _ in rows}
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    found = neighbours.near_duplicates(vectors_of(spark, rows)).collect()
    assert len(found) == len(rows)
    agree = sum(r["component_id"] == want[r["vec_id"]] and r["n_links"] == counts[r["vec_id"]] for r in found)
    assert agree >= 0.97 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_shards_are_split_and_overlap(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST", 100)
    monkeypatch.setattr(neighbours, "TARGET", 40)
    rng, rows = np.random.default_rng(6), []
    for _ in range(250):
        base = rng.normal(size=16)
        rows += [(len(rows) + i, (base + rng.normal(size=16) * 0.03).astype(np.float32).tolist(), 1) for i in range(2)]
    classes = neighbours.classes_of(neighbours.usable(vectors_of(spark, rows)))
    shards = neighbours.shards_of(classes)
    assert shards.select("node").distinct().count() == 500
    assert max(r["count"] for r in shards.groupBy("shard").count().collect()) <= 100
    pairs = neighbours.linked_pairs(shards)
    true, found = neighbours.audit(classes, pairs, queries=500)
    assert true > 100 and found >= 0.9 * true


def test_large_groups_of_near_copies_keep_all_links(spark, monkeypatch):
    for name, value in (("MOST", 100), ("TARGET", 35), ("BLOCK", 60)):
        monkeypatch.setattr(neighbours, name, value)
    rng, rows = np.random.default_rng(9), []
    for label, size in ((0, 400), (1, 150), (1, 230)):  # one label is a single group, the other has two beside other vectors
        base = rng.normal(size=16)
        rows += [(len(rows) + i, (base + rng.normal(size=16) * 0.03).astype(np.float32).tolist(), label) for i in range(size)]
    rows += [(len(rows) + i, rng.normal(size=16).astype(np.float32).tolist(), 1) for i in range(200)]
    rows += [(len(rows) + i, rows[5][1], 0) for i in range(3)]
    want, links = near_by_brute_force(rows)
    counts = np.bincount(np.array(links).ravel(), minlength=len(rows))
    found = neighbours.near_duplicates(vectors_of(spark, rows)).collect()
    assert {r["vec_id"]: r["component_id"] for r in found} == want
    assert {r["vec_id"]: r["n_links"] for r in found} == dict(enumerate(counts.tolist()))
    classes = neighbours.classes_of(neighbours.usable(vectors_of(spark, rows)))
    for overlap in (3, 4):  # no split may be as large as what it splits
        shards = neighbours.shards_of(classes, overlap)
        assert shards.where("NOT whole").groupBy("shard").count().where("count > 100").isEmpty()
        assert shards.count() < 4 * overlap * len(rows)


def test_recall_below_the_target_is_an_error(spark, monkeypatch):
    empty = lambda classes, shards, threshold: (lambda p: (p, neighbours._counted(classes, p)))(spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(neighbours, "all_links", empty)
    with pytest.raises(RuntimeError, match="audited links"):
        neighbours.near_duplicates(vectors_of(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]))


def test_embeddings_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [1.0, None], 1),
        (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [-1.0, 0.0], 1), (10, [2.0, 0.0], 1),
        (None, [1.0, 0.0], 1), (12, [1e-30, 0.0], 2), (13, [1e30, 0.0], 2),
    ]
    found = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(vectors_of(spark, rows)).collect()), key=lambda r: key(r[0]))
    assert len(found) == len(rows)
    assert found[0] == (1, 2, 1, True) and found[-1] == (None, 0, None, False)
    assert [r for r in found if r[0] in (10, 12, 13)] == [(10, 2, 1, False), (10, 2, 1, False), (12, 1, 12, True), (13, 1, 12, False)]
    assert all(r[1] == 0 and r[2] == r[0] and r[3] for r in found if r[0] in (2, 3, 4, 5, 6, 7, 8, 9, 11))
    assert neighbours.near_duplicates(vectors_of(spark, [])).count() == 0
