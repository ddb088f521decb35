"""Ranked lexical search as an exact inner-product search over sparse ball trees.

A document is a sparse vector of integers, one number for each of its terms that any item asks for; an item is the vector of its
terms' weights, and a score is their inner product. Every task deals the documents it reads into groups, and builds a ball tree
over each: nodes with a centre, the distance of the farthest document from it, and along each coordinate how far documents reach.
No document of a node can score more than the item's product with the centre and the item's length times that radius. Vectors of
thousands of coordinates all lie far from their centre, so the bound is also taken in the item's own coordinates alone, where
centre and radius along each of them say how far documents reach; the lesser one counts. Nodes are visited by falling bounds until
the bound is below the item's k-th best score, documents of leaves are scored in integers. Bounds are rounded up by more than
floating-point arithmetic can have lost, so nothing is missed.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchmill.llm.common import materialize, table, texts

#: Best documents of an item.
BEST = 10
#: Bytes that belong to terms: digits, letters, and all of code points from 0x80 on; A-Z count as a-z.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Long texts are counted in parts of about so many bytes.
PART = 1 << 20
#: Bounds of a tree: documents and numbers of a group, documents of a leaf.
GROUP, NUMBERS, LEAF = 8192, 2_000_000, 16
#: Bounds of a block of items, whose terms are broadcast together: items, and characters of their texts (or one item).
ITEMS_AT_ONCE, CHARACTERS_AT_ONCE = 2000, 8_000_000
#: Twice the rounding error of one floating-point operation.
EPSILON = 2.0**-51


def count_terms(text: bytes) -> Counter:
    """Occurrences of the terms of a text in UTF-8."""
    spaced, counts, start = text.translate(_TERM_BYTES), Counter(), 0
    while start < len(spaced):
        stop = spaced.find(b" ", start + PART)
        stop = len(spaced) if stop < 0 else stop
        counts.update(spaced[start:stop].split(b" "))
        start = stop
    counts.pop(b"", None)
    return counts


@dataclass
class Tree:
    """A ball tree over sparse rows of positive integers, which are put in the order of its leaves.

    ``starts`` and ``stops`` are the rows of each node, ``left`` its first child (its second one follows), or -1. Centres, and
    how far rows reach along a column (the centre and the radius there), are held by column: ``centre_starts`` says where the
    nodes and values of a column begin.
    """

    keys: list
    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    leaf: int = LEAF
    starts: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.width = int(self.columns.max()) + 1 if len(self.columns) else 0
        self.numbers = self.values.astype(np.float64)
        order, queue = np.arange(len(self.keys)), [(0, len(self.keys))]
        radii, centres = [], []
        # Nodes are numbered as they are met, children one after the other.
        for node, (start, stop) in enumerate(queue):
            rows = order[start:stop]
            column, number, row = self._entries(rows)
            squares = np.bincount(row, number * number, len(rows))
            centre = np.bincount(column, number, self.width) / max(len(rows), 1)
            radii.append(self._radius(column, number, row, squares, centre))
            used = np.flatnonzero(centre)
            reach = np.zeros(self.width, dtype=np.int64)
            np.maximum.at(reach, column, number.astype(np.int64))
            centres.append((used, np.full(len(used), node), centre[used], reach[used]))
            self.starts.append(start)
            self.stops.append(stop)
            if len(rows) <= self.leaf:
                self.left.append(-1)
                continue
            self.left.append(len(queue))
            order[start:stop] = rows[self._along(column, number, row, squares)]
            middle = (start + stop) // 2
            queue += [(start, middle), (middle, stop)]
        self.radii = np.array(radii)
        column, node, value, reach = (np.concatenate(part) for part in zip(*centres))
        by_column = np.argsort(column, kind="stable")
        self.centre_nodes, self.centre_values, self.reaches = node[by_column], value[by_column], reach[by_column]
        self.centre_starts = np.searchsorted(column[by_column], np.arange(self.width + 1))
        self.keys = [self.keys[i] for i in order.tolist()]
        sizes = np.diff(self.bounds)[order]
        places = self._places(order)
        self.columns, self.values = self.columns[places], self.values[places]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        del self.numbers

    def _places(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[rows] - ends + sizes, sizes)

    def _entries(self, rows: np.ndarray):
        places = self._places(rows)
        return self.columns[places], self.numbers[places], np.repeat(np.arange(len(rows)), self.bounds[rows + 1] - self.bounds[rows])

    def _radius(self, column, number, row, squares, centre) -> float:
        """A distance from the centre that no row exceeds: all parts are sums of positive numbers, each with a bounded error."""
        products, square = np.bincount(row, number * centre[column], len(squares)), float(centre @ centre)
        lost = (len(column) + len(centre) + 8) * EPSILON * (squares + 2 * products + square)
        return math.sqrt(max(float((squares - 2 * products + square + lost).max(initial=0.0)), 0.0)) * (1 + 4 * EPSILON)

    def _along(self, column, number, row, squares) -> np.ndarray:
        """Rows in the order in which they lie between two that are far from each other."""

        def products(with_row: int) -> np.ndarray:
            dense = np.zeros(self.width)
            mine = row == with_row
            dense[column[mine]] = number[mine]
            return np.bincount(row, number * dense[column], len(squares))

        one = int((squares - 2 * products(0)).argmax())
        by_one = products(one)
        other = int((squares - 2 * by_one).argmax())
        return np.argsort(products(other) - by_one, kind="stable")

    def limits(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node, a number that no row's product with the weights exceeds."""
        begins, sizes = self.centre_starts[columns], self.centre_starts[columns + 1] - self.centre_starts[columns]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(begins - ends + sizes, sizes)
        nodes, repeated = self.centre_nodes[places], np.repeat(weights, sizes)
        length = math.sqrt(float(weights.astype(np.float64) @ weights))
        ball = np.bincount(nodes, self.centre_values[places] * repeated, len(self.radii)) + length * self.radii
        along = np.bincount(nodes, (self.reaches[places] * repeated).astype(np.float64), len(self.radii))
        return np.minimum(ball, along) * (1 + (len(columns) + 16) * EPSILON) + 1

    def search(self, columns: np.ndarray, weights: np.ndarray, best: list, k: int) -> int:
        """Bring the k best (-score, key) up to date, scores above 0, and return how many rows were scored.

        ``best`` is sorted. Rows that tie with the k-th are looked at, as their keys may come first.
        """
        asked = columns < self.width
        columns, weights = columns[asked], weights[asked]
        if not len(columns) or not self.keys:
            return 0
        dense = np.zeros(self.width, dtype=np.int64)
        dense[columns] = weights
        limits, scored = self.limits(columns, weights).tolist(), 0
        heap = [(-limits[0], 0)]
        while heap:
            limit, node = heapq.heappop(heap)
            least = -best[k - 1][0] if len(best) >= k else 1
            if -limit < least:
                break
            if self.left[node] >= 0:
                # No child can hold more than its parent.
                for child in (self.left[node], self.left[node] + 1):
                    if limits[child] >= least:
                        heapq.heappush(heap, (max(limit, -limits[child]), child))
                continue
            start, stop = self.starts[node], self.stops[node]
            scored += stop - start
            at, to = self.bounds[start], self.bounds[stop]
            scores = np.add.reduceat(dense[self.columns[at:to]] * self.values[at:to], self.bounds[start:stop] - at)
            found = np.flatnonzero(scores >= least)
            if len(found):
                best += [(-int(scores[i]), self.keys[start + i]) for i in found.tolist()]
                best.sort()
                del best[k:]
        return scored


def _counted(docs: DataFrame, rows: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms with repeats), and of the terms in ``rows`` their numbers and occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, columns, times = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                counts = count_terms(text.as_py())
                asked = [(known[term], count) for term, count in counts.items() if term in known]
                n.append(counts.total())
                columns.append([column for column, _ in asked])
                times.append([count for _, count in asked])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "columns": pa.array(columns, pa.list_(pa.int32())),
                    "times": pa.array(times, pa.list_(pa.int64())),
                }
            )

    return texts(docs).mapInArrow(over, "doc_id long, n long, columns array<int>, times array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _search_all(counted: DataFrame, items: list, weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """item (its place in ``items``), item_id, doc_id and score of each task's best documents.

    ``items`` are (item_id, numbers of its terms). The best found so far are carried from group to group.
    """
    shared = counted.sparkSession.sparkContext.broadcast((items, weights))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        keys, sizes, columns, values = [], [], [], []

        def grown() -> Tree:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return Tree(list(keys), bounds, np.concatenate(columns), np.concatenate(values))

        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                size, column = _flat(batch.column("columns"))
                _, times = _flat(batch.column("times"))
                m = np.array([10 + 90 * n * documents // terms for n in batch.column("n").to_pylist()], dtype=np.int64)
                some = np.flatnonzero(size)
                ids = batch.column("doc_id").to_pylist()
                keys += [(ids[i] is None, ids[i] or 0) for i in some.tolist()]
                sizes.append(size[some])
                columns.append(column)
                values.append(1_000_000_000 * times // (1000 * times + 8 * np.repeat(m, size)))
                if len(keys) >= GROUP or sum(map(len, columns)) >= NUMBERS:
                    yield grown()
                    for held in (keys, sizes, columns, values):
                        held.clear()
        if keys:
            yield grown()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best: list[list] = [[] for _ in asked]
        for tree in trees(batches):
            for (_, columns), found in zip(asked, best):
                tree.search(columns, weight[columns], found, k)
        rows = [(i, item_id, None if missing else doc_id, -score) for i, (item_id, _) in enumerate(asked) for score, (missing, doc_id) in best[i]]
        names, kinds = ("item", "item_id", "doc_id", "score"), (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_pydict({name: pa.array([row[j] for row in rows], kind) for j, (name, kind) in enumerate(zip(names, kinds))})

    return counted.mapInArrow(over, "item int, item_id long, doc_id long, score long")


def _block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    rows: dict[bytes, int] = {}
    asked = []
    for item in items.collect():
        found = count_terms(item["text"].encode("utf-8", "surrogatepass"))
        asked.append((item["item_id"], np.array([rows.setdefault(term, len(rows)) for term in found], dtype=np.int64)))
    counted = materialize(_counted(docs, rows), "term-counts")
    sums = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    # Of each term the block asks for, in how many documents it is: as many rows as the block has terms.
    held = counted.select(F.explode("columns").alias("column")).groupBy("column").count().collect()
    weights = np.zeros(len(rows), dtype=np.int64)
    for row in held:
        weights[row["column"]] = math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * row["count"] + 1)))
    found = _search_all(counted, asked, weights, sums["documents"], sums["terms"] or 1, k)
    first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) for every item (item_id, text).

    The weights of terms come from all documents; a null text has no term. Equal scores are ranked by doc_id, rows without one
    last; repeated rows of a document are ranked one after the other. Rows of the items that agree in id and text are one item,
    and rows of one id with several texts are answered one by one. Items of which no document has a term have no row, nor have
    empty tables. Extra columns are left out. Items are taken in blocks of a bounded size, each of which reads the documents.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters")).first()
    blocks = max(1, -(-size["n"] // ITEMS_AT_ONCE), -(-(size["characters"] or 0) // CHARACTERS_AT_ONCE))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = [_block(docs, dealt.where(F.col("block") == block).select("item_id", "text"), k) for block in range(blocks)]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with document_terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
item_terms as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
occurrences as (select doc_id, term, count(*) as tf from document_terms group by all),
lengths as (select doc_id, count(*) as n from document_terms group by all),
totals as (select count(*) as documents, sum(n)::bigint as terms from lengths),
weights as (
  select term, floor(1000 * ln((2 * documents + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from occurrences, totals group by term, documents),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // terms))))::bigint as score
  from item_terms join occurrences using (term) join weights using (term) join lengths using (doc_id), totals
  group by item_id, doc_id),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as place, doc_id, score
  from scores where score > 0)
select item_id, place::int as rank, doc_id, score from ranked where place <= 10
"""
