"""Near duplicates among embeddings by a flat graph with robust pruning.

Vectors of a label are dealt to shards around pivots, each to its nearest few, so that shards overlap. In every shard a graph
is built: from its nearest vectors and a few far ones each vector keeps those that no kept one stands much closer to. The
lists of a vector from all its shards are united. A search walks greedily from the shard's medoid towards the query and then
expands from every vector in range until no new one is in range. Each found pair is verified in double precision. A large
shard that pivots cannot part, or whose vectors mostly link, is not torn: all its pairs are compared, in pairs of blocks. The
recall is audited for stated queries against all vectors; below the target all is built again with more overlap, and if that
does not help the query fails.

Equal vectors are one class from the start and are never expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import map_frames, materialize, table
from watchmill.llm.components import components

THRESHOLD = 0.98
#: Most classes in a shard, classes a pivot is drawn for, most pivots at one splitting, and shards a class is dealt to.
MOST, TARGET, PIVOTS, OVERLAP = 2000, 700, 64, 2
#: Links kept for a vector, nearest and far ones looked at, how much closer a kept one stands, and width of the search.
DEGREE, NEAR, FAR, ALPHA, BEAM = 16, 32, 8, 1.2, 24
#: Share of a shard's pairs that link from which on it is compared whole, the most of its parent a split shard may hold, and
#: classes in a block of those compared whole.
DENSE, SHRINK, BLOCK = 0.05, 0.75, 4000
#: Stated queries of the audit are the classes whose least id is divisible by EVERY, and AUDITED more; AT_A_TIME travel to the
#: tasks at once. The recall aimed at, and how often all is built again with more overlap.
AUDITED, EVERY, AT_A_TIME, RECALL, REBUILDS = 200, 100, 4096, 0.9, 2


def _can_link() -> F.Column:
    cell = F.col("embedding")
    finite = F.forall(cell, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(cell, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that can link: nothing null, all components finite, not all zero."""
    return vectors.where(_can_link()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")


def classes_of(known: DataFrame) -> DataFrame:
    """(node, label, embedding, first, copies): one row for each different vector of a label."""
    groups = known.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return materialize(groups.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def _units(column: pd.Series) -> np.ndarray:
    raw = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # no component can overflow when squared
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def choose_pivots(drawn: np.ndarray, wanted: int, overlap: int, threshold: float) -> np.ndarray | None:
    """Places of the pivots among drawn vectors, or None if their shard is to be compared whole.

    Pivots stand twice as far apart as vectors that link, so that a group of near copies has one and is not torn. Only where
    there are too few such, and few of the drawn vectors link, nearer ones are taken too.
    """
    cosine, apart = drawn @ drawn.T, []
    for i in range(len(drawn)):
        if not (cosine[i, apart] >= 2 * threshold * threshold - 1).any():
            apart.append(i)
    if len(apart) >= 2 * overlap:
        return np.array(apart[:wanted])
    links = (cosine >= threshold).sum() - len(drawn)
    if len(drawn) < 2 * overlap or links >= DENSE * len(drawn) * (len(drawn) - 1):
        return None
    return np.arange(min(wanted, len(drawn)))


def shards_of(classes: DataFrame, overlap: int = OVERLAP, threshold: float = THRESHOLD) -> DataFrame:
    """(shard, node, embedding, whole): every class in one shard or more; those above MOST are marked to be compared whole.

    A shard that is too large is split by pivots, at most PIVOTS of them, again and again. Pivots are the classes with the
    least hashes in the shard, and travel to its rows by a join on the shard. There are three times as many as a class is dealt
    to, and a shard that still holds over SHRINK of its parent is compared whole, so every split gets smaller.
    """
    start = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))
    done, large, depth = None, classes.select(start.alias("shard"), "node", "embedding", F.lit(None).cast("long").alias("parent")), 0
    while True:
        sizes = materialize(large.groupBy("shard").agg(F.count(F.lit(1)).alias("size"), F.max("parent").alias("of")), "shard-sizes")
        stuck = F.coalesce(F.col("size") > SHRINK * F.col("of"), F.lit(False))
        large = large.drop("parent").join(sizes, "shard").withColumn("whole", (F.col("size") > MOST) & stuck)
        fitting = large.where((F.col("size") <= MOST) | F.col("whole")).select("shard", "node", "embedding", "whole")
        done = fitting if done is None else done.unionByName(fitting)
        if sizes.where((F.col("size") > MOST) & ~stuck).isEmpty():
            return done
        wanted = F.least(F.greatest(F.ceil(F.col("size") / TARGET), F.lit(3 * overlap)), F.lit(PIVOTS)).cast("int")
        # Hash values are spread evenly, so a threshold on them draws about twice the pivots wanted; the least are kept.
        spread = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 40))
        too_large = large.where((F.col("size") > MOST) & ~F.col("whole"))
        drawn = too_large.withColumns({"draw": spread, "wanted": wanted})
        drawn = drawn.where(F.col("draw") < F.lit(float(1 << 40)) * (2 * F.col("wanted") + 20) / F.col("size"))

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["draw", "node"]).reset_index(drop=True)
            chosen = choose_pivots(_units(frame["embedding"]), int(frame["wanted"].iloc[0]), overlap, threshold)
            pivots = None if chosen is None else [frame["embedding"].iloc[i] for i in chosen]
            return pd.DataFrame({"shard": frame["shard"].iloc[:1], "pivots": [pivots]})

        pivots = drawn.select("shard", "node", "embedding", "draw", "wanted").groupBy("shard").applyInPandas(choose, "shard string, pivots array<array<float>>")
        pivots = materialize(pivots, "pivots")
        dealt = too_large.select("shard", "node", "embedding", "size").join(pivots, "shard", "left")
        done = done.unionByName(dealt.where("pivots IS NULL").select("shard", "node", "embedding", F.lit(True).alias("whole")))

        def deal(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            for shard, part in frame.groupby("shard", sort=False):
                centres = _units(part["pivots"].iloc[0])
                near = _units(part["embedding"]) @ centres.T
                chosen = np.argsort(-near, axis=1, kind="stable")[:, :overlap]
                for rank in range(chosen.shape[1]):
                    names = [f"{shard}/{i}" for i in chosen[:, rank]]
                    out.append(pd.DataFrame({"shard": names, "node": part["node"].to_numpy(), "embedding": part["embedding"].to_numpy(), "parent": part["size"].to_numpy()}))
            return pd.concat(out)

        large = materialize(map_frames(dealt.where("pivots IS NOT NULL"), deal, "shard string, node long, embedding array<float>, parent long"), "shards")
        depth += 1


def robust_prune(at: int, candidates: np.ndarray, units: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Of the candidates near a vector, the nearest first, those that no kept one stands ``alpha`` times closer to."""
    candidates = candidates[candidates != at]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * units[candidates] @ units[at]))
    order = np.argsort(apart, kind="stable")
    candidates, apart, kept = candidates[order], apart[order], []
    while len(candidates) and len(kept) < degree:
        best = candidates[0]
        kept.append(int(best))
        between = np.sqrt(np.maximum(0.0, 2 - 2 * units[candidates] @ units[best]))
        stay = alpha * between > apart
        stay[0] = False
        candidates, apart = candidates[stay], apart[stay]
    return kept


def build_graph(units: np.ndarray) -> list[list[int]]:
    """Lists of links for all vectors of a shard; a link is there both ways if the other end has room for it after pruning."""
    n, rng = len(units), np.random.default_rng(7)
    lists: list[list[int]] = []
    for start in range(0, n, 512):
        near = units[start : start + 512] @ units.T
        width = min(n, NEAR + 1)
        closest = np.argpartition(-near, width - 1, axis=1)[:, :width]
        for row in range(len(near)):
            pool = np.unique(np.concatenate([closest[row], rng.integers(0, n, FAR)]))
            lists.append(robust_prune(start + row, pool, units))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, links in enumerate(lists):
        for j in links:
            back[j].append(i)
    for i, extra in enumerate(back):
        both = np.unique(np.array(lists[i] + extra, dtype=np.int64))
        lists[i] = both.tolist() if len(both) <= 2 * DEGREE else robust_prune(i, both, units, 2 * DEGREE)
    return lists


def range_search(query: int, units: np.ndarray, lists: list[np.ndarray], medoid: int, threshold: float) -> np.ndarray:
    """Vectors of the shard with a cosine of at least the threshold to one of them, as far as the graph leads."""
    slack = threshold - 1e-9
    seen = np.zeros(len(units), dtype=bool)
    found = [(float(units[medoid] @ units[query]), medoid), (1.0, query)]
    seen[[medoid, query]] = True
    expanded: set[int] = set()
    while True:
        found.sort(key=lambda f: (-f[0], f[1]))
        # The best few are always looked at, and beyond them everything in range.
        ahead = [i for place, (cosine, i) in enumerate(found) if (place < BEAM or cosine >= slack) and i not in expanded]
        if not ahead:
            return np.array(sorted(i for cosine, i in found if cosine >= slack and i != query), dtype=np.int64)
        expanded.update(ahead)
        fresh = np.unique(np.concatenate([lists[i] for i in ahead]))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        found += list(zip((units[fresh] @ units[query]).tolist(), fresh.tolist()))


def linked_pairs(shards: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) with a < b for classes found to have a cosine of at least the threshold."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = frame["node"].to_numpy()
        links = [nodes[np.array(found, dtype=np.int64)] for found in build_graph(_units(frame["embedding"]))]
        return pd.DataFrame({"node": nodes, "links": links})

    lists = shards.groupBy("shard").applyInPandas(build, "node long, links array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    united = materialize(united, "graph")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, units = frame["node"].to_numpy(), _units(frame["embedding"])
        place = {node: i for i, node in enumerate(nodes.tolist())}
        lists = [np.array([place[x] for x in links if x in place], dtype=np.int64) for links in frame["links"]]
        medoid = int((units @ units.mean(axis=0)).argmax())
        pairs: set[tuple[int, int]] = set()
        for i in range(len(nodes)):
            for j in range_search(i, units, lists, medoid, threshold).tolist():
                a, b = sorted((int(nodes[i]), int(nodes[j])))
                if float(units[i] @ units[j]) >= threshold:
                    pairs.add((a, b))
        return pd.DataFrame(sorted(pairs), columns=["a", "b"]).astype("int64")

    full = shards.join(united, "node").select("shard", "node", "embedding", "links")
    return full.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def _spanning(hits: np.ndarray, first: int, names: np.ndarray, below: np.ndarray) -> list[tuple[int, int]]:
    """Links of the rows ``first``, ``first + 1``, ... to the columns that join groups not joined before; names are updated."""
    out = []
    for row, hit in enumerate(hits):
        others = below[hit]
        if len(others) and (names[others] != names[first + row]).any():
            groups, places = np.unique(names[others], return_index=True)
            out += [(first + row, int(others[at])) for group, at in zip(groups, places) if group != names[first + row]]
            names[np.isin(names, groups)] = names[first + row]
    return out


def compared_whole(whole: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, others, links) for all pairs within shards: rows with b are links that hold its components together, rows without
    say how many links ``a`` has to classes, and to their copies in ``others``.

    The pairs themselves, quadratic in a group of near copies, are never written. A pair of classes that meets in several
    shards counts in the one with the least name.
    """
    sizes = whole.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    shared = whole.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("all"))
    rows = whole.select("shard", "node", "embedding").join(sizes, "shard").join(shared, "node").join(classes.select("node", "copies"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shard", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "embedding", "copies", "all")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        shard, i, j = frame["shard"].iloc[0], frame["i"].iloc[0], frame["j"].iloc[0]
        frame = frame.sort_values(["block", "node"]).reset_index(drop=True)
        units, nodes, copies = _units(frame["embedding"]), frame["node"].to_numpy(), frame["copies"].to_numpy()
        left, right = np.flatnonzero(frame["block"] == i), np.flatnonzero(frame["block"] == j)
        earlier = [np.array([g in names for names in frame["all"]]) for g in {g for names in frame["all"] for g in names if g < shard}]
        links, others, names, edges = np.zeros(len(nodes), dtype=np.int64), np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes)), []
        for start in range(0, len(left), 256):
            some = left[start : start + 256]
            hits = units[some] @ units[right].T >= threshold
            for there in earlier:
                hits &= ~np.outer(there[some], there[right])
            if i == j:
                hits[np.arange(len(some)), some] = False
            links[some] += hits.sum(axis=1)
            others[some] += hits @ copies[right]
            if i != j:
                links[right] += hits.sum(axis=0)
                others[right] += copies[some] @ hits
            edges += _spanning(hits, int(some[0]), names, right)
        some = np.flatnonzero(links)
        counted = pd.DataFrame({"a": nodes[some], "b": pd.array([None] * len(some), dtype="Int64"), "others": others[some], "links": links[some]})
        joined = pd.DataFrame({"a": [nodes[x] for x, _ in edges], "b": pd.array([nodes[y] for _, y in edges], dtype="Int64"), "others": 0, "links": 0})
        return pd.concat([counted, joined]).astype({"a": "int64", "others": "int64", "links": "int64"})

    return rows.groupBy("shard", "i", "j").applyInPandas(compare, "a long, b long, others long, links long")


def all_links(classes: DataFrame, shards: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b) that hold the components together, and (a, others, links): each class's links to copies and to classes."""
    pairs = materialize(linked_pairs(shards.where(~F.col("whole")).select("shard", "node", "embedding"), threshold), "links")
    whole = shards.where("whole")
    if whole.isEmpty():
        return pairs, _counted(classes, pairs)
    compared = materialize(compared_whole(whole, classes, threshold), "compared-whole")
    member = whole.select("shard", F.col("node").alias("a"))
    again = pairs.join(member, "a").join(member.withColumnRenamed("a", "b"), ["shard", "b"]).select("a", "b").distinct()
    pairs = materialize(pairs.join(again, ["a", "b"], "left_anti"), "links")
    counts = _counted(classes, pairs).unionByName(compared.where("b IS NULL").select("a", "others", "links"))
    joined = pairs.unionByName(compared.where("b IS NOT NULL").select("a", "b"))
    return joined, materialize(counts.groupBy("a").agg(F.sum("others").alias("others"), F.sum("links").alias("links")), "link-counts")


def _counted(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of_b = classes.select(F.col("node").alias("b"), "copies")
    return both.join(of_b, "b").groupBy("a").agg(F.sum("copies").alias("others"), F.count(F.lit(1)).alias("links"))


def audit(classes: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, queries: int = AUDITED) -> tuple[int, int]:
    """Links of stated queries by brute force against all classes, and how many of them are among the pairs."""
    return audit_counts(classes, _counted(classes, pairs), threshold, queries)


def audit_counts(classes: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, queries: int = AUDITED) -> tuple[int, int]:
    """Links of stated queries by brute force against all classes, and how many were counted; what is counted was verified.

    The queries are the classes whose least id is divisible by EVERY, so they grow with the data, and those with the least
    hashes. They travel to all tasks, some at a time.
    """
    hashed = F.xxhash64("node")
    least = classes.orderBy(hashed, "node").limit(queries).select("node")
    stated = classes.where(F.col("first") % EVERY == 0).select("node").unionByName(least).distinct()
    stated = materialize(classes.select("node", "label", "embedding").join(stated, "node"), "stated")
    turns = -(-stated.count() // AT_A_TIME)
    true = found = 0
    for turn in range(turns):
        some = stated.where(F.pmod(F.xxhash64("node", F.lit(turns)), F.lit(turns)) == turn)
        held = some.toPandas()
        if held.empty:
            continue
        shared = classes.sparkSession.sparkContext.broadcast((held["node"].to_numpy(), held["label"].to_numpy(), list(map(np.asarray, held["embedding"]))))

        def compare(frame: pd.DataFrame) -> pd.DataFrame:
            nodes, labels, embeddings = shared.value  # noqa: B023
            sizes, out = np.array([len(e) for e in embeddings]), []
            for (label, size), part in frame.assign(size=frame["embedding"].map(len)).groupby(["label", "size"], sort=False):
                same = np.flatnonzero((labels == label) & (sizes == size))
                if len(same):
                    hits = _units(pd.Series([embeddings[i] for i in same])) @ _units(part["embedding"]).T >= threshold
                    hits &= nodes[same][:, None] != part["node"].to_numpy()
                    out.append(pd.DataFrame({"a": nodes[same], "true": hits.sum(axis=1)}))
            every = pd.concat(out) if out else pd.DataFrame({"a": [], "true": []})
            return every[every["true"] > 0].astype("int64")

        there = map_frames(classes.select("node", "label", "embedding"), compare, "a long, true long").groupBy("a").agg(F.sum("true").alias("true"))
        row = there.join(counts, "a", "left").agg(F.sum("true").alias("true"), F.sum("links").alias("found")).first()
        true, found = true + (row["true"] or 0), found + (row["found"] or 0)
        shared.destroy()
    return true, found


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows that cannot link (see ``usable``) have no links and are their own component; a row without vec_id has none and is not
    kept. Repeated rows link with each other like copies. Vectors of different lengths never link. Extra columns are left out.
    """
    known = usable(vectors)
    classes = classes_of(known)
    for more in range(REBUILDS + 1):
        pairs, others = all_links(classes, materialize(shards_of(classes, OVERLAP + more, threshold), "all-shards"), threshold)
        true, found = audit_counts(classes, others, threshold)
        if found >= RECALL * true:
            break
    else:
        raise RuntimeError(f"only {found} of {true} audited links were found after {REBUILDS} rebuilds")
    sizes = classes.select("node", "copies", "first")
    near = components(pairs)
    named = sizes.join(near, "node", "left").select("node", "first", "copies", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = named.join(least, "component").join(others, named["node"] == others["a"], "left")
    facts = facts.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    keyed = materialize(classes.select("node", "label", "embedding").join(facts, "node").drop("node"), "vector-facts")
    linked = known.join(keyed, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_can_link()).select(F.col("vec_id").cast("long").alias("vec_id"))
    every = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
