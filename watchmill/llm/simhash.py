"""Near duplicates by SimHash fingerprints that differ in few bits, found by meeting in the middle.

Every distinct fingerprint is sent, with all its variants within half of the radius, to where equal variants meet. Two
fingerprints that meet in a variant of one bit differ in two bits at most, so all that meet there are linked without
looking at pairs, and 65 fingerprints at most can meet there.

A radius of 3 is odd: half of it is one bit, and one bit is left over. Of three differing bits at least one lies in one of
``BLOCKS`` blocks of bits. So the variants are sent again with each block cleared, pairs that meet there are verified on all
64 bits, and only groups of fingerprints that are not yet known to be connected are looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchmill.llm.common import map_frames, materialize, table, texts
from watchmill.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: More blocks give longer keys, which fewer strangers share, for more rows: BLOCKS * (64 - 64 / BLOCKS + 1) a fingerprint.
BLOCKS = 3
#: Hashes counted at a time.
STEP = 1 << 16


def simhash(text: str | None) -> int:
    """The fingerprint of one text as a signed long: bit i is set if more than half of the shingles' hashes have it.

    Words are runs of bytes other than white space, A to Z in lower case. A text of fewer than three words is one shingle;
    without a word the fingerprint is 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(shingles), STEP):
        part = np.array([digest(s, SEED) for s in shingles[start : start + STEP]], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint ``fp`` of every document; a null text counts as empty."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": [simhash(t) for t in frame["text"]]})

    return map_frames(texts(docs), over, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _masks(where: range | list[int]) -> list[int]:
    return [0, *(_signed(1 << i) for i in where)]


def _variants(cleared: list[int], tag: int) -> F.Column:
    """All variants by one bit outside the cleared bits, with a tag in the cleared ones."""
    keep = _signed((1 << BITS) - 1 - sum(1 << i for i in cleared)) if cleared else -1
    base = F.col("fp").bitwiseAND(F.lit(keep)).bitwiseOR(F.lit(_signed(tag << cleared[0]) if cleared else 0))
    return F.transform(
        F.array(*(F.lit(m).cast("long") for m in _masks([i for i in range(BITS) if i not in cleared]))),
        lambda mask: base.bitwiseXOR(mask),
    )


def link_groups(distinct: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(fp, label) for all distinct fingerprints: equal labels are connected by links of at most RADIUS differing bits."""
    met = distinct.select("fp", F.explode(_variants([], 0)).alias("variant"))
    met = met.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> least")
    near = components(met.select(F.col("fp").alias("a"), F.col("least").alias("b")))
    labelled = materialize(
        distinct.join(near, distinct["fp"] == near["node"], "left").select("fp", F.coalesce("component", "fp").alias("label")),
        "labels",
    )
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = F.concat(*(_variants(list(range(edges[i], edges[i + 1])), i + 1) for i in range(blocks)))
    group = Window.partitionBy("variant")
    open_keys = (
        labelled.select("fp", "label", F.explode(keys).alias("variant"))
        .withColumns({"low": F.min("label").over(group), "high": F.max("label").over(group)})
        .where("low <> high")
        .select("variant", "fp", "label")
    )
    open_keys = materialize(open_keys, "open-keys")
    one = open_keys.select("variant", F.col("fp").alias("fp_a"), F.col("label").alias("a"))
    other = open_keys.select("variant", F.col("fp").alias("fp_b"), F.col("label").alias("b"))
    pairs = one.join(other, "variant").where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= RADIUS)
    )
    far = components(pairs.select("a", "b"))
    return labelled.join(far, labelled["label"] == far["node"], "left").select("fp", F.coalesce("component", "label").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document: the smallest doc_id that links reach, itself included.

    Equal fingerprints link like near ones, that of texts without words too. Repeated rows and rows without doc_id keep their
    rows; a component whose rows all lack a doc_id has none. Extra columns are left out; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    groups = materialize(first.join(link_groups(first.select("fp")), "fp"), "fingerprint-groups")
    named = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    names = materialize(groups.join(named, "label").select("fp", "component_id"), "fingerprint-components")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
