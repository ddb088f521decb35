"""Packing of documents into sequences: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import WordCache, map_frames, materialize, table, texts

#: Tokens of a sequence, the id that ends a document, and about how many pieces are packed together.
CAPACITY, END_ID, GROUP = 2048, 1, 16_384
#: Spaces of a group's sequence ids.
WIDTH = 1 << 32


def _byte_of_character() -> dict[str, int]:
    """The vocabulary file writes bytes as printable characters: those of Latin-1 as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Ids of a byte-level vocabulary file.

    A space before a character other than white space always starts a new word of this kind of vocabulary, so a text is cut
    there, and the ids of words met before are reused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_of_character()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.after_space = WordCache(lambda word: self._encode(" " + word), limit=250_000)
        self.alone = WordCache(self._encode, limit=10_000)
        self.odd_space, self.cut = re.compile(r" (?:\s|$)"), re.compile(r"(?!^)(?= \S)")

    def _encode(self, word: str) -> bytes:
        return np.array(self.encoding.encode(word, allowed_special="all"), dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.odd_space.search(text):
            return b"".join(map(self.alone.__getitem__, self.cut.split(text)))
        first, *rest = text.split(" ")
        return (self.alone[first] if first else b"") + b"".join(map(self.after_space.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def _tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def tokenize(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the whole ids of every document, array<long>, with the id that ends it."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = _tokens(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        ids = [np.append(np.frombuffer(tokens.ids(t), dtype="<u4"), END_ID).astype(np.int64) for t in frame["text"]]
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "ids": ids})

    return map_frames(texts(docs), over, "doc_id long, ids array<long>")


def cut(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and cut: pieces of ``capacity`` ids and a rest, with the checksum of each piece's ids."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = _tokens(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        end, rows = END_ID.to_bytes(4, "little"), []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            ids = tokens.ids(text) + end
            for at in range(0, len(ids), 4 * capacity):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return map_frames(texts(docs), over, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first and each into the first bin that has room.

    The tree's leaves hold the room left in each bin and every inner node the larger of its two; the first bin with enough
    room is found on one way down, and mended on the way up.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, seed: int = 42) -> DataFrame:
    """Place pieces (doc_id, start, length, ...) into sequences of at most ``capacity``: adds sequence_id and offset.

    Every piece goes to one of n / group groups by a seeded hash of its row's number, and every group is packed by itself, so
    rows that agree in all columns are spread like any others. Pieces that fill a whole sequence take part too. The sequence
    ids of different groups differ. Give a written table: its rows keep their numbers when a lost task is run again. Equal
    lengths are taken in order of doc_id and start.
    """
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("bin_group", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)))

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), capacity)
        frame["sequence_id"], frame["offset"] = frame["bin_group"].to_numpy() * WIDTH + bins, offsets
        return frame.drop(columns="bin_group").assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("bin_group").applyInPandas(over, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every document's ids, in pieces of at most 2048, each at its place in a sequence.

    A null text is packed as an empty one: the end id alone. Repeated rows and rows without doc_id are packed as they come.
    Extra columns are left out; an empty table gives no rows.
    """
    return pack(materialize(cut(docs, vocabulary), "pieces"))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
