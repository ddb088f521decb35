"""Encoding into word pieces that keep the place of every piece in the original bytes, and decoding.

A model file names the pieces with their scores and the rules of normalisation. The text is normalised by the longest
prefix that the compiled character map knows, and every normalised byte remembers the original bytes it comes from. Pieces
are merged by score in the normalised text, and each one is projected through these origins to a span of original bytes.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import WordCache, map_frames, table, texts

SPACE = "▁"
#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words of up to so many characters are merged by looking through their pairs.
SHORT = 200


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else number(at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled map of a normaliser: a double-array trie over bytes, and the strings that prefixes turn into."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.strings = blob[4 + size :]

    @staticmethod
    def _step(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement, for the longest known prefix of what stands at a place."""
        if not self.units:
            return None
        node, best = self._step(self.units[0]), None
        for taken in range(at, len(raw)):
            node ^= raw[taken]
            if node >= len(self.units) or self.units[node] & 0x800000FF != raw[taken]:
                break
            unit = self.units[node]
            node ^= self._step(unit)
            if unit >> 8 & 1:
                best = (taken + 1 - at, self.units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


class PieceModel:
    """A model file, read: encode with spans, and decode."""

    def __init__(self, model: bytes):
        kinds, self.pieces, scores, trainer, rules = [], [], [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24):
            raise ValueError("only models of merged pairs, without own symbols and with spaces before words, can be read")
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(i, 1)) for i in (3, 4, 5))
        self.fallback = bool(trainer.get(35, 0))
        self.unknown = kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.kinds = kinds
        self.ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == NORMAL}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(self.pieces, kinds)) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        space = lambda text: text.replace(SPACE, " ").encode()
        self.surfaces = [space(p) if kind == NORMAL else b"" for p, kind in zip(self.pieces, kinds)]
        self.surfaces[self.unknown] = space(self.unknown_text)
        for i, byte in self.byte_of.items():
            self.surfaces[i] = bytes([byte])
        self.words = self._cuts()
        self.known, self.packed = WordCache(self._merge), WordCache(self._pack)

    def _cuts(self) -> re.Pattern:
        """Finds parts of a text that can be merged by themselves: no piece goes beyond one of them.

        Parts end where the kind of character changes, or else before space signs, if every piece is one such part.
        """
        letter = r"[^\W\d_" + "".join(sorted(re.escape(c) for c in set("".join(self.ids)) if c.isalnum() and not c.isalpha())) + "]"
        kinds = re.compile(f"{SPACE}*(?:{letter}+|(?:(?!{letter})[^{SPACE}])+)|{SPACE}+", re.DOTALL)
        spaces = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        for pattern in (kinds, spaces):
            if all(pattern.fullmatch(p) and pattern.match(p).end() == len(p) for p in self.ids):
                return pattern
        return re.compile(".+", re.DOTALL)

    def normalize(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and for each of its bytes where the original bytes it comes from begin and end."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(0, np.int32), np.zeros(0, np.int32)
        lead = len(SPACE.encode()) if self.prefix else 0
        if not (self.map.units or self.squeeze) and self.escape:
            origin = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(np.frombuffer(raw, np.uint8) == 32, 3, 1))
            starts = np.concatenate([np.zeros(lead, np.int32), origin])
            stops = np.concatenate([np.zeros(lead, np.int32), origin + 1])
            return SPACE * self.prefix + text.replace(" ", SPACE), starts, stops
        out, starts, stops, at, after_space = [], [], [], 0, self.squeeze
        while at < len(raw):
            size, new = self.map.longest(raw, at) or (0, b"")
            if not size:
                size = 1 if raw[at] < 128 else 2 if raw[at] < 224 else 3 if raw[at] < 240 else 4
                new = raw[at : at + size]
            if after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = self.squeeze and new.endswith(b" ")
                if not out and self.prefix:
                    out, starts, stops = [SPACE.encode() if self.escape else b" "], [at] * lead, [at] * lead
                new = new.replace(b" ", SPACE.encode()) if self.escape else new
                out.append(new)
                starts += [at] * len(new)
                stops += [at + size] * len(new)
            at += size
        done = b"".join(out)
        sign = SPACE.encode() if self.escape else b" "
        while self.squeeze and done.endswith(sign):
            done = done[: -len(sign)]
        return done.decode(), np.array(starts[: len(done)], np.int32), np.array(stops[: len(done)], np.int32)

    def _merge(self, word: str) -> bytes:
        """Ids of one word, each with the bytes it takes of the normalised text in its upper half."""
        parts = self._merge_short(word) if len(word) <= SHORT else self._merge_long(word)
        return b"".join(map(self.packed.__getitem__, parts))

    def _pack(self, part: str) -> bytes:
        if part in self.ids:
            numbers = [self.ids[part] | len(part.encode()) << 32]
        elif self.fallback:
            numbers = [self.byte_ids[b] | 1 << 32 for b in part.encode()]
        else:
            numbers = [self.unknown | len(part.encode()) << 32]
        return np.array(numbers, dtype="<i8").tobytes()

    def _merge_short(self, word: str) -> list[str]:
        """Merge the best pair, the first of equals, until none is known."""
        parts, known, never = list(word), self.rank.get, math.inf
        ranks = [known(a + b, never) for a, b in zip(word, word[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = known(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = known(parts[i] + parts[i + 1], never)
        return parts

    def _merge_long(self, word: str) -> list[str]:
        """The same in linear-logarithmic time: pairs wait in a heap, and those that a merge has overtaken are skipped."""
        parts: list[str | None] = list(word)
        n, rank, heap = len(parts), self.rank, []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            pair = word[i : i + 2]
            if pair in rank:
                heap.append((rank[pair], i, i + 1, pair))
        heapq.heapify(heap)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != len(pair):
                continue
            parts[i], parts[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (longer := pair + parts[k]) in rank:
                    heapq.heappush(heap, (rank[longer], i, k, longer))
            if (h := before[i]) >= 0 and (longer := parts[h] + pair) in rank:
                heapq.heappush(heap, (rank[longer], h, i, longer))
        return [part for part in parts if part is not None]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where the original bytes of each piece begin and end."""
        normal, starts, stops = self.normalize(text)
        packed = np.frombuffer(b"".join(map(self.known.__getitem__, self.words.findall(normal))), dtype="<i8")
        ids, end = (packed & 0xFFFFFFFF).astype(np.int32), np.cumsum(packed >> 32)
        begin = end - (packed >> 32)
        if not self.fallback and len(ids) > 1:  # a run of unknown pieces is one
            joined = np.flatnonzero((ids[1:] == self.unknown) & (ids[:-1] == self.unknown))
            ids, begin, end = np.delete(ids, joined + 1), np.delete(begin, joined + 1), np.delete(end, joined)
        return ids, starts[begin], stops[end - 1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces are silent, bytes that are no valid character become U+FFFD."""
        raw = b"".join(map(self.surfaces.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        else:
            text = text.replace(SPACE, " ")
        first = next((i for i in ids if i not in self.silent), self.unknown)
        if self.kinds[first] == NORMAL and (self.prefix or self.squeeze):
            text = text.lstrip(" ") if self.squeeze else text.removeprefix(" ")
        return text

    def _decode_broken(self, ids: list[int]) -> str:
        """Runs of byte pieces are decoded by themselves, so that broken ones do not spoil their neighbours."""
        parts, held = [], bytearray()
        for i in [*ids, self.unknown]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            parts += [_characters(bytes(held)), self.surfaces[i].decode()]
            held.clear()
        return "".join(parts[:-1]).replace(SPACE, " ")


def _characters(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, begins and ends (spans in the text's UTF-8 bytes) and the decoded text of every whole document.

    A null text counts as empty and has no ids. Repeated rows and rows without doc_id are encoded as they come; extra columns
    are left out; an empty table gives no rows. The model file has to be at the same path on every executor.
    """

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        pieces = load(model or public_tokenizers.path("piece_bpe_32k.model"))
        encoded = [pieces.encode(text) for text in frame["text"]]
        columns = dict(zip(("ids", "begins", "ends"), map(list, zip(*encoded)) if encoded else ([], [], [])))
        decoded = [pieces.decode(ids.tolist()) for ids, _, _ in encoded]
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), **columns, "decoded": decoded})

    return map_frames(texts(docs), over, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def op1_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("source_bytes"),
    )
