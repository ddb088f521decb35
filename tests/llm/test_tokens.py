"""Pieces and packing against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.frames import ROWS, edge_documents, no_documents
from watchmill.llm import packing, pieces
from watchmill.llm.common import WordCache

MODEL = public_tokenizers.path("piece_bpe_32k.model")
library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
byte_library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
byte_tokens = packing.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"))

odd_parts = [*"abe. \n\t▁é中文ｆ🙂<>s/0x41'²½_ 　́", "the", "  ", "<s>", "<|endoftext|>", "².", "\n\n"]
odd_text = st.lists(st.sampled_from(odd_parts), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(odd_text | st.text(max_size=40))
def test_pieces_are_those_of_the_library(text):
    model = pieces.load(MODEL)
    ids, begins, ends = model.encode(text)
    assert ids.tolist() == library.encode(text)
    assert model.decode(ids.tolist()) == library.decode(ids.tolist())
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 600) | st.integers(0, 31_999), max_size=20))
def test_any_ids_decode_like_the_library(ids):
    assert pieces.load(MODEL).decode(ids) == library.decode(ids)


def test_long_words_merge_like_short_ones():
    model, rng = pieces.load(MODEL), random.Random(3)
    for _ in range(50):
        word = "▁" + "".join(rng.choice("theandingr") for _ in range(rng.randint(1, 400)))
        assert model._merge_short(word) == model._merge_long(word)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_character_maps_are_followed_by_longest_prefix(rule):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    rules = next(dict(pieces._fields(value)) for field, value in pieces._fields(normalizer.serialized_model_proto()) if field == 3)
    model = object.__new__(pieces.PieceModel)
    model.map, model.prefix, model.squeeze, model.escape = pieces.CharacterMap(rules[2]), True, True, True
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab  \n\té中ｆ①㌀ﬁÅＡ　ﾊﾞ́eΣß") for _ in range(rng.randint(0, 15)))
        normal, starts, stops = model.normalize(text)
        assert normal == normalizer.normalize(text)
        assert len(starts) == len(stops) == len(normal.encode())
        assert all(0 <= a <= b <= len(text.encode()) for a, b in zip(starts, stops))
        assert list(starts) == sorted(starts)


def test_every_document_is_encoded(spark):
    rows = pieces.encode_documents(edge_documents(spark)).collect()
    assert len(rows) == len(ROWS)
    texts = {row[0]: row[1] or "" for row in ROWS}
    for row in rows:
        assert row["ids"] == library.encode(texts[row["doc_id"]])
        assert row["decoded"] == library.decode(row["ids"])
        assert len(row["begins"]) == len(row["ends"]) == len(row["ids"])
    assert pieces.encode_documents(no_documents(spark)).count() == 0


def test_digests_of_pieces(spark, sf):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pieces.op1_encode_pieces(spark, sf).collect()
    assert len(rows) == len(documents)
    for row in rows:
        ids = library.encode(documents[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(odd_text | st.text(max_size=40))
def test_byte_tokens_are_those_of_the_library(text):
    assert np.frombuffer(byte_tokens.ids(text), "<u4").tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_a_small_cache_gives_the_same():
    cache = WordCache(len, limit=2)
    words = ["a", "bb", "ccc", "a", "dddd", "bb", "a"] * 5
    assert [cache[w] for w in words] == [len(w) for w in words]
    assert len(cache) <= 2 and len(cache.old) <= 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing_by_tree_is_that_by_scanning(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, dtype=np.int64), 64)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
        if at == len(free):
            free.append(64)
        want[i] = (at, 64 - free[at])
        free[at] -= lengths[i]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))} == want


def check_packing(rows, texts):
    by_document, by_sequence = {}, {}
    for row in rows:
        by_document.setdefault(row["doc_id"], []).append(row)
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    assert set(by_document) == set(texts)
    for doc_id, found in by_document.items():
        ids = np.array(byte_library.encode(texts[doc_id], add_special_tokens=False).ids + [1], dtype="<u4")
        for row in found:
            assert row["doc_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(ids[row["start"] : row["start"] + row["length"]].tobytes())
    for found in by_sequence.values():
        found.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in found])
        assert [r["offset"] for r in found] == [0, *ends[:-1]] and ends[-1] <= 2048
    return sum(r["length"] for r in rows) / (2048 * len(by_sequence))


def test_documents_are_packed_whole(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.op8_pack_documents(spark, sf).collect()
    assert check_packing(rows, texts) > 0.99
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())


def test_packing_in_many_groups_and_of_odd_documents(spark):
    docs = edge_documents(spark)
    cut = packing.cut(docs)
    rows = packing.pack(cut, group=2).collect()
    check_packing(rows, {row[0]: row[1] or "" for row in ROWS})
    assert len(rows) == cut.count()
    assert packing.pack_documents(no_documents(spark)).count() == 0
    whole = {r["doc_id"]: r["ids"] for r in packing.tokenize(docs).collect()}
    assert whole[2] == [1] and len(whole[4]) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 4)


def test_equal_pieces_without_an_id_are_spread_over_the_groups(spark, tmp_path):
    equal = spark.range(40_000).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("start"),
        F.lit(1).cast("long").alias("length"),
        F.lit(7).cast("long").alias("ids_crc32"),
    )
    equal.write.parquet(str(tmp_path / "pieces"))
    rows = packing.pack(spark.read.parquet(str(tmp_path / "pieces")), group=1000)
    sizes = rows.groupBy(F.floor(F.col("sequence_id") / packing.WIDTH)).count().toPandas()["count"]
    assert sizes.sum() == 40_000 and len(sizes) == 40 and sizes.max() < 1200
    assert rows.select("sequence_id", "offset").distinct().count() == 40_000
