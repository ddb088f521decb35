"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.frames import ROWS, edge_documents, no_documents
from watchmill.llm import infill

SPLIT = {infill.LINE: re.compile(r"[^\n]*\n|[^\n]+"), infill.CODE_POINT: re.compile(r"[\s\S]")}


def plain_row(doc_id, text, unit=infill.LINE, rate=100):
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = SPLIT[unit].findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def key(row):
    return tuple((value is None, value) for value in row)


odd = st.lists(st.sampled_from([*"ab \n\n\t\0é中🙂<P>S/M\x80\x0b ", "<P>", "\n\n\n\n\n\n\n\n\n", "x" * 17]), max_size=30).map("".join)


@pytest.mark.parametrize("unit", [infill.LINE, infill.CODE_POINT])
@settings(max_examples=300, deadline=None)
@given(rows=st.lists(st.tuples(odd | st.text(max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), min_size=1, max_size=8))
def test_units_are_cut_where_a_scan_cuts_them(unit, rows):
    raw = [text.encode("utf-8", "surrogatepass") for text, _, _ in rows]
    stops = np.cumsum([len(r) for r in raw])
    begins = stops - [len(r) for r in raw]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    first, second = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2))
    n, middle, suffix, prefix_chars, middle_chars = infill.cut_units(data, begins, stops, first, second, unit)
    for i, (text, h1, h2) in enumerate(rows):
        units = SPLIT[unit].findall(text)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        before, between = "".join(units[:a]), "".join(units[a:b])
        assert n[i] == len(units)
        assert (middle[i] - begins[i], suffix[i] - middle[i]) == (len(before.encode()), len(between.encode()))
        assert (prefix_chars[i], middle_chars[i]) == (len(before), len(between))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=80))
def test_select_is_the_inverse_of_rank(values):
    data = np.array([10 if v < 60 else v for v in values], dtype=np.uint8)
    ends, places = infill.Ends(data, infill.LINE), np.flatnonzero(data == 10) + 1
    assert ends.select(np.arange(1, len(places) + 1)).tolist() == places.tolist()
    assert ends.rank(np.arange(len(data) + 1)).tolist() == [int((places <= at).sum()) for at in range(len(data) + 1)]


@pytest.mark.parametrize("unit, rate", [(infill.LINE, 100), (infill.CODE_POINT, 100), (infill.LINE, 40)])
def test_odd_documents(spark, unit, rate):
    extra = [(i, f"line {i}\n<{mark}> in it\nlast") for i, mark in enumerate("PSMX", 20)] + [(40 + i, "\n" * i + "<S" * (i % 3)) for i in range(40)]
    extra += [(100, "a\nb\n" * 400_000), (101, "x\n" * 3), (101, "x\n" * 3), (101, "another text of that id")]
    docs = edge_documents(spark).select("doc_id", "text", F.lit("clash").alias("h1"), F.lit("clash").alias("form"))
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumns({"h1": F.lit("x"), "form": F.lit("y")}))
    rows = infill.fill_in_middle(docs, unit, rate).withColumn("again", infill.restored(F.col("form"), F.col("output"))).collect()
    texts = [(r[0], r[1] or "") for r in ROWS] + extra
    assert sorted((tuple(r)[:-1] for r in rows), key=key) == sorted((plain_row(i, t, unit, rate) for i, t in texts), key=key)
    assert sorted(((r["doc_id"], r["again"]) for r in rows), key=key) == sorted(texts, key=key)
    assert infill.fill_in_middle(no_documents(spark)).count() == 0


def test_long_texts_are_taken_alone(spark, monkeypatch):
    monkeypatch.setattr(infill, "BYTES_AT_ONCE", 10)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["", "abc", "x" * 50, "", "12345", "12345", "1"])})
    parts = [part.column("text").to_pylist() for part in infill._parts(batch)]
    assert sum(parts, []) == batch.column("text").to_pylist()
    assert all(len(part) == 1 or sum(map(len, part)) <= 10 for part in parts)
