"""Fill-in-the-middle by words of eight bytes.

The UTF-8 bytes of many texts are viewed as unsigned 64-bit words. Arithmetic on whole words marks every byte that ends a unit
(a line, or a code point), a count of bits gives the units of each word, and running totals of these counts make a directory:
the k-th end is searched in the totals, which names the word, and then found inside of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import table, texts

LINE, CODE_POINT = "line", "code point"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages of texts that are changed, and among them of those whose suffix comes first; and the seed of all draws.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7
#: Texts are taken together up to so many bytes; a longer text is taken alone.
BYTES_AT_ONCE = 1 << 24

ONES, LOWS, HIGHS = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)


def ending_marks(words: np.ndarray, unit: str) -> np.ndarray:
    """Words in which the high bit of every byte is set that ends a unit."""
    if unit == LINE:
        differing = words ^ NEWLINES
        return ~(((differing & LOWS) + LOWS) | differing | LOWS)
    if unit == CODE_POINT:
        # A byte 10xxxxxx continues a code point; a byte ends one if the byte after it does not continue it.
        starts = ~(words & ~(words << np.uint64(1))) & HIGHS
        return (starts >> np.uint64(8)) | np.append(starts[1:] << np.uint64(56), np.uint64(0))
    raise ValueError(f"no such unit: {unit}")


class Ends:
    """Where the units of a run of bytes end: ``rank`` counts ends before a byte, ``select`` gives the byte after the k-th."""

    def __init__(self, data: np.ndarray, unit: str):
        padded = np.zeros((len(data) // 8 + 1) * 8, dtype=np.uint8)
        padded[: len(data)] = data
        self.marks = ending_marks(padded.view("<u8"), unit)
        self.totals = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, below = at >> 3, (np.uint64(1) << ((at & 7) * 8).astype(np.uint64)) - np.uint64(1)
        return self.totals[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th end, counted from one; every k has to be there."""
        word = np.searchsorted(self.totals, k, side="left") - 1
        left = (k - self.totals[word]).astype(np.uint64)
        # Byte i of the product counts the ends up to byte i; those that count fewer than are left come before the k-th.
        running = (self.marks[word] >> np.uint64(7)) * ONES
        reached = ((running | HIGHS) - left * ONES) & HIGHS
        return word * 8 + (8 - np.bitwise_count(reached).astype(np.int64)) + 1


def cut_units(data: np.ndarray, begins: np.ndarray, stops: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str):
    """Cut texts, given as spans of one run of bytes, in three after numbers of units drawn from ``first`` and ``second``.

    Returns the units of every text, the bytes at which its middle and its suffix begin, and the code points of its prefix and
    of its middle.
    """
    ends, points = Ends(data, unit), Ends(data, CODE_POINT)
    before = ends.rank(begins)
    closed = ends.rank(stops) - before
    last = data[np.maximum(stops - 1, 0)] if len(data) else np.zeros(len(stops), np.uint8)
    n = closed + ((stops > begins) & (last != 10) if unit == LINE else 0)
    a, b = first % (n + 1), second % (n + 1)

    def at(k: np.ndarray) -> np.ndarray:
        inside = (k > 0) & (k < n)
        place = np.where(k > 0, stops, begins)
        place[inside] = ends.select((before + k)[inside])
        return place

    middle, suffix = at(np.minimum(a, b)), at(np.maximum(a, b))
    counted = points.rank(middle)
    return n, middle, suffix, counted - points.rank(begins), points.rank(suffix) - counted


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts have at most BYTES_AT_ONCE bytes, or one row."""
    sizes = np.concatenate([[0], np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + BYTES_AT_ONCE, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _rearrange(batch: pa.RecordBatch, unit: str) -> pa.RecordBatch:
    column = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    begins, stops = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    draws = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("h1", "h2")]
    n, middle, suffix, prefix_chars, middle_chars = cut_units(data, begins, stops, *draws, unit)
    forms = batch.column("form").to_pylist()
    p, s, m, raw = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode(), data.tobytes()
    outputs = []
    for form, begin, i, j, stop in zip(forms, begins.tolist(), middle.tolist(), suffix.tolist(), stops.tolist()):
        if form == "plain":
            outputs.append(raw[begin:stop])
        elif form == "psm":
            outputs.append(b"".join((p, raw[begin:i], s, raw[j:stop], m, raw[i:j])))
        else:
            outputs.append(b"".join((s, raw[j:stop], p, raw[begin:i], m, raw[i:j])))
    plain = np.array([form == "plain" for form in forms], dtype=bool)
    columns = {
        "doc_id": batch.column("doc_id"),
        "n": pa.array(n, pa.int64()),
        "form": batch.column("form"),
        "prefix_chars": pa.array(prefix_chars, pa.int64(), mask=plain),
        "middle_chars": pa.array(middle_chars, pa.int64(), mask=plain),
        "output": pa.array(outputs, pa.binary()).view(pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _draw(doc_id: Column, seed: int, nth: int) -> Column:
    """The nth group of eight hexadecimal digits of the digest of seed and key, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * nth - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = LINE, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every whole text, cut into units (LINE or CODE_POINT).

    ``form`` is ``plain`` (output is the text, and the numbers of code points are null) for empty texts, texts that hold one of
    the three marks, and those beyond the rate; else ``spm`` (suffix, prefix, middle) or ``psm``. All draws come from the digest
    of the seed and doc_id, so a repeated row is cut the same way again; a row without doc_id draws from the seed alone. A null
    text is an empty one: n is 0. An empty table gives no rows, extra columns are left out.
    """
    text = F.col("text")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (_draw(F.col("doc_id"), seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("doc_id"), seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    drawn = texts(docs).select("doc_id", "text", form.alias("form"), _draw(F.col("doc_id"), seed, 1).alias("h1"), _draw(F.col("doc_id"), seed, 2).alias("h2"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield _rearrange(part, unit)

    return drawn.mapInArrow(over, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: no part holds a mark, so the three marks cut it into its parts again."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    in_order = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    suffix_before = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", in_order).otherwise(suffix_before)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("form"), F.col("output"))
    return changed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")
    )


#: One row of lines per text; the draws are the first four groups of eight digits of the digest of seed and key.
OP11_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines,
    sha256('7:' || coalesce(doc_id::varchar, '')) as digest
  from documents),
drawn as (
  select *, len(lines) as n,
    ('0x' || substr(digest, 1, 8))::bigint as h1, ('0x' || substr(digest, 9, 8))::bigint as h2,
    ('0x' || substr(digest, 17, 8))::bigint as h3, ('0x' || substr(digest, 25, 8))::bigint as h4
  from cut),
placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, array_to_string(lines[1:a], '') as prefix, array_to_string(lines[a + 1:b], '') as middle,
    array_to_string(lines[b + 1:n], '') as suffix
  from placed)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then body when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(body) as restored_sha256
from parts
"""
