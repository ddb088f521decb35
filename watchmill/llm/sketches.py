"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into lines, lines into sentences and long sentences into runs of words; each part has a digest. Every digest is
added to one cell in each of three subtables, and a cell keeps the number, the exclusive or of the digests, and the sum of their
lower bits. Only where a single digest is left do the last two agree. Subtracting the cells of two versions leaves the digests that only one of them has. A cell with one digest left gives
it away; taking it out of its other cells lays open more, until nothing is left. If that gets stuck, it is tried again with
more cells. Large sets are dealt by digest bits into sections with a sketch each, so that the work grows with the text.

All of this is DataFrame expressions on the arrays of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchmill.llm.common import let, materialize, table

#: Words of one part at most; a part ends with its line and its sentence.
WORDS = 12
PART = rf"(?:\S*[^\s.!?][^\S\n]+){{0,{WORDS - 1}}}\S+"
TABLES = 3
#: Cells of a subtable, at the first try and when peeling got stuck; after the last the two sets are compared as they are.
SIZES = (8, 32)
#: Digests of both versions in a section on average, and rounds of peeling.
LOAD, ROUNDS = 12, 6
#: Documents of a block of neighbours.
BLOCK_BITS, LEVEL_BITS = 6, 10
#: Bits of a text's hash that deal rows without an id to blocks.
UNNAMED_BITS = 20
#: Documents whose cells are added up in one task, and the most tasks: beyond that the sums may spill.
TASK, MOST_TASKS = 1024, 100_000

FOUND = "array<struct<key:bigint,n:int>>"


def digests(text: Column) -> Column:
    """The distinct digests of a text's parts."""
    parts = F.regexp_extract_all(text, F.lit(PART), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda part: F.xxhash64(part)))


def _mark(digest: Column) -> Column:
    return digest.bitwiseAND(F.lit((1 << 40) - 1))


def _cell(n: Column, key: Column, mark: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), mark.alias("mark"))


def _slot(digest: Column, subtable: int, size: int) -> Column:
    """The cell of a subtable that a digest belongs to; every subtable uses other bits."""
    return F.shiftright(digest, 10 * subtable).bitwiseAND(F.lit(size - 1).cast("long"))


def _slots(size: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))


def sketch(items: Column, size: int = SIZES[0]) -> Column:
    """Cells of a set of digests: one array for each subtable."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def fill(subtable: int) -> Column:
        return F.transform(
            _slots(size),
            lambda slot: F.aggregate(
                F.filter(items, lambda d: _slot(d, subtable, size) == slot),
                empty,
                lambda cell, d: _cell(cell["n"] + 1, cell["key"].bitwiseXOR(d), cell["mark"] + _mark(d)),
            ),
        )

    return F.array(*(fill(subtable) for subtable in range(TABLES)))


def subtract(one: Column, other: Column) -> Column:
    def cells(a: Column, b: Column) -> Column:
        return _cell(a["n"] - b["n"], a["key"].bitwiseXOR(b["key"]), a["mark"] - b["mark"])

    return F.zip_with(one, other, lambda a, b: F.zip_with(a, b, cells))


def peel(cells: Column, size: int) -> Column:
    """Digests that are left in subtracted cells, array<struct<key, n>> with n 1 or -1 by side; null if peeling gets stuck."""

    def alone(cell: Column) -> Column:
        return (F.abs(cell["n"]) == 1) & (cell["mark"] == cell["n"] * _mark(cell["key"]))

    def without(table: Column, subtable: int, found: Column) -> Column:
        def less(cell: Column, gone: Column) -> Column:
            return _cell(cell["n"] - gone["n"], cell["key"].bitwiseXOR(gone["key"]), cell["mark"] - gone["n"] * _mark(gone["key"]))

        return F.zip_with(
            table,
            _slots(size),
            lambda cell, slot: F.aggregate(F.filter(found, lambda f: _slot(f["key"], subtable, size) == slot), cell, less),
        )

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(
            F.transform(F.filter(F.flatten(state["cells"]), alone), lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n")))
        )

        def take_out(found: Column) -> Column:
            left = F.array(*(without(F.get(state["cells"], F.lit(t)), t, found) for t in range(TABLES)))
            return F.struct(left.alias("cells"), F.concat(state["found"], found).alias("found"))

        return let(pure, lambda found: F.when(F.size(found) == 0, state).otherwise(take_out(found)))

    start = F.struct(cells.alias("cells"), F.array().cast(FOUND).alias("found"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    empty = lambda d: F.forall(F.flatten(d["cells"]), lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["mark"] == 0))
    return let(done, lambda d: F.when(empty(d), d["found"]))


def _sides(found: Column) -> Column:
    def counted(f: Column) -> Column:
        mine = F.size(F.filter(f, lambda entry: entry["n"] == 1))
        return F.when(f.isNotNull(), F.struct(mine.alias("mine"), (F.size(f) - mine).alias("other")))

    return let(found, counted)


def difference(one: Column, other: Column) -> Column:
    """How many digests only one of two sets has, struct<mine, other>: by sketches of growing size, at last by the sets."""
    tries = [_sides(peel(subtract(sketch(one, size), sketch(other, size)), size)) for size in SIZES]
    exact = F.struct(F.size(F.array_except(one, other)).alias("mine"), F.size(F.array_except(other, one)).alias("other"))
    return F.coalesce(*tries, exact)


def _dealt(items: Column, bits: Column) -> Column:
    """A set dealt into 2 ** bits sections, in two steps so that no digest is looked at once for every section."""
    first = F.floor(bits / 2).cast("int")
    wide, deep = F.pow(F.lit(2), first).cast("long"), F.pow(F.lit(2), bits - first).cast("long")
    rows = F.transform(F.sequence(F.lit(0).cast("long"), wide - 1), lambda g: F.filter(items, lambda d: F.pmod(F.shiftright(d, 34), wide) == g))
    return F.flatten(
        F.transform(
            rows,
            lambda row: F.transform(F.sequence(F.lit(0).cast("long"), deep - 1), lambda h: F.filter(row, lambda d: F.pmod(F.shiftright(d, 44), deep) == h)),
        )
    )


def likeness(one: Column, other: Column) -> Column:
    """Common digests of two sets over all of both, by their sketches; 1 for two empty sets."""
    both = F.size(one) + F.size(other)
    bits = F.least(F.greatest(F.ceil(F.log2(both / LOAD)), F.lit(0)), F.lit(18)).cast("int")
    parts = F.zip_with(_dealt(one, bits), _dealt(other, bits), difference)

    def add(total: Column, part: Column) -> Column:
        return F.struct((total["mine"] + part["mine"]).alias("mine"), (total["other"] + part["other"]).alias("other"))

    zero = F.struct(F.lit(0).alias("mine"), F.lit(0).alias("other"))
    shared = let(F.aggregate(parts, zero, add), lambda d: (F.size(one) - d["mine"]) / (F.size(one) + d["other"]))
    return F.when(both == 0, F.lit(1.0)).otherwise(shared)


def fingerprint(items: Column) -> Column:
    """The cells of the first size as text: number and digests of each."""
    cells = F.transform(
        F.flatten(sketch(items)), lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"))
    )
    return F.lower(F.array_join(cells, ""))


def _before(blocks: DataFrame) -> DataFrame:
    """(block, before): for each block number the one before it, and for the first the last.

    Blocks are compared within spans of 2 ** LEVEL_BITS; only the spans themselves, a thousandth of the blocks, meet in one
    place.
    """
    spans = blocks.withColumn("span", F.shiftright("block", LEVEL_BITS))
    inner = spans.withColumn("before", F.lag("block").over(Window.partitionBy("span").orderBy("block")))
    ends = materialize(spans.groupBy("span").agg(F.max("block").alias("last")), "spans")
    order = Window.orderBy("span")
    previous = ends.select(
        "span",
        F.coalesce(F.lag("last").over(order), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("outer"),
    )
    return inner.join(previous, "span", "left").select("block", F.coalesce("before", "outer").alias("before"))


def _block(doc_id: Column, text: Column) -> Column:
    """The block of a document, in the order of (doc_id, hash of the text); rows without an id are dealt by that hash."""
    unnamed = F.lit(-(1 << 62)) + F.shiftright(F.xxhash64(text), 64 - UNNAMED_BITS)
    return F.coalesce(F.shiftright(doc_id, BLOCK_BITS), unnamed)


def with_next(docs: DataFrame) -> DataFrame:
    """block, place, doc_id, text and digests of every document, with text and digests of the one after it by doc_id; the last gets the first.

    Documents are dealt by blocks of neighbouring ids, so whole texts are shuffled once; only the first document of each block
    is sent on to the block before. Of equal ids the order is that of their texts' hashes; rows without an id come first.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    plain = known.withColumn("block", _block(F.col("doc_id"), F.col("text")))
    known = plain.withColumn("digests", digests(F.col("text")))
    order = Window.partitionBy("block").orderBy("doc_id", F.xxhash64("text"))
    tasks = min(MOST_TASKS, max(1, -(-docs.count() // TASK)))
    # Text and digests are looked up one by one: a struct of both would be shuffled beside them.
    ahead = {"place": F.row_number().over(order), "next_text": F.lead("text").over(order), "next_digests": F.lead("digests").over(order)}
    placed = known.repartition(tasks, "block").withColumns(ahead)
    blocks = plain.select("block").distinct()
    first = plain.withColumn("place", F.row_number().over(order)).where("place = 1").select("block", "text")
    heads = first.select("block", F.struct("text", digests(F.col("text")).alias("digests")).alias("head"))
    heads = heads.join(_before(blocks), "block").select(F.col("before").alias("block"), "head")
    joined = placed.join(heads, "block", "left")
    last = F.col("next_text").isNull()
    return joined.select(
        "block",
        "place",
        "doc_id",
        "text",
        "digests",
        F.when(last, F.col("head.text")).otherwise(F.col("next_text")).alias("next_text"),
        F.when(last, F.col("head.digests")).otherwise(F.col("next_digests")).alias("next_digests"),
    )


#: Cells of a subtable for every digest of both sides in the table form, their most, and rounds: each takes out, in one
#: subtable, all digests that are alone in their cell there.
ROOM, MOST_BITS, TURNS = 4, 20, (0, 1, 2, 0, 1)
_PAIRS = {"edited": ("digests", "edited_digests"), "next": ("digests", "next_digests")}


def _cell_at(key: Column, subtable: int, bits: Column) -> Column:
    """Number of a digest's cell over all subtables; every subtable has bits of its own."""
    within = F.pmod(F.shiftright(key, MOST_BITS * subtable), F.pow(F.lit(2), bits).cast("long"))
    return F.lit(subtable * (1 << MOST_BITS)).cast("long") + within


def _added(cells: DataFrame) -> DataFrame:
    """Add up what falls into a cell; empty cells go. The rows of a block are in one task already."""
    summed = cells.groupBy("block", "place", "pair", "bits", "cell").agg(
        F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.sum("mark").alias("mark")
    )
    return summed.where("n <> 0 OR key <> 0 OR mark <> 0")


def _entry(cell: Column, n: Column, key: Column, mark: Column) -> Column:
    return F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), key.alias("key"), mark.alias("mark"))


def subtracted_and_peeled(pairs: DataFrame) -> DataFrame:
    """(block, peeled): for each place of a block, how many digests only one side has and whether peeling got stuck.

    The sketches of all documents are one table of cells. Both sides of a pair go into the same cells with opposite signs.
    """
    one, two, three = "digests", "edited_digests", "next_digests"
    sizes = [F.size(name) for name in (one, two, one, three)]
    ends = [sizes[0], sizes[0] + sizes[1], sizes[0] * 2 + sizes[1]]

    def bits(other: str) -> Column:
        return F.least(F.ceil(F.log2(F.lit(ROOM) * F.greatest(F.size(one) + F.size(other), F.lit(1)))), F.lit(MOST_BITS)).cast("int")

    every = pairs.select(
        "block", "place", ends[0].alias("e0"), ends[1].alias("e1"), ends[2].alias("e2"), bits(two).alias("b0"), bits(three).alias("b1"),
        F.posexplode(F.concat(one, two, one, three)).alias("at", "key"),
    )
    first = F.col("at") < F.col("e1")
    sign = F.when((F.col("at") < F.col("e0")) | (~first & (F.col("at") < F.col("e2"))), F.lit(1)).otherwise(F.lit(-1))
    every = every.select(
        "block", "place", F.when(first, 0).otherwise(1).alias("pair"), F.when(first, F.col("b0")).otherwise(F.col("b1")).alias("bits"), sign.alias("sign"), "key"
    )
    key, width = F.col("key"), F.col("bits")
    places = [_entry(_cell_at(key, t, width), F.col("sign"), key, F.col("sign") * _mark(key)) for t in range(TABLES)]
    cells = _added(every.select("block", "place", "pair", "bits", F.inline(F.array(*places))))
    n, mark = F.col("n"), F.col("mark")
    for turn in TURNS:
        here = (F.col("cell") >= turn * (1 << MOST_BITS)) & (F.col("cell") < (turn + 1) * (1 << MOST_BITS))
        alone = here & (F.abs(n) == 1) & (mark == n * _mark(key))
        out = [_entry(_cell_at(key, t, width), -n, key, -mark) for t in range(TABLES) if t != turn]
        zero = F.lit(0).cast("long")
        out.append(_entry(F.when(n == 1, F.lit(-1)).otherwise(F.lit(-2)), F.lit(1), zero, zero))
        kept = F.array(_entry(F.col("cell"), n, key, mark))
        cells = _added(cells.select("block", "place", "pair", "bits", F.inline(F.when(alone, F.array(*out)).otherwise(kept))))
    facts = []
    for i, name in enumerate(_PAIRS):
        mine = F.col("pair") == i
        facts += [
            F.sum(F.when(mine & (F.col("cell") == -1), n).otherwise(0)).alias(f"{name}_mine"),
            F.sum(F.when(mine & (F.col("cell") == -2), n).otherwise(0)).alias(f"{name}_other"),
            F.max(F.when(mine & (F.col("cell") >= 0), 1).otherwise(0)).alias(f"{name}_stuck"),
        ]
    each = cells.groupBy("block", "place").agg(*facts)
    # One row for each block, so that it meets the block's documents where they are.
    named = F.struct("place", F.struct(*(c for c in each.columns if c not in ("block", "place"))).alias("facts"))
    return each.groupBy("block").agg(F.map_from_entries(F.collect_list(named)).alias("peeled"))


def _near(name: str) -> Column:
    """Likeness from the peeled table; where that got stuck, from larger sketches of the row's own sets."""
    one, other = (F.col(c) for c in _PAIRS[name])
    facts = F.col("facts")
    peeled = F.try_divide(F.size(one) - facts[f"{name}_mine"], F.size(one) + facts[f"{name}_other"])
    return F.when(facts[f"{name}_stuck"] == 0, peeled).otherwise(likeness(one, other))


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document are.

    A null text counts as empty. Repeated rows and rows without doc_id take part as they come. Extra columns are left out; an
    empty table gives no rows; a single document is its own next one.
    """
    size = F.length("text")
    taken = F.floor(size / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - taken), F.substr("next_text", F.lit(1), taken))
    pairs = with_next(docs).select("block", "place", "doc_id", "text", "digests", "next_digests", edited.alias("edited"))
    pairs = pairs.withColumn("edited_digests", digests(F.col("edited")))
    peeled = subtracted_and_peeled(pairs.select("block", "place", "digests", "edited_digests", "next_digests"))
    details = pairs.select(
        "block",
        "place",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("digests")).alias("fingerprint"),
        fingerprint(F.col("edited_digests")).alias("edited_fingerprint"),
        "digests",
        "edited_digests",
        "next_digests",
    )
    found = details.join(peeled, "block", "left").withColumn("facts", F.element_at("peeled", F.col("place")))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        _near("edited").alias("near_edited"),
        _near("next").alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))
